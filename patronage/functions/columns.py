"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(cases: Iterable[tuple[Column, object]], default: object) -> Column:
    """The value of the first case whose condition holds."""
    chain = None
    for condition, value in cases:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return F.lit(default) if chain is None else chain.otherwise(default)


def dec(text: object) -> Column:
    """A decimal literal with exactly the digits given."""
    whole, _, fraction = str(text).lstrip("-").partition(".")
    return F.lit(str(text)).cast(f"decimal({max(len(whole) + len(fraction), 1)},{len(fraction)})")


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0))


def snippet(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and "..." when the text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def date_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def with_run_metadata(df: DataFrame, layer: str, day: date, moment: datetime) -> DataFrame:
    """The layer's date and timestamp columns. The moment is one literal per run, so rows agree."""
    names = {
        "bronze": ("_ingestion_date", "_ingestion_timestamp"),
        "silver": ("_silver_process_date", "_silver_process_timestamp"),
        "gold": ("_gold_process_date", "_gold_process_timestamp"),
    }[layer]
    return df.withColumns({names[0]: F.lit(day), names[1]: F.lit(moment)})
