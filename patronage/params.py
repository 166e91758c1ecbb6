"""Parameters of one run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import types as T

FULL = "FULL"
INCREMENTAL = "INCREMENTAL"


def _yesterday() -> date:
    return date.today() - timedelta(days=1)


@dataclass(frozen=True)
class RunParams:
    """Everything a run may be told.

    ``score_orientation``: "as_written" keeps tile 1 for the best customers; "five_is_best" flips it.
    ``on_duplicate_address``: a customer with several different primary addresses yields several rows
    ("keep"), one row with the smallest address ("first"), or fails the job ("error").
    ``strict_types``: cast money to decimal(15,2) and rates to decimal(5,2), failing on overflow,
    instead of the wider types that hold any total.
    ``keep_state``: purchases are kept as sums per customer and product. A full run starts them; the source of
    an incremental run then delivers the orders, lines and returns that are new since the run before, and no
    old line is read again. Slices older than ``state_days`` join the full state now and then and are final.
    ``run_id``: the name under which a run leaves its summary and log; one of its own for each when empty.
    ``all_source_columns``: the bronze layer keeps columns beyond the contract's as well.
    """

    data_date: date = field(default_factory=_yesterday)
    process_type: str = FULL
    debug_mode: bool = False
    retention_days: int = 365
    high_value_threshold: Decimal = Decimal("5000.00")
    loyalty_threshold: int = 5
    churn_days_very_high: int = 180
    churn_days_high: int = 90
    churn_days_medium: int = 60
    churn_days_low: int = 30
    score_orientation: str = "as_written"
    null_safe_name: bool = False
    on_duplicate_address: str = "keep"
    strict_types: bool = False
    all_source_columns: bool = False
    keep_state: bool = False
    state_days: int = 30
    run_id: str = ""
    started_at: datetime = field(default_factory=datetime.now)

    def __post_init__(self) -> None:
        _one_of("process_type", self.process_type, (FULL, INCREMENTAL))
        _one_of("score_orientation", self.score_orientation, ("as_written", "five_is_best"))
        _one_of("on_duplicate_address", self.on_duplicate_address, ("keep", "first", "error"))

    @property
    def retention_cutoff(self) -> date:
        return self.data_date - timedelta(days=self.retention_days)

    @property
    def money_type(self) -> T.DecimalType:
        return T.DecimalType(15, 2) if self.strict_types else T.DecimalType(24, 2)

    @property
    def rate_type(self) -> T.DecimalType:
        return T.DecimalType(5, 2) if self.strict_types else T.DecimalType(18, 2)


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")
