"""Exact NTILE over a whole table, without moving it into one partition.

A global NTILE is decided by the rows that open each tile. They are found from one range-partitioned
sort of the narrow (key, id) pairs: the position within a partition plus the counts of the partitions
before it is the row's rank. (key, id) is unique, so range partitioning stays balanced however many
rows share a key. The driver sees one count per partition and n - 1 opening rows per ranking; each
row's tile is then a plain comparison, and the table itself is never shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.sources.durable import durable

ROWS_PER_PARTITION_BITS = 33  # monotonically_increasing_id: partition above, row below these bits


@dataclass(frozen=True)
class By:
    """What to rank by, in its own type. Null keys come first when ascending and last when descending."""

    key: Column
    descending: bool = False


def _by(ranking: Column | By) -> By:
    return ranking if isinstance(ranking, By) else By(ranking)


def tile_openings(
    df: DataFrame, rankings: Mapping[str, Column | By], n: int, id_col: str
) -> dict[str, list[tuple]]:
    """For each ranking the (key, id) of the first row of tiles 2 to n, in ranking order.

    Each ranking has a key column of its own, so keys keep their type; a row has the key of one ranking.
    ``id_col`` is unique and breaks ties in ascending order. With fewer than n rows the later tiles are
    empty and have no opening.
    """
    names, chosen = list(rankings), [_by(r) for r in rankings.values()]
    keys = [f"key{index}" for index in range(len(names))]
    stacked = df.select(
        F.col(id_col).alias("id"),
        *[by.key.alias(key) for key, by in zip(keys, chosen)],
        F.explode(F.array(*[F.lit(index) for index in range(len(names))])).alias("ranking"),
    ).withColumns({key: F.when(F.col("ranking") == index, F.col(key)) for index, key in enumerate(keys)})
    order = [
        F.col("ranking"),
        *[F.col(k).desc_nulls_last() if by.descending else F.col(k).asc_nulls_first() for k, by in zip(keys, chosen)],
        F.col("id"),
    ]
    ranked = durable(
        stacked.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    partition = F.shiftright("place", ROWS_PER_PARTITION_BITS)
    counts = (
        ranked.groupBy("ranking", partition.alias("part"))
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    places: dict[int, list[int]] = {}
    for index in range(len(names)):
        runs = sorted((row["part"], row["first"], row["rows"]) for row in counts if row["ranking"] == index)
        places[index] = _opening_places([(first, rows) for _, first, rows in runs], n)
    wanted = sorted({place for group in places.values() for place in group})
    found = {}
    if wanted:
        rows = ranked.where(F.col("place").isin(wanted)).select("place", "ranking", "id", *keys).collect()
        found = {row["place"]: (row[keys[row["ranking"]]], row["id"]) for row in rows}
    return {name: [found[place] for place in places[index]] for index, name in enumerate(names)}


def _opening_places(runs: list[tuple[int, int]], n: int) -> list[int]:
    """Places of the rows that open tiles 2 to n; the first total mod n tiles hold one row more."""
    total = sum(rows for _, rows in runs)
    size, extra = divmod(total, n)
    starts = [t * size + min(t, extra) for t in range(1, n)]
    places, before, pending = [], 0, [s for s in starts if s < total]
    for first, rows in runs:
        while pending and pending[0] < before + rows:
            places.append(first + pending.pop(0) - before)
        before += rows
    return places


def tile_number(ranking: Column | By, id_col: str, openings: list[tuple]) -> Column:
    """1 + how many openings lie at or before the row."""
    by, row_id = _by(ranking), F.col(id_col)
    unknown = by.key.isNull()
    tile = F.lit(1)
    for bound, bound_id in openings:
        from_id = row_id >= F.lit(bound_id)
        if bound is None:
            at_or_after = (unknown & from_id) if by.descending else (~unknown | from_id)
        else:
            beyond = by.key < F.lit(bound) if by.descending else by.key > F.lit(bound)
            known = beyond | ((by.key == F.lit(bound)) & from_id)
            at_or_after = F.coalesce(known, F.lit(by.descending))
        tile = tile + F.when(at_or_after, 1).otherwise(0)
    return tile


def ntile_global(df: DataFrame, rankings: Mapping[str, Column | By], n: int, id_col: str) -> DataFrame:
    """``df`` with one NTILE(n) column per ranking. Runs two small jobs to find the openings; ``df``
    should be a stored table or ``durable``, as it is read twice."""
    openings = tile_openings(df, rankings, n, id_col)
    return df.withColumns({name: tile_number(key, id_col, openings[name]) for name, key in rankings.items()})
