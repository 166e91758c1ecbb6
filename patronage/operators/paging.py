"""Pages of a table in the order of its key, all of them from one sort.

Asking for the rows after the last key again and again reads the table once for every page. Here the rows are dealt by
ranges of the key and sorted within these once, and a page's number follows from a row's place in its range and the
rows of the ranges before it. The driver sees one count for each range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.operators.ntile import ROWS_PER_PARTITION_BITS
from patronage.sources.durable import scratch_path

PLACE, FIRST = "__place", "__first"
#: Pages whose ends a reader of one page after the other is ahead at most.
AHEAD = 1000


@dataclass
class Pages:
    """The sorted rows with their places, and each range's first place and number of rows, in order."""

    rows: DataFrame
    ranges: list[tuple[int, int]]
    size: int

    @property
    def total(self) -> int:
        return sum(n for _, n in self.ranges)

    @property
    def count(self) -> int:
        return -(-self.total // self.size)

    def numbered(self, first: int = 0, into: str = "page", of: range | None = None) -> DataFrame:
        """All rows, or those of some pages that follow one another, with the number of their page; ``first`` is page 0's."""
        rows = self.rows if of is None else self._between(of.start * self.size, of.stop * self.size)
        page = F.expr(f"{first} + `{PLACE}` div {self.size}")
        return with_row_numbers(rows, self.ranges, PLACE).withColumn(into, page).drop(PLACE)

    def page(self, number: int) -> DataFrame:
        """The rows of one page, in the order of the key within each file; its places are a range that files are pruned by."""
        return self._between(number * self.size, (number + 1) * self.size).drop(PLACE)

    def _between(self, begin: int, end: int) -> DataFrame:
        """The rows from one number to before another, counted in the order of the key."""
        end = min(end, self.total)
        if begin >= end:
            return self.rows.where(F.lit(False))
        return self.rows.where(F.col(PLACE).between(place_of(self.ranges, begin), place_of(self.ranges, end - 1)))


def with_row_numbers(rows: DataFrame, ranges: list[tuple[int, int]], *places: str) -> DataFrame:
    """``rows`` with the numbers of rows, from 0, in place of their places, which lie in one range for each row."""
    before, offsets = 0, []
    for place, n in ranges:
        offsets.append((place >> ROWS_PER_PARTITION_BITS, before - place))
        before += n
    of = rows.sparkSession.createDataFrame(offsets, "__range bigint, __offset bigint")  # a row for each range
    placed = rows.withColumn("__range", F.shiftright(places[0], ROWS_PER_PARTITION_BITS)).join(F.broadcast(of), "__range")
    return placed.withColumns({p: F.col(p) + F.col("__offset") for p in places}).drop("__range", "__offset")


def place_of(ranges: list[tuple[int, int]], number: int) -> int:
    """The place of the row with that number, from 0, in the order of the key."""
    for place, n in ranges:
        if number < n:
            return place + number
        number -= n
    raise IndexError("there are fewer rows")


def pages(df: DataFrame, key: str, size: int) -> Pages:
    """``df`` in pages of ``size`` rows by a key that no two rows share; a null key comes first. Written once, in the shared folder."""
    if size < 1:
        raise ValueError("a page has at least one row")
    order, spark = F.col(key).asc_nulls_first(), df.sparkSession
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn(PLACE, F.monotonically_increasing_id())
    path = scratch_path(spark)
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    found = rows.groupBy(F.shiftright(PLACE, ROWS_PER_PARTITION_BITS).alias("range")).agg(F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("rows"))
    return Pages(rows, [(r["first"], r["rows"]) for r in sorted(found.collect(), key=lambda r: r["range"])], size)


class KeyOrder:
    """The keys of a table, grouped and sorted once, for readers that ask for one page after the other by the last key they saw.

    Asking the table itself sorts all that is left of it for every page. Here each key has the places of its first and last row,
    and the ends of the next pages are read ahead: of twice as many pages each time the reader gets that far, up to ``AHEAD``.
    Keys may repeat: rows of the key that ended a page are on no other page, as with ``merge.keyset_page``, and pages are read
    ahead up to such a key only. A null key is on no page. Written once, in the shared folder.
    """

    def __init__(self, df: DataFrame, key: str):
        spark, self.key = df.sparkSession, key
        counted = df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
        dealt = counted.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id().cast("long"))
        so_far = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.shiftleft("__range", ROWS_PER_PARTITION_BITS) + F.sum("__rows").over(so_far)
        placed = dealt.select(key, (upto - F.col("__rows")).alias(FIRST), (upto - 1).alias(PLACE))
        path = scratch_path(spark)
        placed.write.parquet(path)
        self.keys = spark.read.schema(placed.schema).parquet(path)
        found = self.keys.groupBy(F.shiftright(PLACE, ROWS_PER_PARTITION_BITS).alias("range")).agg(F.min(FIRST).alias("first"), F.max(PLACE).alias("last"))
        self.ranges = [(r["first"], r["last"] - r["first"] + 1) for r in sorted(found.collect(), key=lambda r: r["range"])]
        self.total = sum(n for _, n in self.ranges)
        self._asked, self._begin, self._depth = None, 0, 1  # what is asked next if pages are read in order, and its first row's number
        self._ends: list[tuple[object, int]] = []  # last keys of the pages ahead, in order, with the numbers of the rows after them

    def end_after(self, last: object, size: int) -> object:
        """The last key of the page of ``size`` rows after ``last``, or None when nothing is left."""
        if size < 1:
            raise ValueError("a page has at least one row")
        if (last, size) != self._asked:
            self._begin, self._depth, self._ends = self._first_after(last), 1, []
        if not self._ends:
            if self._begin >= self.total:
                self._asked = None
                return None
            self._ends = self._read(self._begin, size)
        end, self._begin = self._ends.pop(0)
        self._asked = (end, size)
        return end

    def _first_after(self, last: object) -> int:
        place, before = self.keys.where(after(self.key, last)).agg(F.min(FIRST)).first()[0], 0
        for first, n in self.ranges:
            if place is not None and first <= place < first + n:
                return before + place - first
            before += n
        return before

    def _read(self, begin: int, size: int) -> list[tuple[object, int]]:
        """Ends of the pages from a row on. They are the keys that hold every ``size``-th row, up to the first one with more rows."""
        end = min(begin + self._depth * size, self.total)
        near = self.keys.where((F.col(PLACE) >= place_of(self.ranges, begin)) & (F.col(FIRST) <= place_of(self.ranges, end - 1)))
        holds = F.expr(f"(`{PLACE}` + 1 - {begin}) div {size} > (`{FIRST}` - {begin}) div {size}") | (F.col(PLACE) == self.total - 1)
        found = with_row_numbers(near, self.ranges, PLACE, FIRST).where(holds).select(self.key, PLACE).collect()  # AHEAD rows at most
        ends: list[tuple[object, int]] = []
        for key, row in sorted(found, key=lambda r: r[1]):
            ends.append((key, row + 1))
            if row + 1 != min(begin + len(ends) * size, self.total):
                self._depth = 1
                return ends
        self._depth = min(2 * self._depth, AHEAD)
        return ends


def after(key: str, last: object) -> Column:
    """Rows beyond the last key written."""
    return F.col(key) > F.lit(last)
