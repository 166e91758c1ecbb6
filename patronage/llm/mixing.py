"""Mixing sources to target weights: packed blocks, multinomial draws per shard, and index permutations.

The words of each source are packed, document after document in the order of a hash of the ids, into blocks of
`block_words`; only a source's last block may be shorter. Sources share `share_percent` of all words by their weights; no
target exceeds `most` times its source's words, and what that leaves goes to the others by weight. The mix has one slot
for each block a target takes. Slots are dealt to shards of `shard_slots`; each slot of a shard draws its source from
the targets' shares, so a shard's counts are multinomial. A source's slots are numbered through all shards; those drawn
beyond its target go, in order, to the sources drawn short, so that every source takes the whole words of its target.
Slot k of a source with N blocks is block k mod N of pass k div N, put through a pseudorandom permutation of the full
blocks of its own for each source and pass (swap-or-not: each round pairs an index with its mirror image and a hashed bit
says whether the two change places, which permutes any number of indexes without retries). A pass takes each block once,
so no word is taken more than `most` times; the last slot of a target may take the beginning of its block. Slots
then meet the documents' pieces by source and block.

Everything is SQL functions. Rows are narrow: texts are read once, for their sizes. Running sums go through buckets, so
that a source with any share of the rows is no single task's work; only the table of sources, a row each, is summed in
one task. All draws are hashes of `seed`, positions and ids: reruns agree, whatever the partitions.

Defined results. Words are runs of characters other than blank and \\x09-\\x0D. Null, empty and wordless texts have size 0,
are in no block and are taken 0 times. Rows without source are a source of their own, the last. Rows that repeat an id, and
rows without one, are documents of their own. Sources without words have target 0. Very long texts are cut into blocks like others.
An empty table gives an empty result. Only the three columns named are read, so others do not matter.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.llm.common import column_ref, table, written

WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
BLOCK_WORDS, SHARD_SLOTS = 512, 1024
#: Rounds of a permutation.
ROUNDS = 24
HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


@dataclasses.dataclass
class Mix:
    #: id, source, size, source_no, source_size, target and position (of the first word in its source) of each row
    documents: DataFrame
    #: source_no, source, size, weight, target and what follows from them
    sources: DataFrame
    #: shard, slot, source_no, pass, block, words
    slots: DataFrame
    #: shard, slot, at (word in the slot), source_no, position, id, first_word, n_words
    spans: DataFrame


def hashed(*parts) -> Column:
    """A number of 60 bits from the parts written with bars between them."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sums_before(df: DataFrame, group: str, bucket: str, order: Sequence, value: str, into: str) -> DataFrame:
    """Adds the sum of `value` over the rows before in each group. Buckets are in order, and no task sees more than one."""
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("__total"))
    bases = totals.select(
        F.col(group).alias("__group"), F.col(bucket).alias("__bucket"), F.coalesce(F.sum("__total").over(before(group).orderBy(bucket)), F.lit(0)).alias("__base")
    )
    inner = df.withColumn("__inner", F.coalesce(F.sum(value).over(before(group, bucket).orderBy(*order)), F.lit(0)))
    met = inner.join(bases, (F.col(group) == F.col("__group")) & (F.col(bucket) == F.col("__bucket")))
    return met.withColumn(into, F.col("__base") + F.col("__inner")).select(*df.columns, into)


def bucket_bits(rows: int) -> int:
    """Buckets number about the root of the rows, so that neither they nor the rows of one are many."""
    return rows.bit_length() // 2


def weighed(sources: DataFrame, weights: Sequence[int], share_percent: int, most: int) -> DataFrame:
    """Adds weight, target and takes, the target's whole words, to (source, size)."""
    spread = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("source_no", F.row_number().over(spread).cast("long") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    numbered = written(numbered.withColumn("weight", weight))
    total = numbered.agg(F.sum("size")).first()[0] or 0
    # The level above which weights are cut, as a fraction; it rises until no further source is cut.
    level, cut = (0, 1), -1
    capped = F.lit(False)
    while True:
        found = numbered.agg(
            F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("size"))).alias("size"), F.sum(F.when(~capped, F.col("weight"))).alias("weight")
        ).first()
        if found.n == cut or not found.weight:
            break
        cut, level = found.n, (share_percent * total - 100 * most * (found.size or 0), 100 * found.weight)
        wide = lambda c: c.cast("decimal(38,0)")
        capped = wide(F.col("weight")) * wide(F.lit(level[0])) > wide(F.col("size")) * wide(F.lit(most * level[1]))
    exact = F.when(capped, F.col("size") * most).otherwise(F.expr(f"weight * {level[0]} div {level[1]}"))
    target = F.when(capped, (F.col("size") * most).cast("double")).otherwise((F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1])))
    return numbered.withColumn("target", target).withColumn("takes", exact.cast("long"))


def in_cells(values: DataFrame, value: str, intervals: DataFrame, low: str, high: str, end: int, count: int) -> DataFrame:
    """Each row of `values` with the interval [low, high) its value is in. Intervals do not overlap and lie in [0, end)."""
    cells = max(1024, count)
    width = -(-end // cells)
    cell = F.explode(F.sequence(F.expr(f"{low} div {width}"), F.expr(f"({high} - 1) div {width}")))
    spread = intervals.where(F.col(low) < F.col(high)).withColumn("__cell", cell)
    met = values.withColumn("__cell", F.expr(f"{value} div {width}")).join(spread, "__cell")
    return met.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")


def permuted(index: Column, size: Column, keys: Column, *names: Column) -> Column:
    """The index at its place in the permutation of 0 to size - 1 that the names and keys (a number each round) tell."""

    def turn(x: Column, r: Column) -> Column:
        def choose(y: Column) -> Column:
            text = F.concat_ws("|", *names, r, F.greatest(x, y))
            return F.when(F.substring(F.md5(text.cast("binary")), 1, 1) < "8", y).otherwise(x)

        return F.get(F.transform(F.array(F.pmod(F.get(keys, r) - x, size)), choose), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, turn)


def mix(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT, most: int = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 1,
) -> Mix:
    spark, block = documents.sparkSession, block_words
    content = F.coalesce(column_ref(text), F.lit(""))
    rows = written(
        documents.select(
            column_ref(key).alias("id"),
            column_ref(source).alias("source"),
            F.regexp_count(content, F.lit(WORD)).cast("long").alias("size"),
            hashed(seed, "order", column_ref(key).cast("string")).alias("place"),
            F.xxhash64(content).alias("tie"),
        )
    )
    bits = bucket_bits(rows.count())
    sources = weighed(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share_percent, most)
    # Slots of each target: whole passes over the blocks, then blocks of one more, the last of these cut.
    full, rest = F.expr(f"size div {block}"), F.expr("takes % greatest(size, 1)")
    sources = (
        sources.withColumn("full", full)
        .withColumn("blocks", F.col("full") + F.expr(f"cast(size % {block} > 0 as long)"))
        .withColumn("rest", rest)
        .withColumn("quota", F.expr(f"(takes div greatest(size, 1)) * blocks + (rest + {block - 1}) div {block}"))
        .withColumn("high", F.sum("quota").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("low", F.col("high") - F.col("quota"))
        .withColumn(
            "keys",
            F.transform(
                F.sequence(F.lit(0), F.lit(most - 1)),
                lambda p: F.transform(
                    F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: hashed(seed, "key", F.col("source_no"), p, r) % F.greatest("full", F.lit(1))
                ),
            ),
        )
    )
    sources = written(sources)
    size = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("slots"), F.count("*").alias("sources")).first()

    known = sources.select(F.col("source").alias("__source"), "source_no", F.col("size").alias("source_size"), "target")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumn("bucket", F.shiftright("place", HASH_BITS - bits))
    placed = sums_before(placed, "source_no", "bucket", ["place", "id", "tie"], "size", "position")
    placed = written(placed.select("id", "source", "size", "source_no", "source_size", "target", "position"))

    slots = written(_slots(spark, sources, size.slots, size.sources, block, shard_slots, seed))
    first, last = F.expr(f"position div {block}"), F.expr(f"(position + size - 1) div {block}")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("position"), F.col("block") * block)
    pieces = pieces.select(
        "source_no", "block", "position", "id", (begin - F.col("block") * block).alias("at"), (begin - F.col("position")).alias("first_word"),
        (F.least(F.col("position") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("n"),
    )
    spans = slots.join(pieces, ["source_no", "block"]).withColumn("n_words", F.least("n", F.col("words") - F.col("at"))).where("n_words > 0")
    spans = spans.select("shard", "slot", "at", "source_no", "position", "id", "first_word", "n_words")
    return Mix(placed, sources, slots, spans)


def _slots(spark: SparkSession, sources: DataFrame, slots: int, count: int, block: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, source_no, pass, block and words of every slot."""
    drawn = spark.range(0, slots, 1, max(spark.sparkContext.defaultParallelism, slots >> 20)).withColumn("u", hashed(seed, "draw", F.col("id")) % max(slots, 1))
    drawn = in_cells(drawn, "u", sources.select("source_no", "low", "high"), "low", "high", slots, count)
    drawn = drawn.select("id", F.expr(f"id div {shard_slots}").alias("shard"), "source_no")
    # The multinomial counts of each shard, and where in its source's slots each shard begins.
    counts = drawn.groupBy("source_no", "shard").agg(F.count("*").alias("n")).withColumn("bucket", F.shiftright("shard", bucket_bits(slots // shard_slots)))
    counts = written(sums_before(counts, "source_no", "bucket", ["shard"], "n", "begin"))
    totals = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    known = sources.join(totals, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    over, short = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("over_low", F.sum(over).over(before) - over).withColumn("short_high", F.sum(short).over(before))
    known = written(known.withColumn("short_low", F.col("short_high") - short))
    moved = known.agg(F.max("short_high")).first()[0] or 0

    inside = F.row_number().over(Window.partitionBy("source_no", "shard").orderBy("id")) - 1
    numbered = drawn.withColumn("inside", inside).join(counts.select("source_no", "shard", "begin"), ["source_no", "shard"])
    numbered = numbered.select("id", "source_no", (F.col("begin") + F.col("inside")).alias("k"))
    numbered = numbered.join(known.select("source_no", "quota", "over_low"), "source_no")
    kept = numbered.where("k < quota").select("id", "source_no", "k")
    extra = numbered.where("k >= quota").select("id", (F.col("over_low") + F.col("k") - F.col("quota")).alias("e"))
    ends = known.select("source_no", "drawn", "short_low", "short_high")
    extra = in_cells(extra, "e", ends, "short_low", "short_high", max(moved, 1), count)
    extra = extra.select("id", "source_no", (F.col("drawn") + F.col("e") - F.col("short_low")).alias("k"))

    columns = ["source_no", "full", "blocks", "quota", "rest", "size", "keys"]
    met = kept.unionByName(extra).join(known.select(*columns), "source_no")
    met = met.withColumn("pass", F.expr("k div blocks")).withColumn("index", F.expr("k % blocks"))
    number = permuted(F.col("index"), F.col("full"), F.get("keys", F.col("pass").cast("int")), F.lit(seed), F.lit("swap"), F.col("source_no"), F.col("pass"))
    met = met.withColumn("block", F.when(F.col("index") < F.col("full"), number).otherwise(F.col("index")))
    whole = F.least(F.lit(block), F.col("size") - F.col("block") * block)
    cut = F.when((F.col("k") == F.col("quota") - 1) & (F.col("rest") > 0), (F.col("rest") - 1) % block + 1)
    return met.select(
        F.expr(f"id div {shard_slots}").alias("shard"), F.expr(f"id % {shard_slots}").alias("slot"), "source_no", "pass", "block",
        F.least(whole, cut).alias("words"),
    )


def texts(mixed: Mix, documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """shard, slot, text: each slot's words joined by one blank. Ids must be there and differ."""
    words = F.regexp_extract_all(column_ref(text), F.lit(f"({WORD})"), 1)
    split = documents.select(column_ref(key).alias("id"), words.alias("all"))
    met = mixed.spans.join(split, "id").select("shard", "slot", "at", F.slice("all", F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")).alias("some"))
    parts = F.array_sort(F.collect_list(F.struct("at", "some")))  # at most a block's words
    return met.groupBy("shard", "slot").agg(F.array_join(F.flatten(parts["some"]), " ").alias("text"))


def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    taken = mixed.spans.groupBy("source_no", "position").agg(F.sum("n_words").alias("taken"))
    # of the documents that begin at one position only the last has words
    with_words = mixed.documents.where("size > 0").join(taken, ["source_no", "position"], "left")
    columns = [F.col("id").alias("doc_id"), "size", "source_size", "target"]
    return with_words.select(*columns, F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(
        mixed.documents.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws('|', 1, 'order', doc_id)), 1, 15) AS BIGINT) AS place FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][source_no % 3 + 1] AS BIGINT) AS weight, sum(size) OVER () AS total FROM s),
f AS (  -- targets cut after each source, in the order of the level that cuts them
  SELECT *, row_number() OVER o AS place, coalesce(lead(size) OVER o, 1e18) / coalesce(lead(weight) OVER o, 1) AS next,
    CAST(150 * total - 200 * sum(size) OVER o AS BIGINT) AS num, CAST(100 * (sum(weight) OVER () - sum(weight) OVER o) AS BIGINT) AS den
  FROM w WINDOW o AS (ORDER BY size / weight, source_no)),
cuts AS (
  SELECT place, num, den, next FROM f WHERE den > 0
  UNION ALL SELECT 0, CAST(150 * any_value(total) AS BIGINT), CAST(100 * sum(weight) AS BIGINT), min(size / weight) FROM w),
level AS (SELECT place AS cut, num, den FROM cuts WHERE num / den <= 2 * next ORDER BY place LIMIT 1),
t AS (
  SELECT source, source_no, size, f.place <= cut AS capped, CASE WHEN f.place <= cut THEN CAST(2 * size AS DOUBLE) ELSE CAST(weight * level.num AS DOUBLE) / level.den END AS target,
    CASE WHEN f.place <= cut THEN 2 * size ELSE weight * level.num // level.den END AS takes
  FROM f, level),
q AS (
  SELECT *, size // 512 AS whole, (size + 511) // 512 AS blocks, takes % greatest(size, 1) AS rest FROM t),
quotas AS (SELECT *, takes // greatest(size, 1) * blocks + (rest + 511) // 512 AS quota FROM q),
p AS MATERIALIZED (
  SELECT *, CAST(sum(quota) OVER (ORDER BY source_no) AS BIGINT) AS high, CAST(sum(quota) OVER (ORDER BY source_no) AS BIGINT) - quota AS low, CAST(sum(quota) OVER () AS BIGINT) AS slots
  FROM quotas),
draws AS (
  SELECT i, CAST('0x' || substr(md5(concat_ws('|', 1, 'draw', i)), 1, 15) AS BIGINT) % (SELECT max(slots) FROM p) AS u
  FROM (SELECT unnest(range((SELECT max(slots) FROM p))) AS i)),
drawn AS MATERIALIZED (
  SELECT i, source_no, quota, row_number() OVER (PARTITION BY source_no ORDER BY i) - 1 AS k FROM draws JOIN p ON u >= low AND u < high),
extra AS (SELECT i, row_number() OVER (ORDER BY source_no, k) - 1 AS e FROM drawn WHERE k >= quota),
missing AS (
  SELECT source_no, k, row_number() OVER (ORDER BY source_no, k) - 1 AS e
  FROM (SELECT source_no, unnest(range(n, quota)) AS k FROM (
    SELECT p.source_no, p.quota, count(i) AS n FROM p LEFT JOIN drawn USING (source_no) GROUP BY p.source_no, p.quota))),
dealt AS (
  SELECT i, source_no, k FROM drawn WHERE k < quota UNION ALL SELECT i, source_no, k FROM extra JOIN missing USING (e)),
numbered AS (
  SELECT source_no, k, whole, size, quota, rest, k // blocks AS pass, k % blocks AS x FROM dealt JOIN p USING (source_no)),
keyed AS (
  SELECT *, list_transform(range(24), lambda r: CAST('0x' || substr(md5(concat_ws('|', 1, 'key', source_no, pass, r)), 1, 15) AS BIGINT) % greatest(whole, 1)) AS keys FROM numbered),
blocks AS (
  SELECT *, CASE WHEN x >= whole THEN x ELSE list_reduce(list_concat([x], range(24)), lambda v, r:
    CASE WHEN substr(md5(concat_ws('|', 1, 'swap', source_no, pass, r, greatest(v, ((keys[r + 1] - v) % whole + whole) % whole))), 1, 1) < '8'
      THEN ((keys[r + 1] - v) % whole + whole) % whole ELSE v END) END AS b
  FROM keyed),
slots AS (
  SELECT source_no, b * 512 AS first, b * 512 + least(512, size - b * 512, CASE WHEN k = quota - 1 AND rest > 0 THEN (rest - 1) % 512 + 1 ELSE 512 END) AS last FROM blocks),
placed AS (
  SELECT doc_id, d.size, source_no, p.size AS source_size, target, CAST(sum(d.size) OVER (PARTITION BY source_no ORDER BY place, doc_id) AS BIGINT) - d.size AS "begin"
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT doc_id, CAST(sum(least("begin" + size, last) - greatest("begin", first)) AS BIGINT) AS taken
  FROM placed JOIN slots USING (source_no) WHERE first < "begin" + size AND "begin" < last GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (doc_id)
"""
