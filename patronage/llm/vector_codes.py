"""Vector code compression: integer codebooks of vector parts, refined over Hilbert-sorted flat blocks.

Each component becomes the integer floor(scale * x), and each vector is cut into equal consecutive parts. For each
part position the points of a chunk of vectors are sorted along a Hilbert curve and cut into flat blocks, each with the
box of its least and largest components and the sum of its points. In every round the distances between a block's box
and the codebook's entries tell which entries can be the nearest of any point in it: those no farther from the box than
the least of all entries' largest distances, ties included. A block with one entry left adds its stored sum; the others
compare their points with this shortlist only, in exact integers, ties to the lower index. Entries then move to the floor
of their points' mean; an entry without points stays. After the rounds each part is assigned once more.

Chunks are rows of up to CHUNK vectors, written once as a table with points, order, boxes and sums; a round is one pass
over it that returns one row of counts and sums for each task, part and entry. Only codebooks, 64 vectors in all, reach the driver
and the tasks. No vector is shuffled; rows of one label, however many, are only summed.

Defined results. Vectors that are null or hold null or non-finite components are dropped. Shorter vectors, the empty one
included, and lengths that do not divide into parts are filled up with zeros to the longest one. Of equal ids those with the lesser
vector start the codebook first, null ids come last; with fewer vectors than entries the codebook is smaller. Rows with null label are
one label. Integers beyond 2**20 in size raise an error, so that no distance or sum leaves 64 bits. Repeated rows
are vectors of their own. An empty table gives an empty result. Only the three columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import column_ref, ship, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a chunk, and points of a block.
CHUNK, BLOCK = 1 << 14, 64
#: Bytes of a chunk's integers at most, whatever the length of the vectors.
CHUNK_BYTES = 16 << 20
LIMIT = 1 << 20
#: Bits of a Hilbert number.
HILBERT_BITS = 60


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each component, with zeros up to the width."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat = np.floor(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > LIMIT:
        raise ValueError(f"a component times {SCALE} exceeds {LIMIT}")
    sizes = np.diff(at)
    wide = np.zeros((len(column), width), np.int32)
    wide[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)] = flat
    return wide


def hilbert(points: np.ndarray) -> np.ndarray:
    """Numbers of the points' cells along a Hilbert curve through their box. Of very many dimensions the first count."""
    points = points[:, :HILBERT_BITS].astype(np.int64)
    dimensions = points.shape[1]
    if not dimensions:
        return np.zeros(len(points), np.int64)
    bits = min(16, max(1, HILBERT_BITS // dimensions))
    span = int((points.max(0) - points.min(0)).max()) if len(points) else 0
    x = (points - points.min(0) if len(points) else points) >> max(0, span.bit_length() - bits)
    # From axes to the transposed number: undo the excess rotations from the high bit down, then Gray-encode.
    x = [np.ascontiguousarray(column) for column in x.T]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for k in range(dimensions):
            swap = np.where(x[k] & q, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(x[k] & q, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, dimensions):
        x[k] ^= x[k - 1]
    turn = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    number = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for column in x:
            number = (number << 1) | (((column ^ turn) >> level) & 1)
    return number


def flat_blocks(points: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of one part's points along the curve, and of each block the least and largest components and the sums."""
    order = np.argsort(hilbert(points), kind="stable").astype(np.int32)
    begin = np.arange(0, len(points), block)
    sorted_points = points[order]
    return order, np.minimum.reduceat(sorted_points, begin, 0), np.maximum.reduceat(sorted_points, begin, 0), np.add.reduceat(sorted_points.astype(np.int64), begin, 0)


def shortlists(least: np.ndarray, most: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """blocks x entries: whether an entry can be the nearest of a point in the block's box."""
    near = np.zeros((len(least), len(entries)), np.int64)
    far = near.copy()
    for k in range(least.shape[1]):
        below, above = least[:, k, None].astype(np.int64) - entries[:, k], entries[:, k] - most[:, k, None].astype(np.int64)
        near += np.maximum(np.maximum(below, above), 0) ** 2
        far += np.maximum(np.abs(below), np.abs(above)) ** 2
    return near <= far.min(1, keepdims=True)


def nearest(points: np.ndarray, block: int, listed: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted points the nearest entry, the lower index in a tie, and its squared distance, by the blocks' shortlists.

    Blocks with shortlists of about the same length are compared together, filled up with entries that never win.
    """
    found, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    counts = listed.sum(1)
    order = np.argsort(counts, kind="stable")
    for begin in range(0, len(order), 256):
        some = order[begin : begin + 256]
        some = some[np.argsort(some)]
        length = int(counts[some].max())
        names = np.argsort(~listed[some], axis=1, kind="stable")[:, :length]  # the listed ones first, ascending
        real = np.take_along_axis(listed[some], names, 1)
        where = some[:, None] * block + np.arange(block)
        inside = where < len(points)
        here = points[np.where(inside, where, 0)]
        total = np.zeros((len(some), block, length), np.int64)
        for k in range(points.shape[1]):
            apart = here[:, :, k, None].astype(np.int64) - entries[names, k][:, None, :]
            total += apart * apart
        total = np.where(real[:, None, :], total, np.iinfo(np.int64).max)
        best = total.argmin(2)
        found[where[inside]] = np.take_along_axis(names, best, 1)[inside]
        distance[where[inside]] = np.take_along_axis(total, best[:, :, None], 2)[:, :, 0][inside]
    return found, distance


def add_up(totals: np.ndarray, counts: np.ndarray, points: np.ndarray, block: int, boxes, sums: np.ndarray, entries: np.ndarray) -> None:
    """Adds the points of each entry, and their number, of one part: whole blocks where one entry is left."""
    listed = shortlists(*boxes, entries)
    single = listed.sum(1) == 1
    sizes = np.minimum(block, len(points) - np.arange(len(listed)) * block)
    only = listed.argmax(1)
    np.add.at(totals, only[single], sums[single])
    np.add.at(counts, only[single], sizes[single])
    open_ = np.flatnonzero(~single)
    if len(open_):
        # the open blocks' points one after another; only the last block of all may be shorter, and it stays last
        rows = (open_[:, None] * block + np.arange(block)).ravel()
        rows = rows[rows < len(points)]
        found, _ = nearest(points[rows], block, listed[open_], entries)
        counts += np.bincount(found, minlength=len(entries))
        for k in range(points.shape[1]):
            np.add.at(totals[:, k], found, points[rows, k].astype(np.int64))


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


BLOCKS = ("points", "ordering", "least", "most", "sums")


class Chunk:
    """One row of the chunk table: the points of each part in the order of the curve, and their blocks."""

    def __init__(self, batch: pa.RecordBatch, row: int, width: int, block: int):
        raw = {name: batch.column(name)[row].as_buffer() for name in BLOCKS}
        self.order = np.frombuffer(raw["ordering"], np.int32).reshape(PARTS, -1)
        n = self.order.shape[1]
        of = lambda name, kind, rows: np.frombuffer(raw[name], kind).reshape(PARTS, rows, width)
        self.points = of("points", np.int32, n)
        self.least, self.most, self.sums = (of(name, kind, -(-n // block)) for name, kind in zip(BLOCKS[2:], (np.int32, np.int32, np.int64)))


def chunked(rows: DataFrame, width: int, chunk: int, block: int) -> DataFrame:
    """The chunk table of (id, label number, vector) rows."""
    part_width = width // PARTS
    limit = max(1, min(chunk, CHUNK_BYTES // max(1, 4 * width)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            vectors = integers(whole.column("vector").combine_chunks(), width).reshape(len(whole), PARTS, part_width)
            orders, least, most, sums, points = [], [], [], [], []
            for part in range(PARTS):
                here = np.ascontiguousarray(vectors[:, part])
                order, low, high, total = flat_blocks(here, block)
                for held, value in zip((orders, least, most, sums, points), (order, low, high, total, here[order])):
                    held.append(packed(value))
            binary = [pa.array([b"".join(x)], pa.binary()) for x in (points, orders, least, most, sums)]
            ids = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column("id").combine_chunks())
            labels = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column("label").combine_chunks())
            return pa.RecordBatch.from_arrays([ids, labels, *binary], names=["ids", "labels", "points", "ordering", "least", "most", "sums"])

        count = 0
        for batch in batches:
            while len(batch):
                take = min(len(batch), limit - count)
                kept.append(batch.slice(0, take))
                batch, count = batch.slice(take), count + take
                if count == limit:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "vector").mapInArrow(
        make, f"ids array<bigint>, labels array<{kind}>, points binary, ordering binary, least binary, most binary, sums binary"
    )


def refine(chunks: DataFrame, codebooks: np.ndarray, block: int) -> np.ndarray:
    """One round: the codebooks (parts x entries x width) with each entry at the floor of its points' mean."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                chunk = Chunk(batch, row, width, block)
                for p in range(parts):
                    add_up(totals[p], counts[p], chunk.points[p], block, (chunk.least[p], chunk.most[p]), chunk.sums[p], codebooks[p])
        part, entry = np.nonzero(counts)
        if len(part):
            sums = pa.FixedSizeListArray.from_arrays(pa.array(totals[part, entry].ravel()), width).cast(pa.list_(pa.int64()))
            columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), sums]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    found = chunks.select(*BLOCKS).mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = codebooks.copy()
    spread = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    for r in spread.groupBy("part", "entry", "at").agg(wide("n"), wide("value")).collect():  # the codebooks' size
        out[r["part"], r["entry"], r["at"]] = int(r["value"]) // int(r["n"])
    return out


def encode(
    embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray]:
    """id, label, code (one byte a part) and error of each vector, and the codebooks (parts x entries x width)."""
    ship(embeddings.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = embeddings.select(column_ref(key).cast("long").alias("id"), column_ref(label).alias("label"), column_ref(vector).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & finite)
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow().column("vector").combine_chunks()
    start = integers(first, PARTS * width).reshape(len(first), PARTS, width)
    codebooks = np.ascontiguousarray(start.transpose(1, 0, 2)).astype(np.int64)
    kind = rows.schema["label"].dataType.simpleString()
    if not len(first):
        return rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), codebooks
    chunks = written(chunked(rows, PARTS * width, chunk, block))
    for _ in range(rounds if width else 0):
        codebooks = refine(chunks, codebooks, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, labels = (batch.column(name)[k].values for name in ("ids", "labels"))
                here = Chunk(batch, k, width, block)
                code, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p in range(PARTS):
                    listed = shortlists(here.least[p], here.most[p], codebooks[p])
                    found, distance = nearest(here.points[p], block, listed, codebooks[p])
                    code[here.order[p], p] = found
                    error[here.order[p]] += distance
                codes = pa.array([bytes(c) for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(error)], names=["id", "label", "code", "error"])

    return chunks.mapInArrow(run, f"id bigint, label {kind}, code binary, error bigint"), codebooks


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, codebooks = encode(table(spark, folder, "embeddings"))
    coded = written(coded)
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


OP13_SQL = r"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
w AS (SELECT max(len(v)) // 16 AS w FROM e),
points AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * w + 1 : part * w + w] AS x FROM e, w, (SELECT unnest(range(16)) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM points JOIN first USING (vec_id)),
a1 AS MATERIALIZED (
  SELECT vec_id, part, any_value(points.x) AS x, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT vec_id, part, points.x, entry, list_sum(list_transform(list_zip(points.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM points JOIN c0 USING (part)) AS points GROUP BY vec_id, part),
m1 AS (
  SELECT part, entry, list(v ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, CAST(floor(sum(x[pos]) / count(*)) AS BIGINT) AS v FROM a1, w, LATERAL (SELECT unnest(range(1, w + 1)) AS pos) GROUP BY ALL) GROUP BY ALL),
c1 AS MATERIALIZED (SELECT part, entry, coalesce(m1.c, c0.c) AS c FROM c0 LEFT JOIN m1 USING (part, entry)),
a2 AS MATERIALIZED (
  SELECT vec_id, part, any_value(points.x) AS x, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT vec_id, part, points.x, entry, list_sum(list_transform(list_zip(points.x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM points JOIN c1 USING (part)) AS points GROUP BY vec_id, part),
m2 AS (
  SELECT part, entry, list(v ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, CAST(floor(sum(x[pos]) / count(*)) AS BIGINT) AS v FROM a2, w, LATERAL (SELECT unnest(range(1, w + 1)) AS pos) GROUP BY ALL) GROUP BY ALL),
c2 AS MATERIALIZED (SELECT part, entry, coalesce(m2.c, c1.c) AS c FROM c1 LEFT JOIN m2 USING (part, entry)),
a3 AS (
  SELECT vec_id, label, part, min(d * 64 + entry) AS best FROM (
    SELECT vec_id, label, part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM points JOIN c2 USING (part)) GROUP BY vec_id, label, part),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(best % 64 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM coded
"""
