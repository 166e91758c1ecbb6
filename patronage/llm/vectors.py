"""Embedding near-duplicates with inverted lists and product quantisation.

Equal vectors of one label are one class, with its number of rows. A sample of classes fits coarse centroids and, on the
residuals, a codebook for each subspace; then every class is indexed: its nearest list, its residual codes and the length
of what the codes leave out. Each class also queries: it visits its own list and all lists whose border it is close to.
In a list the codes' distances to a query come from its lookup tables; a member stays a candidate unless that distance,
less what its code leaves out, exceeds the threshold's, so codes lose no link; candidates get their cosine in double
precision. Lists are split into blocks, and every block of queries meets every block of members in a task of its own,
which returns counts and a spanning forest instead of pairs.

A list is visited if the query is within the margin of the plane between its own centroid and that list's. A vector at
the threshold's distance r in no special direction crosses a plane that is farther than `reach` times r / sqrt(dimension)
away with probability below 1e-4 (reach 4); at r the margin is exact.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components, rows with null label and rows
with null id link with nothing: no links, their own id as component, kept. Vectors of different length are not compared.
Repeated rows are vectors of their own that link with each other; the id of a class is its smallest id. An empty table
gives an empty result. Only the three columns named are read.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import column_ref, ship, table, written
from patronage.llm.components import components

MIN_COSINE = 0.93
#: Classes that fit the index, those with the smallest hash of their id. All classes are indexed.
SAMPLE = 20_000
#: Lists: one for each MEMBERS_PER_ROOT times the root of the number of classes.
MEMBERS_PER_ROOT = 8
MAX_LISTS = 4096
SUBSPACES = 8
CODEWORDS = 32
REACH = 4.0
#: Queries and members of one task's meeting.
BLOCK = 2048


@dataclasses.dataclass
class Index:
    centroids: np.ndarray  # lists x dimension
    codebooks: np.ndarray  # subspaces x codewords x width
    radius: float  # distance of unit vectors at the smallest cosine
    margin: float

    @property
    def width(self) -> int:
        return self.codebooks.shape[0] * self.codebooks.shape[2]


def _k_means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


def unit(vectors: np.ndarray, width: int) -> np.ndarray:
    """Float vectors of length one, with zeros up to the width."""
    wide = np.zeros((len(vectors), width), np.float32)
    for k, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        v = v / np.abs(v).max()
        wide[k, : len(v)] = v / np.sqrt((v * v).sum())
    return wide


def fit(vectors: np.ndarray, lists: int, min_cosine: float, reach: float, seed: int = 1) -> Index:
    """Fits the index on unit vectors whose width is a multiple of the subspaces."""
    rng = np.random.default_rng(seed)
    width = vectors.shape[1]
    centroids = _k_means(vectors, lists, 8, rng)
    rest = (vectors - centroids[_nearest(vectors, centroids)]).reshape(len(vectors), SUBSPACES, -1)
    words = min(CODEWORDS, len(vectors))
    codebooks = np.stack([_k_means(rest[:, s].copy(), words, 8, rng) for s in range(SUBSPACES)])
    radius = float(np.sqrt(2 - 2 * min_cosine)) + 1e-4
    return Index(centroids, codebooks, radius, min(radius, reach * radius / np.sqrt(width)))


def place(index: Index, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest list, residual codes and the length of what the codes leave out."""
    nearest = _nearest(vectors, index.centroids)
    rest = (vectors - index.centroids[nearest]).reshape(len(vectors), SUBSPACES, -1)
    codes = np.stack([_nearest(rest[:, s], index.codebooks[s]) for s in range(SUBSPACES)], 1).astype(np.uint8)
    left = rest - np.stack([index.codebooks[s][codes[:, s]] for s in range(SUBSPACES)], 1)
    return nearest, codes, np.sqrt((left**2).sum((1, 2)))


def probes(index: Index, vectors: np.ndarray) -> np.ndarray:
    """Which lists each vector visits, as a boolean matrix."""
    centres = index.centroids.astype(np.float64)
    squares = (centres**2).sum(1)
    far = squares[None, :] - 2 * vectors.astype(np.float64) @ centres.T
    own = far.argmin(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * centres @ centres.T, 0))
    return far - far.min(1, keepdims=True) <= 2 * index.margin * apart[own] + 1e-9


def table_distances(index: Index, queries: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
    """Distances of queries to the coded members of one list, by sums from the queries' lookup tables."""
    rest = (queries - index.centroids[which]).reshape(len(queries), SUBSPACES, -1)
    total = np.zeros((len(queries), len(codes)), np.float32)
    for s in range(SUBSPACES):
        words = index.codebooks[s]
        lookup = (rest[:, s] ** 2).sum(1)[:, None] + (words**2).sum(1)[None, :] - 2 * rest[:, s] @ words.T
        total += lookup[:, codes[:, s]]
    return np.sqrt(np.maximum(total, 0))


def links_between(index: Index, which: int, queries: np.ndarray, members: np.ndarray, codes: np.ndarray, left: np.ndarray, exact, min_cosine: float) -> np.ndarray:
    """Boolean matrix of queries and members with at least that cosine. exact: both sides' raw vectors."""
    linked = np.zeros((len(queries), len(members)), bool)
    raw_queries, raw_members = exact
    for begin in range(0, len(queries), 256):
        rows = slice(begin, begin + 256)
        near = table_distances(index, queries[rows], codes, which) <= index.radius + left[None, :] + 1e-3
        columns = np.flatnonzero(near.any(0))
        if len(columns):
            q, m = raw_queries[rows], raw_members[columns]
            cosine = (q @ m.T) / np.sqrt((q * q).sum(1)[:, None] * (m * m).sum(1)[None, :])
            linked[rows, columns] = near[:, columns] & (cosine >= min_cosine)
    return linked


def spanning(linked: np.ndarray, query_ids: np.ndarray, member_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and member the smallest id it reaches through the matrix; its own without a link."""
    most = np.iinfo(np.int64).max
    of_queries, of_members = query_ids.copy(), member_ids.copy()
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    inner = linked[np.ix_(rows, columns)]
    while len(rows):
        down = np.minimum(of_members[columns], np.where(inner, of_queries[rows][:, None], most).min(0))
        across = np.minimum(of_queries[rows], np.where(inner, down[None, :], most).min(1))
        if (down == of_members[columns]).all() and (across == of_queries[rows]).all():
            break
        of_members[columns], of_queries[rows] = down, across
    return of_queries, of_members


def _lists_of(column, width: int) -> np.ndarray:
    """Rows of a list column with zeros up to the width, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(at)
    wide = np.zeros((len(column), width))
    wide[np.repeat(np.arange(len(sizes)), sizes), np.arange(at[0], at[-1]) - np.repeat(at[:-1], sizes)] = flat[at[0] : at[-1]]
    return wide


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return (scaled / np.sqrt((scaled**2).sum(1, keepdims=True))).astype(np.float32)


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Raw vectors scaled by powers of two, which is exact, so that no square overflows or vanishes."""
    return raw * np.exp2(-np.floor(np.log2(np.abs(raw).max(1, keepdims=True))))


def classes_of(rows: DataFrame) -> DataFrame:
    """Equal vectors of a label: class (the smallest id), number of rows and the vector."""
    return rows.groupBy("label", "vector").agg(F.min("id").alias("class"), F.count("*").alias("rows"))


def near_duplicates(
    embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    min_cosine: float = MIN_COSINE, sample: int = SAMPLE, reach: float = REACH, block: int = BLOCK, lists: int | None = None,
) -> DataFrame:
    """id, n_links (other vectors linked directly), component_id (the smallest id reachable), kept."""
    spark = embeddings.sparkSession
    ship(spark)
    single = embeddings.schema[vector].dataType.simpleString() == "array<float>"  # half as much to move, and as exact
    vectors_are = "array<float>" if single else "array<double>"
    rows = embeddings.select(
        column_ref(key).cast("long").alias("id"), column_ref(vector).cast(vectors_are).alias("vector"), column_ref(label).alias("label")
    )
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    valid = rows.where("usable")
    classes = written(classes_of(valid))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not size.n:
        alone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
        return rows.select("id", *alone)
    width = -(-size.d // SUBSPACES) * SUBSPACES
    wanted = lists or max(1, min(MAX_LISTS, round(size.n**0.5 / MEMBERS_PER_ROOT)))
    chosen = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("vector").toArrow()
    index = fit(_unit(_lists_of(chosen.column("vector"), width)), wanted, min_cosine, reach)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _unit(_lists_of(batch.column("vector"), width))
            nearest, codes, left = place(index, vectors)
            visits = [np.flatnonzero(v).astype(np.int32) for v in probes(index, vectors)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("label", "class", "rows", "vector")]
                + [pa.array(nearest, pa.int32()), pa.array([bytes(c) for c in codes], pa.binary()), pa.array(left, pa.float32()), pa.array(visits, pa.list_(pa.int32()))],
                names=["label", "class", "rows", "vector", "list", "code", "left_out", "visits"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    indexed = written(
        classes.select("label", "class", "rows", "vector").mapInArrow(
            enter,
            f"label {kind}, class bigint, rows bigint, vector {vectors_are}, list int, code binary, left_out float, visits array<int>",
        )
    )
    visiting = indexed.select("label", "class", "rows", "vector", F.explode("visits").alias("list"))
    # Blocks of members and queries in each list, from their counts.
    cell = ["label", F.size("vector").alias("length"), "list"]
    members = indexed.select(*cell, "class", "rows", "vector", "code", "left_out", F.lit(False).alias("asks"))
    queries = visiting.select(*cell, "class", "rows", "vector", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("left_out"), F.lit(True).alias("asks"))
    cell = ["label", "length", "list"]
    both = members.unionByName(queries)
    counts = both.groupBy(*cell).agg(F.count_if("asks").alias("q"), F.count_if(~F.col("asks")).alias("m"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    # a table of lists, so that Spark knows its size and need not shuffle the vectors to join it where it is small
    sizes = written(counts.where("q > 0 and m > 0").select(*cell, blocks("q").alias("q"), blocks("m").alias("m")))
    own = F.pmod(F.xxhash64("class"), F.when(F.col("asks"), F.col("q")).otherwise(F.col("m"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("asks"), F.col("m")).otherwise(F.col("q")) - 1))
    dealt = both.join(sizes, cell).withColumn("own", own).withColumn("other", others)
    dealt = dealt.withColumn("qb", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))).withColumn(
        "mb", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))
    )

    def meet(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        ids, numbers = group.column("class").to_numpy(), group.column("rows").to_numpy()
        raw = _scaled(_lists_of(group.column("vector"), width))
        vectors = _unit(raw)
        out = {"class": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)}
        if len(q) and len(m):
            codes = np.frombuffer(b"".join(group.column("code").take(m).to_pylist()), np.uint8).reshape(len(m), SUBSPACES)
            left = group.column("left_out").take(m).to_numpy().astype(np.float32)
            which = group.column("list")[0].as_py()
            linked = links_between(index, which, vectors[q], vectors[m], codes, left, (raw[q], raw[m]), min_cosine)
            linked &= ids[q][:, None] != ids[m][None, :]
            of_queries, of_members = spanning(linked, ids[q], ids[m])
            some, found = linked.any(1), linked.any(0)
            out = {
                "class": np.concatenate((ids[q][some], ids[m][found])),
                "links": np.concatenate(((linked @ numbers[m])[some], np.zeros(int(found.sum()), np.int64))),
                "root": np.concatenate((of_queries[some], of_members[found])),
            }
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    met = written(dealt.drop("q", "m", "own", "other").groupBy(*cell, "qb", "mb").applyInArrow(meet, "class bigint, links bigint, root bigint"))
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(met.select("class", "root")).select(F.col("node").alias("class"), "root")
    known = classes.join(links, "class", "left").join(roots, "class", "left").select(
        "label", "vector", "rows", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "class").alias("component_id")
    )
    compared = valid.join(known, ["label", "vector"]).select("id", (F.col("links") + F.col("rows") - 1).alias("n_links"), "component_id")
    rest = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = compared.unionByName(rest)
    return result.select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


OP10_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
