"""Periodic runs, the mix of sources and vector codes: brute force, and the cases every operator defines."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import mixing, runs, vector_codes

LONG = " ".join(f"word{k % 7919}" for k in range(60_000))
ALIKE = "on " * 30_000


def plain_runs(words, min_length, min_repeats):
    """Each period by itself: maximal stretches of equal words that far apart, if no smaller period fits them."""
    out = []
    for q in range(1, len(words) // min_repeats + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i + q - start
            if i > start and size >= max(min_length, min_repeats * q):
                part = words[start : start + size]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((start, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_length", "min_repeats"), [(24, 3), (6, 2), (1, 2), (10, 4)])
def test_runs_equal_brute_force(min_length, min_repeats):
    rng = np.random.default_rng(min_length)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(0, 5)):
            words = []
            for _ in range(rng.integers(0, 5)):
                unit = rng.integers(0, rng.integers(1, 4), rng.integers(1, 12)).tolist()
                words += (unit * int(rng.integers(1, 9)))[: int(rng.integers(1, 80))]
            texts.append(words)
        flat = np.array([w for t in texts for w in t], np.int64)
        found = runs.runs_of(flat, np.array([len(t) for t in texts], np.int64), min_length, min_repeats)
        assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t, min_length, min_repeats)]


def test_run_sets_keep_their_order():
    rng = np.random.default_rng(1)
    members = rng.permutation(5000).tolist()
    held, seen = runs.Positions(members[0]), {members[0]}
    for x in members[1:]:
        before, after = held.neighbours(x)
        if len(seen) < 200:
            assert before == max((s for s in seen if s < x), default=None) and after == min((s for s in seen if s > x), default=None)
        held.add(x)
        seen.add(x)
    assert list(held) == list(range(5000)) and held.size == 5000


def test_runs_defined_cases(spark):
    run = " ".join(["a b c"] * 10)
    rows = [(1, f"x {run} y"), (1, f"x {run} y"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, ALIKE), (None, run), (7, "a b " * 24)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("kept")).withColumn("a.b", F.lit(2))
    found = runs.find_runs(df)
    assert found.columns == ["doc_id", "text", "start", "a.b", "runs", "collapsed"] and {r.start for r in found.collect()} == {"kept"}
    got = {}
    for r in found.select("doc_id", "runs", "collapsed").collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == [([(1, 30, 3)], "x a b c y")] * 2
    assert got[2] == got[3] == got[4] == [([], "")]
    assert got[5] == [([(0, 60_000, 7919)], " ".join(LONG.split()[:7919]))]
    assert got[6] == [([(0, 30_000, 1)], "on")]
    assert got[None] == [([(0, 30, 3)], "a b c")]
    assert got[7] == [([(0, 24, 1)], "a b")]
    assert runs.find_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(df, min_repeats=1)


def plain_targets(sizes, weights, percent, most):
    """Shares by weight, cut where they exceed the most, the excess shared again among the others."""
    left, open_ = percent * sum(sizes) / 100, set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        whole = sum(weights[k % len(weights)] for k in open_)
        cut = {k for k in open_ if left * weights[k % len(weights)] / whole > most * sizes[k] + 1e-9}
        if not cut:
            for k in open_:
                targets[k] = left * weights[k % len(weights)] / whole
            break
        for k in cut:
            targets[k] = most * sizes[k]
            left -= targets[k]
        open_ -= cut
    return targets


@pytest.mark.parametrize("sizes", [[900, 20, 3000], [5, 5, 5, 5, 5, 5, 5], [0, 100, 0, 4000, 17], [1], [0, 0], [70_000, 3, 900, 12_000]])
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame([(chr(97 + k), s) for k, s in enumerate(sizes)], "source string, size bigint")
    got = {r.source: r for r in mixing.weighed(df, (5, 2, 1), 150, 2).collect()}
    for k, want in enumerate(plain_targets(sizes, (5, 2, 1), 150, 2)):
        assert math.isclose(got[chr(97 + k)].target, want, rel_tol=1e-12, abs_tol=1e-9)
        assert got[chr(97 + k)].takes == math.floor(want + 1e-9)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_permutations_are_whole_and_differ(spark, size):
    keys = F.array(*[mixing.hashed("k", r) % size for r in range(mixing.ROUNDS)])
    place = lambda name: mixing.permuted(F.col("id"), F.lit(size).cast("long"), keys, F.lit(name))
    rows = spark.range(size).select(place("x").alias("x"), place("y").alias("y")).collect()
    assert sorted(r.x for r in rows) == sorted(r.y for r in rows) == list(range(size))
    if size >= 64:
        assert sum(r.x == r.y for r in rows) < size / 8 and sum(r.x == k for k, r in enumerate(rows)) < size / 8


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(4)
    sources = ["b", "a", None, "\U0001f600", "hot", "hot", "hot"]
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(int(rng.integers(0, 60)))), sources[k % 7]) for k in range(700)]
    rows += [(3, "again", "a"), (3, "again", "a"), (None, "no id here", "b"), (None, "no id here", "b"), (9000, None, "a"), (9001, "", None), (9002, " \n ", "new")]
    rows += [(9003, LONG, "long")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("x")).withColumn("position", F.lit("y"))
    return df.repartition(5), mixing.mix(df, block_words=64, shard_slots=16)


def test_mix_takes_its_targets(spark, mixed):
    df, found = mixed
    spans = found.spans.collect()
    taken: dict = {}
    for s in spans:
        taken[s.source_no] = taken.get(s.source_no, 0) + s.n_words
    sources = found.sources.collect()
    assert [s.source for s in sorted(sources, key=lambda s: s.source_no)] == ["a", "b", "hot", "long", "new", "\U0001f600", None]
    for s in sources:
        assert taken.get(s.source_no, 0) == s.takes and abs(s.takes - s.target) < 1
    rows = found.documents.collect()
    assert len(rows) == 708 and sum(r.size for r in rows) * 1.5 == pytest.approx(sum(s.target for s in sources))
    by_row: dict = {}
    for s in spans:
        by_row[s.source_no, s.position] = by_row.get((s.source_no, s.position), 0) + s.n_words
    assert all(by_row.get((r.source_no, r.position), 0) <= 2 * r.size for r in rows if r.size)
    # every slot is filled once, from its first word on, without a gap
    slots: dict = {}
    for s in spans:
        slots.setdefault((s.shard, s.slot), []).append((s.at, s.n_words))
    words = {(s.shard, s.slot): s.words for s in found.slots.collect()}
    assert slots.keys() == words.keys() and max(words.values()) == 64 and max(k[1] for k in words) == 15
    for place, parts in slots.items():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends == words[place]
    shards = {k[0] for k in words}
    assert len({tuple(sorted(s.source_no for s in found.slots.collect() if s.shard == x)) for x in shards}) > 1  # draws differ


def test_mix_again_is_the_same_and_empty_is_empty(spark, mixed):
    df, found = mixed
    again = mixing.mix(df.repartition(11), block_words=64, shard_slots=16)
    key = lambda m: sorted(map(repr, m.spans.collect()))
    assert key(found) == key(again)
    empty = mixing.mix(df.where("false"))
    assert empty.documents.count() == empty.spans.count() == empty.slots.count() == 0
    wordless = mixing.mix(df.where("doc_id in (9000, 9001, 9002)"))
    assert wordless.spans.count() == 0 and {r.target for r in wordless.documents.collect()} == {0.0}


def test_mix_texts_are_the_spans_words(spark, mixed):
    df, found = mixed
    single = df.where("doc_id is not null and doc_id not in (3)")
    texts = {r.doc_id: (r.text or "").split() for r in single.collect()}
    got = {(r.shard, r.slot): r.text for r in mixing.texts(found, single).collect()}
    want: dict = {}
    for s in sorted(found.spans.collect(), key=lambda s: s.at):
        if s.id in texts:
            want.setdefault((s.shard, s.slot), []).extend(texts[s.id][s.first_word : s.first_word + s.n_words])
    assert got == {k: " ".join(v) for k, v in want.items()}


def test_mix_runs_no_python(spark):
    found = mixing.op12_source_mix(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Arrow", "Pandas", "ExistingRDD", "CartesianProduct", "BroadcastNestedLoopJoin") if node in plan]


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 5), (3, 3), (4, 2)])
def test_hilbert_neighbours_are_next_to_each_other(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    numbers = vector_codes.hilbert(grid)
    assert len(np.unique(numbers)) == len(grid)
    assert (np.abs(np.diff(grid[np.argsort(numbers)], axis=0)).sum(1) == 1).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) that are whole. Codes, errors and codebooks by comparing all with all."""
    longest = max(len(v) for _, v, _ in rows)
    width = -(-longest // parts)
    points = np.array([[math.floor(256 * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in rows]).reshape(len(rows), parts, width)
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [points[first, p].copy() for p in range(parts)]
    apart = lambda p: ((points[:, p, None, :] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            to = apart(p).argmin(1)
            for e in set(to.tolist()):
                books[p][e] = points[to == e, p].sum(0) // (to == e).sum()
    codes = np.stack([apart(p).argmin(1) for p in range(parts)], 1)
    errors = sum(apart(p).min(1) for p in range(parts))
    return codes, errors, books


@pytest.mark.parametrize(("n", "width", "spread", "block", "chunk"), [(400, 64, 0.3, 16, 150), (300, 32, 0.02, 8, 1000), (40, 48, 1.0, 64, 7), (500, 16, 0.01, 4, 64), (90, 40, 0.5, 16, 30)])
def test_codes_equal_brute_force(spark, n, width, spread, block, chunk):
    rng = np.random.default_rng(n)
    vectors = (np.round(rng.standard_normal((n, width)) * spread * 64) / 64).tolist()  # many ties
    rows = [(int(k) * 3 - 50, v, int(k) % 3 or None) for k, v in zip(rng.permutation(n), vectors)]
    rows += [rows[0], rows[1], (None, vectors[2], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("code", F.lit(0)).withColumn("part", F.lit(0)).repartition(3)
    coded, books = vector_codes.encode(df, block=block, chunk=chunk)
    codes, errors, want = plain_codes(rows)
    assert all((books[p] == want[p]).all() for p in range(16))
    key = lambda r: (r[0] is None, r)
    got = sorted(((r.id, r.label or 0, bytes(r.code).hex(), r.error) for r in coded.collect()), key=key)
    assert got == sorted(((i, y or 0, bytes(c.tolist()).hex(), int(e)) for (i, _, y), c, e in zip(rows, codes, errors)), key=key)


def test_codes_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 16, 1), (2, None, 1), (3, [nan] * 16, 1), (4, [inf] + [0.0] * 15, None), (5, [None] + [0.1] * 15, 2), (6, [], None), (7, [0.25], None), (8, [-0.001] * 20, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    coded, books = vector_codes.encode(df)
    assert sorted(r.id for r in coded.collect()) == [1, 6, 7, 8] and books.shape == (16, 4, 2)
    assert {r.error for r in coded.collect()} == {0}
    none, books = vector_codes.encode(df.where("false"))
    assert none.count() == 0 and books.shape == (16, 0, 0) and none.columns == coded.columns
    blank, books = vector_codes.encode(df.where("vec_id = 6"))
    assert [(r.id, bytes(r.code).hex(), r.error) for r in blank.collect()] == [(6, "00" * 16, 0)] and books.shape == (16, 1, 0)
    with pytest.raises(Exception, match="exceeds"):
        vector_codes.encode(spark.createDataFrame([(1, [1e30] * 16, 1)], df.schema))[0].count()


def test_label_errors_add_up(spark):
    rows = vector_codes.op13_vector_codes(spark, "/root/testdata/sf0.001").collect()
    labels = {r.vec_id: r.label for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    sums: dict = {}
    for r in rows:
        sums[labels[r.vec_id]] = sums.get(labels[r.vec_id], 0) + r.error
    assert all(r.label_error == sums[labels[r.vec_id]] for r in rows)
    assert len({r.codebooks_sha256 for r in rows}) == 1 and len(rows[0].codebooks_sha256) == len(hashlib.sha256().hexdigest())
