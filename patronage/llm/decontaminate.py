"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, each document scanned once.

A word is a run of digits, ASCII letters (A-Z lowered) and bytes above 0x7F. A window is WINDOW consecutive words of a
test item; an item with fewer words, but not none, is one window. A document word is hit if it lies inside any
occurrence of a window.

Defined results. Null or empty text: no words, no hit, not contaminated. Null or wordless test items give no window.
Several rows with one item_id count as one item; a null item_id matches but is not listed. Repeated document rows are
judged one by one. Other columns are carried along and never looked at; one named as the result gives way to it. An empty benchmark hits
nothing; empty documents give an empty result with the same columns. Very long texts are scanned whole. A test set of
more than MAX_TEST_BYTES is dealt to slices that are scanned one after the other, each over documents written with what
the slices before found, so a worker holds one slice at a time; the result is the same.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from patronage.llm.common import column_ref, ship, table, written

WINDOW = 13
#: Test texts held by each worker, in bytes of words. Larger test sets are scanned in slices.
MAX_TEST_BYTES = 64 << 20
#: Pattern characters in one automaton; a test set with more is scanned by several automata in turn.
AUTOMATON_CHARS = 4_000_000
SCAN = "struct<n_words: bigint, n_hit: bigint, items: array<string>, span_starts: array<bigint>, span_ends: array<bigint>>"
#: What one slice finds: items, and the first and last word of each run of hit words.
FOUND = "struct<items: array<string>, first: array<int>, last: array<int>>"
_SCAN_TYPE = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("span_starts", pa.list_(pa.int64())),
        ("span_ends", pa.list_(pa.int64())),
    ]
)
#: Bytes of words to themselves, A-Z to a-z, all others to a blank.
_WORD_BYTES = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def _padded(words: list[bytes]) -> str:
    """Words between single blanks, one character for each byte."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows_of(items: list[tuple[str | None, str | None]], width: int) -> dict[str, tuple[int, frozenset]]:
    """Each window's padded text with its number of words and the items it comes from."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            part = words[k : k + width]
            found.setdefault(_padded(part), (len(part), set()))[1].add(item)
    return {k: (n, frozenset(ids)) for k, (n, ids) in found.items()}


@functools.lru_cache(maxsize=2)
def _automata(key: str, load, width: int) -> list[ahocorasick.Automaton]:
    built, size = [], AUTOMATON_CHARS + 1
    for text, value in windows_of(load(), width).items():
        if size > AUTOMATON_CHARS:
            built.append(ahocorasick.Automaton())
            size = 0
        built[-1].add_word(text, value)
        size += len(text)
    for automaton in built:
        automaton.make_automaton()
    return built


class _Items:
    """Test texts in a broadcast; hashable by content, so that a worker builds its automata once."""

    def __init__(self, broadcast, key: str):
        self.broadcast, self.key = broadcast, key

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return isinstance(other, _Items) and self.key == other.key

    def __call__(self):
        return self.broadcast.value


def _spans(raw: bytes, hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Character offsets in the original text of each run of hit words."""
    blank = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8) == 32
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    runs = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    begin, end = first[np.flatnonzero(runs == 1)], last[np.flatnonzero(runs == -1) - 1]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return chars[begin].tolist(), chars[end].tolist()


def hit_words(raw: bytes, automata: list[ahocorasick.Automaton]) -> tuple[int, np.ndarray | None, set]:
    """Number of words, which of them are hit (None without any), and the items found."""
    words = raw.translate(_WORD_BYTES).split()
    hit, items, ends = None, set(), None
    if words:
        padded = _padded(words)
        for automaton in automata:
            for end, (count, ids) in automaton.iter(padded):
                if hit is None:
                    hit = np.zeros(len(words), bool)
                    ends = np.cumsum([len(w) + 1 for w in words])
                last = int(np.searchsorted(ends, end))
                hit[last - count + 1 : last + 1] = True
                items |= ids
    return len(words), hit, items


def _result(raw: bytes, words: int, hit: np.ndarray | None, items) -> dict:
    if hit is None:
        return {"n_words": words, "n_hit": 0, "items": [], "span_starts": [], "span_ends": []}
    starts, stops = _spans(raw, hit)
    listed = sorted(x for x in items if x is not None)
    return {"n_words": words, "n_hit": int(hit.sum()), "items": listed, "span_starts": starts, "span_ends": stops}


def scan_text(raw: bytes, automata: list[ahocorasick.Automaton]) -> dict:
    return _result(raw, *hit_words(raw, automata))


def _test_rows(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """Items and texts, and their size."""
    rows = benchmark.select(column_ref(item).cast("string").alias("item"), column_ref(text).alias("text"))
    return rows, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*") * 32).first()[0]


def _on_driver(rows: DataFrame) -> list[tuple[str | None, str | None]]:
    return sorted(((r.item, r.text) for r in rows.collect()), key=lambda r: (r[0] or "", r[1] or ""))


def scanner(spark: SparkSession, items: list[tuple[str | None, str | None]], width: int = WINDOW):
    """A column function from text to `SCAN`: words, hit words, items found and the hit passages' offsets."""
    ship(spark)
    load = _Items(spark.sparkContext.broadcast(items), hashlib.sha256(repr((items, width)).encode()).hexdigest())

    @arrow_udf(SCAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = _automata(load.key, load, width)
        for texts in batches:
            rows = [scan_text((t or "").encode(), automata) for t in texts.to_pylist()]
            yield pa.array(rows, _SCAN_TYPE)

    return scan


def _slice_scanner(spark: SparkSession, items: list[tuple[str | None, str | None]], width: int):
    """A column function from text to `FOUND`."""
    load = _Items(spark.sparkContext.broadcast(items), hashlib.sha256(repr((items, width)).encode()).hexdigest())

    @arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = _automata(load.key, load, width)
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                words, hit, items_found = hit_words((t or "").encode(), automata)
                runs = np.diff(np.concatenate(([0], (np.zeros(words) if hit is None else hit).astype(np.int8), [0])))
                first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1) - 1
                rows.append({"items": sorted(x for x in items_found if x is not None), "first": first.tolist(), "last": last.tolist()})
            yield pa.array(rows, pa.struct([("items", pa.list_(pa.string())), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))]))

    return find


def _united():
    """A column function from a text, and what all slices found in it, to `SCAN`."""

    @arrow_udf(SCAN)
    def united(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            rows = []
            for text, parts in zip(texts.to_pylist(), found.to_pylist()):
                raw, hit = (text or "").encode(), None
                words = len(raw.translate(_WORD_BYTES).split())
                for part in parts:
                    for first, last in zip(part["first"], part["last"]):
                        hit = np.zeros(words, bool) if hit is None else hit
                        hit[first : last + 1] = True
                rows.append(_result(raw, words, hit, {x for part in parts for x in part["items"]}))
            yield pa.array(rows, _SCAN_TYPE)

    return united


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WINDOW, into: str = "scan",
) -> DataFrame:
    """`documents` with a struct column of what the scan found, in place of one of that name; offsets are characters of
    the original text."""
    spark = documents.sparkSession
    rows, size = _test_rows(benchmark, item, item_text)
    if size <= MAX_TEST_BYTES:
        return documents.withColumn(into, scanner(spark, _on_driver(rows), width)(column_ref(text)))
    ship(spark)
    slices = 2 * -(-size // MAX_TEST_BYTES)  # hashes do not deal evenly
    rows = written(rows.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(slices))))
    kept = [f"c{k}" for k in range(len(documents.columns))]
    found, texts = documents.toDF(*kept), kept[documents.columns.index(text)]
    for k in range(slices):
        find = _slice_scanner(spark, _on_driver(rows.where(F.col("slice") == k).drop("slice")), width)
        found = written(found.withColumn(f"found{k}", find(texts)))
    result = found.withColumn("result", _united()(texts, F.array(*[f"found{k}" for k in range(slices)])))
    columns = [F.col("result" if name == into else c).alias(name) for c, name in zip(kept, documents.columns)]
    return result.select(*columns, *([] if into in documents.columns else [F.col("result").alias(into)]))


def contaminated(scan: str = "scan"):
    """At least one hit word and at least one word in twenty."""
    return (F.col(f"{scan}.n_hit") > 0) & (20 * F.col(f"{scan}.n_hit") >= F.col(f"{scan}.n_words"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate(documents, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "scan.n_words",
        "scan.n_hit",
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


#: Windows of full length and of short items are matched as padded texts of equal numbers of words.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.doc_id, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
