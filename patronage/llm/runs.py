"""Periodic runs of words, by uniting suffix classes in the order of falling common prefixes.

A run is a stretch of consecutive words with smallest period q, at least `min_length` words and `min_repeats` periods
long, that no neighbouring word extends. Let the run start at s: the suffixes at s and s + q share exactly length - q
words, and no suffix between them shares as many. So when classes of suffixes are united pair by pair in the order of
falling common prefixes (LCP), s and s + q become neighbours in the ordered set of positions of one class at the moment
their LCP is reached, and every run is told by such a pair: newly adjacent positions i < j of two classes, with
d = j - i <= LCP, have the run of period d that ends at j + LCP, and it starts at i if the words before i and j differ.
Union-find names the classes; the smaller ordered set moves into the larger one.

Only pairs with an LCP of at least the smallest of max(min_length - d, (min_repeats - 1) * d) over all d can tell a run,
16 words for 24 words and 3 repeats. A position whose next 16 words occur nowhere else in its text has no such pair, so
suffixes are sorted, by prefix doubling, among the others only. That leaves out no run.

Each text is handled whole and by itself, in steps of some texts at a time; there is no shuffle. A position that has a
repeat takes about 100 bytes, so memory follows the repetitive words of the longest text.

Defined results. Words are runs of characters other than blank and \\x09-\\x0D. Null, empty and wordless texts have no
words, no run and the empty collapsed text. Repeated rows and null ids are texts of their own. Very long texts, and such of
one repeated word, take time about n log n. An empty table gives an empty result. New columns replace those of the same
name; all others are kept.
"""

from __future__ import annotations

import itertools
from array import array
from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import add_columns, column_ref, table
from patronage.llm.words import _Numbers

MIN_LENGTH, MIN_REPEATS = 24, 3
STEP_BYTES = 2 << 20
#: Positions in a block of an ordered set, before it is split.
BLOCK = 512
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Positions:
    """An ordered set of positions, in blocks that stay small."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [array("q", (position,))], [position], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def neighbours(self, x: int) -> tuple[int | None, int | None]:
        """The members next to a position that is not a member."""
        k = bisect(self.firsts, x) - 1
        if k < 0:
            return None, self.firsts[0]
        block = self.blocks[k]
        at = bisect(block, x)
        after = block[at] if at < len(block) else self.firsts[k + 1] if k + 1 < len(self.firsts) else None
        return block[at - 1], after

    def add(self, x: int) -> None:
        k = max(0, bisect(self.firsts, x) - 1)
        block = self.blocks[k]
        block.insert(bisect(block, x), x)
        self.firsts[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.firsts[k : k + 1] = [block[0], block[half]]


def least_common(min_length: int, min_repeats: int) -> int:
    """The fewest words that the suffixes at a run's start and one period later share."""
    return max(1, min(max(min_length - d, (min_repeats - 1) * d) for d in range(1, max(2, min_length + 1))))


def repeated(words: np.ndarray, text: np.ndarray, end: np.ndarray, gram: int) -> np.ndarray:
    """Positions whose next `gram` words occur again in the same text; a few others may be among them."""
    starts = np.flatnonzero(np.arange(len(words)) + gram <= end[text])
    if not len(starts):
        return starts
    code = np.zeros(len(words), np.uint64)
    for k in range(gram):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code[: len(words) - k] += (words[k:].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(29)
    code = (code + text.astype(np.uint64) * np.uint64(0x94D049BB133111EB))[starts]
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    found = np.zeros(len(starts), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    return starts[found]


class Suffixes:
    """Some suffixes of texts in sorted order, with the common prefix of each with the one before."""

    def __init__(self, words: np.ndarray, text: np.ndarray, end: np.ndarray, gram: int):
        self.words, self.text, self.end, self.gram = words, text, end, gram
        chosen = repeated(words, text, end, gram)
        # whatever is compared in doubling begins at one of these or `gram` words after one
        after = chosen + gram
        after = after[after < end[text[chosen]]]
        self.at = np.union1d(chosen, after)
        self.slot = np.full(len(words) + 1, -1, np.int64)
        self.slot[self.at] = np.arange(len(self.at))
        self.levels = [self._grams()]
        size = gram
        while len(self.at) and self.levels[-1].max() + 1 < len(self.at):
            rank = self.levels[-1].astype(np.int64)
            key = rank * (len(self.at) + 2) + self._rank_at(rank, self.at, size) + 1
            self.levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
            size *= 2

    def _grams(self) -> np.ndarray:
        """Ranks of the next `gram` words of each position within its text; what lies past the end is least."""
        columns = np.zeros((len(self.at), self.gram + 1), ">u4")
        columns[:, 0] = self.text[self.at]
        for k in range(self.gram):
            where = self.at + k
            inside = where < self.end[self.text[self.at]]
            columns[inside, k + 1] = self.words[where[inside]] + 1
        if not len(columns):
            return np.zeros(0, np.int32)
        rows = columns.view(np.dtype((np.void, columns.itemsize * columns.shape[1]))).ravel()
        return np.unique(rows, return_inverse=True)[1].astype(np.int32)

    def _rank_at(self, rank: np.ndarray, positions: np.ndarray, ahead: int) -> np.ndarray:
        """Rank of what follows so many words later; -1 past the text's end, and where the start alone decides."""
        where = positions + ahead
        inside = where < self.end[self.text[positions]]
        slots = self.slot[np.where(inside, where, 0)]
        return np.where(inside & (slots >= 0), rank[np.maximum(slots, 0)], -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in sorted order that share at least `gram` words, and how many they share."""
        order = np.argsort(self.levels[-1])
        sorted_grams = self.levels[0][order]
        same = np.flatnonzero(sorted_grams[1:] == sorted_grams[:-1])
        a, b = self.at[order[same]], self.at[order[same + 1]]
        shared = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            left, right = (self._rank_at(self.levels[k], x, shared) for x in (a, b))
            shared += np.where((left >= 0) & (left == right), self.gram << k, 0)
        # fewer than `gram` words are left to compare
        open_ = np.ones(len(a), bool)
        for _ in range(self.gram - 1):
            x, y = a + shared, b + shared
            open_ &= (x < self.end[self.text[a]]) & (y < self.end[self.text[a]])
            open_[open_] = self.words[x[open_]] == self.words[y[open_]]
            shared += open_
        return a, b, shared


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """All runs of several texts: rows of text, start, length and period, sorted.

    words: numbers of all texts' words, one text after another; sizes: how many each text has.
    """
    end = np.cumsum(sizes).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    a, b, shared = Suffixes(words, text, end, least_common(min_length, min_repeats)).pairs()
    order = np.argsort(-shared, kind="stable")
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}
    seeds: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        up = parent.setdefault(x, x)
        while up != x:
            parent[x] = parent[up]
            x, up = up, parent[up]
        return x

    def seed(i: int, j: int, common: int) -> None:
        d = j - i
        if (min_repeats - 1) * d <= common and d + common >= min_length:
            seeds.append((i, common + d, d))

    for i, j, common in zip(a[order].tolist(), b[order].tolist(), shared[order].tolist()):
        i, j = root(i), root(j)
        large = members.pop(i, None) or Positions(i)
        small = members.pop(j, None) or Positions(j)
        if large.size < small.size:
            large, small, i, j = small, large, j, i
        last = None  # the moved position before, and the member after it
        for x in small:
            before, after = large.neighbours(x)
            if last and last[1] is not None and last[1] < x:
                seed(*last, common)
            if before is not None and (last is None or last[0] < before):
                seed(before, x, common)
            last = (x, after)
        if last[1] is not None:
            seed(*last, common)
        for x in small:
            large.add(x)
        parent[j] = i
        members[i] = large
    found = np.array(seeds, np.int64).reshape(-1, 3)
    if len(found):  # those that no word before extends
        start, period = found[:, 0], found[:, 2]
        of = text[start]
        first = end[of] - sizes[of]
        found = found[(start == first) | (words[start - 1] != words[start - 1 + period])]
    of = text[found[:, 0]]
    found = np.column_stack((of, found[:, 0] - (end[of] - sizes[of]), found[:, 1], found[:, 2])).astype(np.int64)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one blank, without those that lie in a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def find_runs(
    documents: DataFrame, *, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
    min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """Adds each text's runs, sorted by start and period, as word numbers from 0; and the text with each run cut to its
    first period, words joined by one blank."""
    if min_repeats < 2:
        raise ValueError("runs have at least two repeats")

    def compute(texts: pa.Array) -> list[pa.Array]:
        split = [(t or "").encode().split() for t in texts.to_pylist()]
        numbers, sizes = _Numbers(), np.array([len(w) for w in split], np.int64)
        words = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
        found = runs_of(words, sizes, min_length, min_repeats)
        at = np.searchsorted(found[:, 0], np.arange(len(split) + 1))
        fields = [pa.array(found[:, k + 1], pa.int64()) for k in range(3)]
        listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        left = [collapse(w, found[at[k] : at[k + 1], 1:]).decode() for k, w in enumerate(split)]
        return [listed, pa.array(left, pa.string())]

    return add_columns(documents, text, f"`{runs}` {RUN}, `{collapsed}` string", lambda: compute, STEP_BYTES)


def made_periodic(key: str, text: str) -> Column:
    """The query's texts: of a tenth of the ids, the words from one on repeat; others stay as they are."""
    h = F.crc32(column_ref(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        unit = F.slice(words, a + 1, p)
        repeats = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeats), F.lit(1), n), " "))

    # one array of all words, so that they are split once
    words = F.array(F.regexp_extract_all(column_ref(text), F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    return F.coalesce(F.when(h % 10 == 0, F.get(F.transform(words, repeat), F.lit(0))), column_ref(text))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", made_periodic("doc_id", "text").alias("text"))
    found = find_runs(documents)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    ahead = lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), ahead)
    return found.select("doc_id", "runs", best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


OP11_SQL = r"""
WITH polynomial AS (  -- the table of crc32
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT doc_id, words, len(words) AS n, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(1, len(d) + 1), lambda i: ascii(substring(d, i, 1)))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM h, polynomial),
m AS (
  SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN h // 10 % n END AS a, CASE WHEN n > 0 AND h % 10 = 0 THEN 1 + (n - h // 10 % n) // (3 + h // 10 % 8) END AS p FROM g),
w AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END) END AS w FROM m),
s AS (SELECT doc_id, unnest(range(n - 15)) AS i, w, n FROM w WHERE n >= 24),
grams AS (SELECT doc_id, i, CASE WHEN i > 0 THEN w[i] END AS before, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS gram FROM s),
pairs AS (  -- equal stretches of 16 words that the words before do not extend
  SELECT doc_id, x.i, y.i - x.i AS d FROM grams x JOIN grams y USING (doc_id, gram) WHERE y.i > x.i AND (x.i = 0 OR x.before <> y.before)),
ends AS (
  SELECT doc_id, i, d, d + coalesce(nullif(list_position(list_transform(list_zip(w[i + 1 : n - d], w[i + d + 1 : n]), lambda z: z[1] = z[2]), false), 0) - 1, n - d - i) AS length
  FROM pairs JOIN w USING (doc_id)),
runs AS (SELECT doc_id, i AS start, length, min(d) AS period FROM ends WHERE length >= greatest(24, 3 * d) GROUP BY ALL),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length // period DESC, (length % period) / period DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
dropped AS (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, range(n)), lambda z: NOT list_contains(coalesce(x, []), z[2])), lambda z: z[1]), ' ') AS text
  FROM w LEFT JOIN (SELECT doc_id, list(DISTINCT i) AS x FROM dropped GROUP BY doc_id) USING (doc_id))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(text) AS collapsed_sha256
FROM w LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) JOIN kept USING (doc_id)
"""
