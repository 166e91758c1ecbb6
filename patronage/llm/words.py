"""Numbering words of many texts, with a bounded table of what is computed once for each word."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import column_ref, written


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class WordTable:
    """Rows computed for each different word. The first `limit` words stay; later ones are computed once a step."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int):
        self.compute, self.limit = compute, limit
        self.numbers = _Numbers()
        self.rows = compute([])

    def look_up(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words one after another, the n + 1 offsets between texts, and the table they point into."""
        known = len(self.numbers)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        numbers = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64, at[-1])
        added = list(itertools.islice(self.numbers, known, None))
        rows = self.rows
        if added:
            if known + len(added) > len(rows):
                grown = np.zeros((max(known + len(added), 2 * len(rows)), *rows.shape[1:]), rows.dtype)
                grown[:known] = rows[:known]
                rows = grown
            rows[known : known + len(added)] = self.compute(added)
            if len(self.numbers) > self.limit:
                for word in added:
                    del self.numbers[word]
            else:
                self.rows = rows
        return numbers, at, rows


def fold(key: str, parts: int) -> Column:
    """The remainder that decides which rows may be learned from: crc32 of the id as text. Null has no fold."""
    return F.crc32(column_ref(key).cast("string").cast("binary")) % parts


def quotas(counts: dict[int, int], rows: int) -> dict[int, int]:
    """How many of each label value to learn from: equal shares of `rows`; what a rare value leaves goes to the others."""
    out: dict[int, int] = {}
    for value, count in sorted(counts.items(), key=lambda c: (c[1], c[0])):
        out[value] = min(count, (rows - sum(out.values())) // (len(counts) - len(out)))
    return out


def labelled_sample(
    documents: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, learn: Column, rows: int, max_bytes: int
) -> tuple[list[tuple[str, int]], float]:
    """Up to `rows` labelled documents that may be learned from, of each label value those with the smallest hash of
    their id; and what to add to log odds learned from them, so that they hold for all such documents.

    Texts of more than `max_bytes` are not learned from, which bounds what reaches the driver to rows * max_bytes; only
    documents that are there and within the bound count. Of several labels of one id the largest counts; of several
    documents with one id the least text.
    """
    known = labels.where(column_ref(label).isNotNull() & column_ref(key).isNotNull() & learn)
    known = known.groupBy(column_ref(key).alias("key")).agg(F.max(column_ref(label)).cast("int").alias("label"))
    texts = documents.select(column_ref(key).alias("key"), F.coalesce(column_ref(text), F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= max_bytes)
    usable = written(known.join(texts.select("key"), "key", "left_semi"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    taken = quotas(counts, rows)
    chosen = usable.limit(0)
    for value, n in taken.items():
        chosen = chosen.union(usable.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(n))
    # `rows` ids and labels are broadcast, not more
    found = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    found = found.toArrow().sort_by("key")
    sample = list(zip(found.column("text").to_pylist(), found.column("label").to_pylist(), strict=True))
    return sample, math.log(counts[1] * taken[0] / (taken[1] * counts[0])) if {0, 1} <= counts.keys() else 0.0
