"""Quality classifier: logistic regression over hashed word n-grams, learned with FTRL, scored as sparse dot products.

A text's words are its runs without ASCII white space, longer ones in consecutive pieces of at most WORD_BYTES bytes and
WORD_SIGNS signs of a shape, so that texts without blanks are read to their end. Each position gives four n-grams: the word, the word with the
one after it, the word's shape, and the shapes of three words in a row. A shape tells of upper and lower case, digits
and which signs stand before, in and after the word, so words not seen in learning still count. An n-gram's weight is
found by its hash; a text's score is the logistic function of the mean weight over positions, times SCALE, plus a bias.

Defined results. Null, empty and wordless texts get the bias alone as their score. Equal texts get scores equal to
six digits, to which scores are rounded. With labels of one value only every score is their base rate, 0 or 1; without
any usable label every score is 0.5, which predicts 0. Null ids are neither held out nor learned from; their rows are scored like others. A column named as the score gives way to it. An empty
table gives an empty result. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import add_columns, one_at_a_time, table
from patronage.llm.words import WordTable, fold, labelled_sample

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bounds of what is learned from.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 20_000
EPOCHS = 3
BITS = 18
SCALE = 10.0
#: FTRL: learning rate and its smoothing, and the weights of the absolute and squared penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: Bounds of a word; longer runs are read in pieces.
WORD_BYTES, WORD_SIGNS = 64, 12
#: Log odds that round to 0 and 1.
CERTAIN = 50.0
CACHED_WORDS = 150_000
STEP_BYTES = 2 << 20
_RUNS = re.compile(rb"[A-Z]+|[a-z]+|[0-9]+|[\x80-\xff]+|(.)\1*", re.S)


def shape(word: bytes) -> bytes:
    """Runs of capitals, letters, digits and bytes above 0x7F by one sign each, other signs as they are, three at most."""
    out = []
    for m in _RUNS.finditer(word):
        c = m.group()
        if 65 <= c[0] <= 90:
            out.append(b"A" if len(c) > 1 else b"C")
        elif 97 <= c[0] <= 122 or c[0] >= 128:
            if out[-1:] != [b"a"]:
                out.append(b"a")
        elif 48 <= c[0] <= 57:
            out.append(b"0")
        else:
            out.append(c[:3])
    return b"".join(out)


def pieces(run: bytes) -> list[bytes]:
    """A run without white space in consecutive pieces within the bounds of a word."""
    out, begin, signs, letters = [], 0, 0, False
    for m in _RUNS.finditer(run):
        start, end = m.span()
        small = 97 <= run[start] <= 122 or run[start] >= 128
        if not (small and letters):  # small letters and bytes above 0x7F in a row are one sign
            if signs == WORD_SIGNS:
                out.append(run[begin:start])
                begin, signs = start, 0
            signs += 1
        letters = small
        while end - begin > WORD_BYTES:
            out.append(run[begin : begin + WORD_BYTES])
            begin, signs = begin + WORD_BYTES, 1
    return [*out, run[begin:]]


def words_of(text: str | None) -> list[bytes]:
    runs = (text or "").encode().split()
    if max(map(len, runs), default=0) <= WORD_SIGNS:
        return runs
    return [piece for run in runs for piece in ((run,) if len(run) <= WORD_SIGNS else pieces(run))]


def _hash_words(words: list[bytes]) -> np.ndarray:
    """For each word the hash of it and of its shape."""
    return np.array([(xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(shape(w), 1)) for w in words], np.uint64).reshape(len(words), 2)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h >> np.uint64(64 - BITS)


def features(words: np.ndarray, shapes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the four n-grams of each position, and which of them lie within their text."""
    total = len(words)
    last = np.zeros(total + 2, bool)  # ends of texts; n-grams across them do not count
    last[at[1:][np.diff(at) > 0] - 1] = True
    after = lambda x, n: np.concatenate((x[n:], np.zeros(min(n, total), np.uint64)))
    second, third = ~last[:total], ~last[:total] & ~last[1 : total + 1]
    a, b, c = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
    grams = [words, words * a + after(words, 1) * b + c, shapes, (shapes * a + after(shapes, 1)) * b + after(shapes, 2) * c]
    keep = [np.ones(total, bool), second, np.ones(total, bool), third]
    return np.stack([_mix(g) for g in grams], 1).astype(np.int64), np.stack(keep, 1)


class Scorer:
    """Scores many texts with learned weights."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.table = WordTable(_hash_words, CACHED_WORDS)

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, at, rows = self.table.look_up([words_of(t) for t in texts])
        hashes = rows[numbers]
        return *features(hashes[:, 0], hashes[:, 1], at), at

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        buckets, keep, at = self.grams(texts)
        sums = np.concatenate(([0.0], np.cumsum((self.weights[buckets] * keep).sum(1, dtype=np.float64))))
        mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
        return np.round(1 / (1 + np.exp(-np.clip(self.bias + SCALE * mean, -50, 50))), 6)


def learn(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights by hash and the bias, by FTRL-proximal updates text by text."""
    size = 1 << BITS
    z, n, weights = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    values = {label for _, label in sample}
    if len(values) < 2:
        return np.zeros(size, np.float32), 0.0 if not values else CERTAIN if values == {1} else -CERTAIN
    reader = Scorer(np.zeros(size, np.float32), 0.0)
    examples = []
    for begin in range(0, len(sample), 500):
        part = sample[begin : begin + 500]
        buckets, keep, at = reader.grams([t for t, _ in part])
        for k, (_, label) in enumerate(part):
            rows = slice(at[k], at[k + 1])
            found, counts = np.unique(buckets[rows][keep[rows]], return_counts=True)
            examples.append((np.append(found, size).astype(np.int32), np.append(counts * (SCALE / max(1, at[k + 1] - at[k])), 1.0).astype(np.float32), label))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            where, x, label = examples[k]
            zi, ni = z[where], n[where]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2) * (np.abs(zi) > L1)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -50, 50))) - label) * x
            z[where] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[where] = ni + g * g
    weights = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2) * (np.abs(z) > L1)
    return weights[:size].astype(np.float32), float(weights[size])


@one_at_a_time
def _scorer(model: bytes) -> Scorer:
    return Scorer(*pickle.loads(model))


def score(documents: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", into: str = "score") -> DataFrame:
    """Adds each text's score. The model, of 2 ** BITS weights, goes along with the function."""
    packed = pickle.dumps(model)

    def make():
        scorer = _scorer(packed)
        return lambda texts: [pa.array(scorer(texts.to_pylist()), pa.float64())]

    return add_columns(documents, text, f"`{into}` double", make, STEP_BYTES)


def fit(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    sample, odds = labelled_sample(
        documents, labels, key=key, text=text, label=label, learn=fold(key, FOLDS) != HELD_OUT, rows=SAMPLE_ROWS, max_bytes=SAMPLE_BYTES
    )
    weights, bias = learn(sample)
    return weights, bias + odds


def learned(model: tuple[np.ndarray, float]) -> bool:
    """Whether the labels told texts apart; if not, scores are no reason to drop any."""
    return bool(model[0].any())


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, folder, "labels"))
    return score(documents, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
