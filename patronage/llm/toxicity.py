"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text's words are its runs of ASCII letters (lowered), digits and bytes above 0x7F; runs of more than MAX_WORD bytes are
read as overlapping pieces, each a word, so that every byte n-gram of a text without blanks counts. Each word enters as an embedding
found by its hash beside the mean of embeddings of its bytes and byte n-grams. Overlapping windows of WINDOW words, STRIDE
apart, are read by one recurrent network forwards and one backwards; attention weighs their states into one vector, and
a linear layer gives the window's logit. All windows of the whole text are scored; the text's logit is the largest,
put through a fitted scale and shift. Learning runs in numpy on a bounded sample: in each round a toxic text learns by
its most toxic window, the others by a random draw from all their windows.

Defined results. Null, empty and wordless texts have one empty window, whose score is that of the bias. Equal texts
get scores equal to six digits, to which scores are rounded, as single precision depends a little on the batch. With labels of one value
only every score is their base rate, 0 or 1; without any usable label every score is 0.5, which predicts 1. Null
ids are neither held out nor learned from; their rows are scored like others. A column named as the score gives way to it. An empty table gives an empty result. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import add_columns, one_at_a_time, table
from patronage.llm.words import WordTable, fold, labelled_sample

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
WINDOW, STRIDE = 32, 24
#: Sizes: word embeddings, their width, that of character embeddings, and states of each direction.
BUCKETS, WORD_WIDTH, CHAR_BUCKETS, CHAR_WIDTH, STATES = 1 << 13, 8, 1 << 14, 16, 8
#: Bounds of what is learned from.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 8000
#: Rounds of learning, texts' windows without toxicity drawn in each, windows to a step, and its rate.
EPOCHS, EPOCH_WINDOWS, BATCH, RATE = 10, 5000, 256, 0.01
#: Log odds that round to 0 and 1.
CERTAIN = 50.0
CACHED_WORDS = 150_000
STEP_BYTES = 2 << 20
ROWS_AT_ONCE = 2048
#: Words that are read at a time, and windows in learning.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 5_000, 1024
#: The longest word in bytes, and the longest n-gram.
MAX_WORD, MAX_GRAM = 40, 5
_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    words = (text or "").encode().translate(_WORD_BYTES).split()
    if max(map(len, words), default=0) <= MAX_WORD:
        return words
    return [piece for w in words for piece in ((w,) if len(w) <= MAX_WORD else pieces(w))]


def pieces(run: bytes) -> list[bytes]:
    """Pieces of MAX_WORD bytes that overlap so far that each n-gram of the run lies in one."""
    overlap = MAX_GRAM - 1
    return [run[k : k + MAX_WORD] for k in range(0, max(1, len(run) - overlap), MAX_WORD - overlap)]


def window_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words: which text each window belongs to, and its first word there. Every word is covered."""
    counts = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    return text, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def start_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng, width = np.random.default_rng(seed), WORD_WIDTH + CHAR_WIDTH
    normal = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
    weights = {"words": normal(BUCKETS, WORD_WIDTH, by=0.1), "chars": normal(CHAR_BUCKETS, CHAR_WIDTH, by=0.2)}
    for d in "fb":
        weights |= {
            f"x{d}": normal(width, 3 * STATES, by=width**-0.5), f"h{d}": normal(STATES, 3 * STATES, by=STATES**-0.5),
            f"c{d}": np.zeros(3 * STATES, np.float32),
        }
    return weights | {"attend": normal(2 * STATES, by=0.5), "out": normal(2 * STATES, by=0.5), "bias": np.zeros(1, np.float32)}


class Network:
    """The recurrent network over projected inputs: windows x positions x 6 * STATES, forward part first."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def _direction(self, d: str, inputs: np.ndarray, kept: list | None) -> np.ndarray:
        """States of one direction. inputs: positions x windows x 3 * STATES, in the order they are read."""
        w, n = self.w[f"h{d}"], STATES
        gates, candidate = np.ascontiguousarray(w[:, : 2 * n]), np.ascontiguousarray(w[:, 2 * n :])
        h = np.zeros((inputs.shape[1], n), np.float32)
        states = np.empty((len(inputs), inputs.shape[1], n), np.float32)
        for t, x in enumerate(inputs):
            zr = _sigmoid(x[:, : 2 * n] + h @ gates)
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[:, 2 * n :] + (r * h) @ candidate)
            if kept is not None:
                kept.append((h, z, r, c))
            h = h + z * (c - h)
            states[t] = h
        return states

    def forward(self, inputs: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows. inputs: positions x windows x 6 * STATES; real: positions x windows, false where past the text."""
        n = 3 * STATES
        memory = ([], []) if keep else (None, None)
        forward = self._direction("f", inputs[:, :, :n], memory[0])
        backward = self._direction("b", inputs[::-1, :, n:], memory[1])[::-1]
        states = np.concatenate((forward, backward), 2)
        energy = np.where(real, states @ self.w["attend"], np.float32(-1e9))
        share = np.exp(energy - energy.max(0))
        share /= share.sum(0)
        pooled = (share[:, :, None] * states).sum(0)
        logits = pooled @ self.w["out"] + self.w["bias"]
        return (logits, (memory, states, share, pooled)) if keep else logits

    def backward(self, d_logits: np.ndarray, kept, real: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the layers, and of the inputs."""
        memory, states, share, pooled = kept
        grads = {"out": pooled.T @ d_logits, "bias": np.array([d_logits.sum()], np.float32)}
        d_pooled = d_logits[:, None] * self.w["out"]
        d_share = (states * d_pooled).sum(2)
        d_energy = np.where(real, share * (d_share - (share * d_share).sum(0)), np.float32(0))
        grads["attend"] = np.einsum("lb,lbs->s", d_energy, states)
        d_states = share[:, :, None] * d_pooled + d_energy[:, :, None] * self.w["attend"]
        d_inputs = np.empty((*states.shape[:2], 6 * STATES), np.float32)
        for k, d in enumerate("fb"):
            part = d_states[:, :, k * STATES : (k + 1) * STATES]
            reading = part if d == "f" else part[::-1]
            d_x, grads[f"h{d}"] = self._direction_back(d, reading, memory[k])
            d_inputs[:, :, k * 3 * STATES : (k + 1) * 3 * STATES] = d_x if d == "f" else d_x[::-1]
        return grads, d_inputs

    def _direction_back(self, d: str, d_states: np.ndarray, memory: list) -> tuple[np.ndarray, np.ndarray]:
        w, n = self.w[f"h{d}"], STATES
        d_w, d_x = np.zeros_like(w), np.empty((*d_states.shape[:2], 3 * n), np.float32)
        d_h = np.zeros(d_states.shape[1:], np.float32)
        for t in range(len(d_states) - 1, -1, -1):
            h, z, r, c = memory[t]
            d_h = d_h + d_states[t]
            d_c = d_h * z * (1 - c * c)
            d_z = d_h * (c - h) * z * (1 - z)
            d_rh = d_c @ w[:, 2 * n :].T
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate((d_z, d_r), 1)
            d_w[:, : 2 * n] += h.T @ d_zr
            d_w[:, 2 * n :] += (r * h).T @ d_c
            d_x[t, :, : 2 * n], d_x[t, :, 2 * n :] = d_zr, d_c
            d_h = d_h * (1 - z) + d_rh * r + d_zr @ w[:, : 2 * n].T
        return d_x, d_w


class Scorer:
    """Scores many texts: inputs are projected once for each different word."""

    def __init__(self, weights: dict[str, np.ndarray], scale: float = 1.0, shift: float = 0.0):
        self.weights, self.scale, self.shift = weights, scale, shift
        self.network = Network(weights)
        self.blank = np.concatenate((weights["cf"], weights["cb"]))
        self.table = WordTable(self._project, CACHED_WORDS)

    def _project(self, words: list[bytes]) -> np.ndarray:
        w = self.weights
        out = np.zeros((len(words), 6 * STATES), np.float32)
        for begin in range(0, len(words), WORDS_AT_ONCE):
            part = words[begin : begin + WORDS_AT_ONCE]
            out[begin : begin + len(part)] = embed(w, *read_words(part)) @ np.hstack((w["xf"], w["xb"])) + self.blank
        return out

    def window_logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each window its text and its logit."""
        numbers, at, rows = self.table.look_up([words_of(t) for t in texts])
        text, first = window_starts(np.diff(at))
        logits = np.empty(len(text), np.float32)
        positions = np.arange(WINDOW)[:, None]
        for begin in range(0, len(text), ROWS_AT_ONCE):
            part = slice(begin, begin + ROWS_AT_ONCE)
            where = at[text[part]] + first[part] + positions
            real = where < at[text[part] + 1]
            words = numbers[np.where(real, where, 0)] if len(numbers) else np.zeros(where.shape, np.int64)
            inputs = rows[words] if len(rows) else np.zeros((*where.shape, 6 * STATES), np.float32)
            inputs[~real] = self.blank
            logits[part] = self.network.forward(inputs, real)
        return text, logits

    def text_logits(self, texts: list[str | None]) -> np.ndarray:
        text, logits = self.window_logits(texts)
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, text, logits)
        return best

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.round(1 / (1 + np.exp(-np.clip(self.scale * self.text_logits(texts).astype(np.float64) + self.shift, -50, 50))), 6)


def read_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, and buckets of each word's byte n-grams with the n + 1 offsets between words.

    A word stands between two marks; its n-grams have one to MAX_GRAM bytes.
    """
    buckets = np.array([zlib.crc32(w) % BUCKETS for w in words], np.int64)
    marked = [b"<" + w + b">" for w in words]
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))  # bytes from here to the word's end
    found, whose, code = [], [], np.zeros(len(raw), np.uint64)
    for n in range(1, MAX_GRAM + 1):
        code = code * np.uint64(0x100000001B3) + np.concatenate((raw[n - 1 :], np.zeros(min(n - 1, len(raw)), np.uint64))) + np.uint64(1)
        inside = left >= n
        found.append(((code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % CHAR_BUCKETS)
        whose.append(word[inside])
    whose = np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    at = np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(words))))).astype(np.int64)
    return buckets, np.concatenate(found)[order], at


def read_vocabulary(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `read_words` returns, read some words at a time and kept in 32 bits."""
    buckets, chars, at = np.zeros(len(words), np.int32), [np.zeros(0, np.int32)], np.zeros(len(words) + 1, np.int64)
    for begin in range(0, len(words), WORDS_AT_ONCE):
        part = words[begin : begin + WORDS_AT_ONCE]
        here, grams, ends = read_words(part)
        buckets[begin : begin + len(part)] = here
        chars.append(grams.astype(np.int32))
        at[begin + 1 : begin + len(part) + 1] = at[begin] + ends[1:]
    return buckets, np.concatenate(chars), at


def embed(w: dict[str, np.ndarray], buckets: np.ndarray, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(buckets):
        return np.zeros((0, WORD_WIDTH + CHAR_WIDTH), np.float32)
    means = np.add.reduceat(w["chars"][chars], at[:-1]) / np.diff(at)[:, None].astype(np.float32)
    return np.hstack((w["words"][buckets], means))


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights, self.rounds = weights, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in "ab")

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.rounds += 1
        for k, g in grads.items():
            m, v = self.first[k], self.second[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            by = rate * (1 - 0.999**self.rounds) ** 0.5 / (1 - 0.9**self.rounds)
            self.weights[k] -= (by * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def _sums(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows of equal index."""
    return np.stack([np.bincount(index, column, size) for column in rows.T], 1).astype(np.float32)


def gradients(weights: dict[str, np.ndarray], vocabulary, windows: np.ndarray, real: np.ndarray, labels: np.ndarray, share: np.ndarray):
    """Mean loss over windows (positions x windows, numbers of words) weighed by share, and gradients of all weights."""
    buckets, chars, at = vocabulary
    used, where = np.unique(windows[real], return_inverse=True)
    pick = np.concatenate([np.arange(at[u], at[u + 1]) for u in used]) if len(used) else np.zeros(0, np.int64)
    inner_at = np.concatenate(([0], np.cumsum(at[used + 1] - at[used]))).astype(np.int64)
    inputs_of = embed(weights, buckets[used], chars[pick], inner_at)
    both, blank = np.hstack((weights["xf"], weights["xb"])), np.concatenate((weights["cf"], weights["cb"]))
    inputs = np.broadcast_to(blank, (*windows.shape, len(blank))).copy()
    inputs[real] = (inputs_of @ both + blank)[where]
    network = Network(weights)
    logits, kept = network.forward(inputs, real, keep=True)
    loss = float((share * (np.logaddexp(0, logits) - labels * logits)).sum())
    grads, d_inputs = network.backward((share * (_sigmoid(logits) - labels)).astype(np.float32), kept, real)
    d_blank = d_inputs.sum((0, 1))
    d_rows = _sums(where, d_inputs[real], len(used))
    d_both, d_embedded, n = inputs_of.T @ d_rows, d_rows @ both.T, 3 * STATES
    grads |= {"xf": d_both[:, :n], "xb": d_both[:, n:], "cf": d_blank[:n], "cb": d_blank[n:]}
    grads["words"], grads["chars"] = np.zeros_like(weights["words"]), np.zeros_like(weights["chars"])
    if len(used):
        grads["words"] = _sums(buckets[used], d_embedded[:, :WORD_WIDTH], BUCKETS)
        sizes = np.diff(inner_at)
        whose = np.repeat(np.arange(len(used)), sizes)
        grads["chars"] = _sums(chars[pick], (d_embedded[:, WORD_WIDTH:] / sizes[:, None])[whose], CHAR_BUCKETS)
    return loss, grads


def window_logits(weights: dict[str, np.ndarray], vocabulary, windows: np.ndarray, real: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Logits of some windows (columns of `windows`, numbers of words), in steps."""
    buckets, chars, at = vocabulary
    both, blank = np.hstack((weights["xf"], weights["xb"])), np.concatenate((weights["cf"], weights["cb"]))
    rows = np.zeros((max(1, len(buckets)), 6 * STATES), np.float32)
    for begin in range(0, len(buckets), WORDS_AT_ONCE):
        end = min(begin + WORDS_AT_ONCE, len(buckets))
        rows[begin:end] = embed(weights, buckets[begin:end], chars[at[begin] : at[end]], at[begin : end + 1] - at[begin]) @ both + blank
    network, logits = Network(weights), np.empty(len(which), np.float32)
    for begin in range(0, len(which), WINDOWS_AT_ONCE):
        part = which[begin : begin + WINDOWS_AT_ONCE]
        inputs = rows[windows[:, part]]
        inputs[~real[:, part]] = blank
        logits[begin : begin + len(part)] = network.forward(inputs, real[:, part])
    return logits


def learn(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 1) -> tuple[dict[str, np.ndarray], float, float]:
    """Weights, and the scale and shift of a text's largest logit. Without two label values the scale is 0."""
    weights, rng = start_weights(seed), np.random.default_rng(seed)
    values = {label for _, label in sample}
    if len(values) < 2:
        return weights | {"out": np.zeros(2 * STATES, np.float32)}, 0.0, 0.0 if not values else CERTAIN if values == {1} else -CERTAIN
    numbers: dict[bytes, int] = {}
    texts = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)], np.int32) for t, _ in sample]
    label = np.array([y for _, y in sample], np.float32)
    vocabulary = read_vocabulary(list(numbers))
    del numbers
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *texts])
    del texts
    text, first = window_starts(np.diff(at))
    windows, real = np.zeros((WINDOW, len(text)), np.int32), np.zeros((WINDOW, len(text)), bool)
    for k in range(WINDOW):
        where = at[text] + first + k
        real[k] = where < at[text + 1]
        windows[k, real[k]] = flat[where[real[k]]]
    optimizer = _Adam(weights)
    toxic_windows, others = np.flatnonzero(label[text] == 1), np.flatnonzero(label[text] == 0)
    for epoch in range(epochs):
        taught = toxic_windows
        if epoch:  # the most toxic window of each toxic text, as the network sees it now
            logits = window_logits(weights, vocabulary, windows, real, toxic_windows)
            best = np.full(len(label), -np.inf, np.float32)
            np.maximum.at(best, text[toxic_windows], logits)
            taught = toxic_windows[logits >= best[text[toxic_windows]]]
        clean = rng.choice(others, min(len(others), EPOCH_WINDOWS), replace=False)
        kept = np.concatenate((taught, clean))
        weight = np.concatenate((np.full(len(taught), 0.5 / len(taught)), np.full(len(clean), 0.5 / len(clean)))) * len(kept)
        order = rng.permutation(len(kept))
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            rows = kept[part]
            _, grads = gradients(weights, vocabulary, windows[:, rows], real[:, rows], label[text[rows]], (weight[part] / len(part)).astype(np.float32))
            optimizer.step(grads, RATE * (1 - epoch / epochs))
    best = np.full(len(label), -np.inf, np.float32)
    np.maximum.at(best, text, window_logits(weights, vocabulary, windows, real, np.arange(len(text))))
    scale, shift = _calibrate(best.astype(np.float64), label)
    return weights, scale, shift


def _calibrate(logits: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the logit, by Newton steps with a small penalty."""
    x = np.stack((logits, np.ones_like(logits)), 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - label) + 0.1 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(w[0]), float(w[1])


@one_at_a_time
def _scorer(model: bytes) -> Scorer:
    return Scorer(*pickle.loads(model))


def score(documents: DataFrame, model, *, text: str = "text", into: str = "score") -> DataFrame:
    """Adds each text's score. The model, of a fixed size, goes along with the function."""
    packed = pickle.dumps(model)

    def make():
        scorer = _scorer(packed)
        return lambda texts: [pa.array(scorer(texts.to_pylist()), pa.float64())]

    return add_columns(documents, text, f"`{into}` double", make, STEP_BYTES)


def fit(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    sample, odds = labelled_sample(
        documents, labels, key=key, text=text, label=label, learn=fold(key, FOLDS) != HELD_OUT, rows=SAMPLE_ROWS, max_bytes=SAMPLE_BYTES
    )
    weights, scale, shift = learn(sample)
    return weights, scale, shift + odds


def learned(model) -> bool:
    """Whether the labels told texts apart; if not, scores are no reason to drop any."""
    return model[1] != 0


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, folder, "labels"))
    return score(documents, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
