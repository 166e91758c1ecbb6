"""Scores of the classifiers' queries against loops over one text, one window and one n-gram at a time."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from patronage.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.001"
WHOLE = (1 << 64) - 1


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels")]


def logistic(x):
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def toxicity_words(text):
    out = []
    for run in re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())):
        begin = 0
        while True:
            out.append(run[begin : begin + 40])
            if begin + 40 >= len(run):
                break
            begin += 36
    return out


def word_input(w, word):
    marked, grams = b"<" + word + b">", []
    for n in range(1, 6):
        for k in range(len(marked) - n + 1):
            code = 0
            for byte in marked[k : k + n]:
                code = (code * 0x100000001B3 + byte + 1) & WHOLE
            grams.append(w["chars"][((code * 0x9E3779B97F4A7C15) & WHOLE) // (1 << 40) % len(w["chars"])].astype(np.float64))
    return np.concatenate((w["words"][zlib.crc32(word) % len(w["words"])], sum(grams) / len(grams)))


def states(w, d, inputs):
    n, h, out = toxicity.STATES, np.zeros(toxicity.STATES), []
    gate = lambda x: 1 / (1 + np.exp(-x))
    for x in inputs:
        a = x @ w[f"x{d}"] + w[f"c{d}"] if x is not None else w[f"c{d}"].astype(np.float64)
        z, r = gate(a[:n] + h @ w[f"h{d}"][:, :n]), gate(a[n : 2 * n] + h @ w[f"h{d}"][:, n : 2 * n])
        c = np.tanh(a[2 * n :] + (r * h) @ w[f"h{d}"][:, 2 * n :])
        h = (1 - z) * h + z * c
        out.append(h)
    return out


def toxicity_score(model, text):
    w, scale, shift = model
    words = toxicity_words(text)
    best, first = -math.inf, 0
    while True:
        here = [word_input(w, word) for word in words[first : first + 32]]
        inputs = here + [None] * (32 - len(here))
        both = [np.concatenate(p) for p in zip(states(w, "f", inputs), states(w, "b", inputs[::-1])[::-1])]
        real = both[: len(here)] or both  # without words each position counts alike
        energy = np.array([s @ w["attend"] for s in real]) if here else np.zeros(len(real))
        share = np.exp(energy - energy.max())
        pooled = sum(a * s for a, s in zip(share / share.sum(), real))
        best = max(best, float(pooled @ w["out"] + w["bias"][0]))
        if first + 32 >= len(words):
            return logistic(scale * best + shift)
        first += 24


def test_toxicity_scores_equal_a_plain_loop(spark, tables):
    documents, labels = tables
    model = toxicity.fit(documents, labels)
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, FOLDER).collect()}
    texts = sorted((len(r.text or ""), r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    for _, doc_id, text in texts[:60] + texts[-3:]:
        assert got[doc_id].score == pytest.approx(toxicity_score(model, text), abs=2e-5), doc_id
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and got[doc_id].predicted == int(got[doc_id].score >= 0.5)
    scorer = toxicity.Scorer(*model)
    for text in ("", None, "Ä" * 300, "one-two THREE " * 90, "x" * 41 + " " + "y" * 40):
        assert scorer([text])[0] == pytest.approx(toxicity_score(model, text), abs=2e-5)


def quality_score(model, text):
    weights, bias = model
    words = quality.words_of(text)
    hashes = [(xxhash.xxh64_intdigest(x), xxhash.xxh64_intdigest(quality.shape(x), 1)) for x in words]
    a, b, c = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5

    def weight(code):
        code &= WHOLE
        return float(weights[((code ^ code >> 31) * 0x9E3779B97F4A7C15 & WHOLE) >> 46])

    total = 0.0
    for k, (word, shape) in enumerate(hashes):
        total += weight(word) + weight(shape)
        if k + 1 < len(hashes):
            total += weight(word * a + hashes[k + 1][0] * b + c)
        if k + 2 < len(hashes):
            total += weight((shape * a + hashes[k + 1][1]) * b + hashes[k + 2][1] * c)
    return logistic(bias + 10 * total / max(1, len(words)))


def test_quality_scores_equal_a_plain_loop(spark, tables):
    documents, labels = tables
    model = quality.fit(documents, labels)
    got = {r.doc_id: r for r in quality.op9_quality(spark, FOLDER).collect()}
    for r in documents.select("doc_id", "text").collect():
        assert got[r.doc_id].score == pytest.approx(quality_score(model, r.text), abs=2e-6), r.doc_id
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
    scorer = quality.Scorer(*model)
    for text in ("", None, "word", "two words", "Ä" * 300, "a1B2" * 80):
        assert scorer([text])[0] == pytest.approx(quality_score(model, text), abs=2e-6)
