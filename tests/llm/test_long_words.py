"""Quality of texts without blanks: what stands after the first bytes and signs of a run counts."""

import numpy as np

from patronage.llm import quality


def test_pieces_are_the_run_within_bounds():
    rng = np.random.default_rng(6)
    for signs in (b"aB1-=", b"ab", b"A", bytes(range(128, 256)), bytes(range(33, 256))):
        for size in (1, 12, 13, 64, 65, 129, 1000):
            run = bytes(rng.choice(list(signs), size).astype(np.uint8))
            parts = quality.pieces(run)
            assert b"".join(parts) == run and all(parts)
            assert max(map(len, parts)) <= quality.WORD_BYTES
            found = [[m.group() for m in quality._RUNS.finditer(p)] for p in parts]
            merged = [sum(k == 0 or not all(97 <= r[0] <= 122 or r[0] >= 128 for r in (p[k - 1], p[k])) for k in range(len(p))) for p in found]
            assert max(merged) <= quality.WORD_SIGNS
    assert quality.pieces(b"word" * 16) == [b"word" * 16]


def test_junk_behind_a_clean_start_is_seen():
    rng = np.random.default_rng(7)
    draw = lambda signs, n: "".join(rng.choice(list(signs), n))
    texts = lambda n: [(draw("天地玄黄宇宙洪荒", 30) + (draw("天地玄黄宇宙洪荒", 200) if k % 2 else draw("#{}=;0Xx%", 200)), k % 2) for k in range(n)]
    fresh = texts(100)
    scores = quality.Scorer(*quality.learn(texts(400)))([t for t, _ in fresh])
    right = (scores >= quality.THRESHOLD) == np.array([y == 1 for _, y in fresh])
    assert right.mean() > 0.9, right.mean()
