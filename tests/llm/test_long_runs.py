"""Texts without blanks: what stands after the first bytes of a long run counts."""

import numpy as np

from patronage.llm import toxicity


def test_pieces_hold_every_n_gram():
    rng = np.random.default_rng(4)
    for size in (1, 39, 40, 41, 44, 76, 77, 1000):
        run = bytes(rng.integers(128, 256, size, np.uint8))
        parts = toxicity.pieces(run)
        assert max(map(len, parts)) <= toxicity.MAX_WORD
        for n in range(1, toxicity.MAX_GRAM + 1):
            assert {run[k : k + n] for k in range(size - n + 1)} == {p[k : k + n] for p in parts for k in range(len(p) - n + 1)}
    assert toxicity.pieces(b"x" * 40) == [b"x" * 40]


def test_toxic_passage_late_in_a_run_without_blanks():
    rng = np.random.default_rng(5)
    clean, toxic = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "蠢货白痴废物"
    draw = lambda signs, n: "".join(rng.choice(list(signs), n))
    sample = [(draw(clean, 60) + (draw(toxic, 12) if k % 2 else "") + draw(clean, 20), k % 2) for k in range(1200)]
    scorer = toxicity.Scorer(*toxicity.learn(sample))
    fresh = [draw(clean, 60) + (draw(toxic, 12) if k % 2 else "") + draw(clean, 20) for k in range(100)]
    scores = scorer(fresh)
    right = (scores >= toxicity.THRESHOLD) == (np.arange(100) % 2 == 1)
    assert right.mean() > 0.9, right.mean()
