"""Short texts that cannot link have no entries in common."""

import numpy as np

from patronage.llm import ngram_join


def test_texts_of_one_shingle_do_not_meet():
    hashes = np.random.default_rng(8).integers(0, 2**63, 500).astype(np.uint64)
    owners, signatures = ngram_join.entries(hashes, np.arange(501), 85)
    assert len(owners) == 500 and len(set(signatures.tolist())) == 500


def test_sets_that_link_less_one_shingle_meet():
    rng = np.random.default_rng(9)
    for percent in (70, 80, 85):
        for size in range(2, ngram_join.tiny(percent) + 1):
            whole = rng.integers(0, 2**63, size).astype(np.uint64)
            owners, signatures = ngram_join.entries(np.concatenate((whole, whole[1:])), np.array([0, size, 2 * size - 1]), percent)
            met = set(signatures[owners == 0].tolist()) & set(signatures[owners == 1].tolist())
            assert bool(met) or 100 * (size - 1) < percent * size
