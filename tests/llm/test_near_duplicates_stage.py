"""The near_duplicates stage: its own setting, five words and 80 hundredths, and rows that repeat an id."""

import corpus_pipeline


def shingles(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def similar(a, b, n):
    a, b = shingles(a, n), shingles(b, n)
    return len(a & b) / len(a | b)


def test_copies_that_only_five_words_and_80_find(spark):
    base = [f"w{k}" for k in range(200)]
    longer = base + [f"x{k}" for k in range(42)]
    other = [f"v{k}" for k in range(200)]
    apart = other + [f"y{k}" for k in range(60)]
    assert similar(base, longer, 5) >= 0.8 > similar(other, apart, 5) and similar(base, longer, 4) < 0.85
    rows = [(k, " ".join(t)) for k, t in enumerate((base, longer, other, apart))]
    kept = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_rows_of_one_id_stay_unless_equal_or_linked(spark):
    base = [f"w{k}" for k in range(200)]
    text, near, other = " ".join(base), " ".join(base + ["x"]), " ".join(f"v{k}" for k in range(50))
    rows = [(1, text), (1, text), (1, None), (1, ""), (1, near), (1, other), (2, "few words"), (None, text), (None, text), (3, other + " y")]
    kept = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, None), (1, ""), (1, text), (1, other), (2, "few words"), (None, text), (None, text)], key=repr)
