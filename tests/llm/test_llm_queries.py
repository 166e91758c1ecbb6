"""Queries of the subpackage beside their SQL, or beside brute force, and the rules every query keeps."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from compare import connect, difference
from patronage.llm import decontaminate, ngram_join, pieces, quality, registry, token_files, toxicity

import public_tokenizers

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
NEVER = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in NEVER if node in plan]
    assert difference(df, con, SQL[name]) is None


def test_all_operators_and_the_pipeline():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert QUERIES.keys() <= entry.queries().keys()


def test_license_scan_runs_no_python(spark):
    plan = QUERIES["op7_licenses"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Arrow", "Pandas", "ExistingRDD") if node in plan]


def test_op1_adds_up_and_equals_each_token(spark, texts):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got: dict = {}
    for r in QUERIES["op1_token_counts"](spark, FOLDER).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.document_tokens))
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        raw, counts, at = text.encode(), {}, 0
        lines = text.splitlines(keepends=True) if "\n" in text else [text]
        lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if not text.endswith("\n") or not text else [])
        ends = np.cumsum([len(x) for x in lines])
        ids = encoding.encode_ordinary(text)
        for token in encoding.decode_tokens_bytes(ids):  # each character by character
            begin = len(raw[:at].decode(errors="ignore"))
            end = len(raw[: at + len(token)].decode(errors="ignore"))
            end += len(raw[: at + len(token)].decode(errors="ignore").encode()) < at + len(token)
            shares: dict = {}
            for c in range(begin, max(end, begin + 1)):
                line = int(np.searchsorted(ends, c, "right"))
                shares[line] = shares.get(line, 0) + 1
            best = min(shares, key=lambda k: (-shares[k], k))
            counts[best] = counts.get(best, 0) + 1
            at += len(token)
        starts = [0, *ends[:-1].tolist()]
        assert sorted(got[doc_id]) == [(k, starts[k], int(ends[k]), counts.get(k, 0), len(ids)) for k in range(len(lines))]


def test_op3_equals_the_library(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_sentencepiece"](spark, FOLDER).collect()}
    want = {}
    for doc_id, text in texts.items():
        ids = library.encode(text)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want[doc_id] = (len(ids), *digest)
    assert got == want


def test_op8_equals_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.MODEL))
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_token_files"](spark, FOLDER).collect()}
    start, want = 0, {}
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, token_files.END_ID]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rows == want


@pytest.mark.parametrize(
    ("name", "module", "label", "remainder", "least"),
    # toxic texts are few here, and some carry nothing but a rare dialect's words
    [("op4_toxicity", toxicity, "toxic", 0, (0.95, 0.75)), ("op9_quality", quality, "quality", 2, (0.95, 0.95))],
)
def test_classifier_on_what_was_held_out(spark, name, module, label, remainder, least):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}
    marks = dict(connect(folder).execute(f"SELECT doc_id, {label} FROM labels").fetchall())
    for doc_id, r in rows.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % module.FOLDS == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
    held = [(rows[k].predicted, y) for k, y in marks.items() if rows[k].held_out]
    right = [[p == y for p, y in held if y == c] for c in (0, 1)]
    assert len(held) > 500
    assert np.mean(right[0]) >= least[0] and np.mean(right[1]) >= least[1]


def near_sql(words, percent):
    """The SQL of the n-gram join for other settings than the query's."""
    sql = ngram_join.OP2_SQL
    for old, new in (("len(w) < 4", f"len(w) < {words}"), ("p + 3]", f"p + {words - 1}]"), ("len(w) - 3,", f"len(w) - {words - 1},"), (">= 85 *", f">= {percent} *")):
        assert sql.count(old) == 1
        sql = sql.replace(old, new)
    return sql


def test_pipeline_equals_its_stages_by_brute_force(spark, con, texts):
    """The trained stages by their scores; the others by SQL and the library over what these kept."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id: r.s for r in toxicity.score(documents, toxicity.fit(documents, labels), into="s").select("doc_id", "s").collect()}
    first = documents.where(documents.doc_id.isin([k for k, s in toxic.items() if s < toxicity.THRESHOLD]))
    good = {r.doc_id: r.s for r in quality.score(first, quality.fit(first, labels), into="s").select("doc_id", "s").collect()}
    kept = [k for k, s in good.items() if s >= quality.THRESHOLD]
    con.execute("CREATE SCHEMA stage; CREATE TABLE stage.kept (doc_id BIGINT)")
    con.executemany("INSERT INTO stage.kept VALUES (?)", [(k,) for k in kept])
    here = "(SELECT * FROM main.documents WHERE doc_id IN (SELECT doc_id FROM stage.kept)) AS documents"
    rows = con.execute(near_sql(corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT).replace("FROM documents)", f"FROM {here})").replace("FROM documents UNION", f"FROM {here} UNION").replace("FROM documents d", f"FROM {here[:-13]} d")).fetchall()
    assert len(rows) == len(kept)
    left = {doc_id for doc_id, _, component in rows if doc_id == component}
    dirty = {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontaminate.OP5_SQL}) WHERE contaminated").fetchall()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    want = {k: len(library.encode(texts[k])) for k in left - dirty}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want
    assert 0 < len(got) < len(kept) < len(texts)
