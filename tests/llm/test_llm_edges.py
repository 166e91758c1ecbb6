"""Every operator and stage with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patronage.llm import decontaminate, licenses, ngram_join, pieces, quality, token_counts, token_files, toxicity, vectors, warc

import public_tokenizers

LONG = " ".join(f"word{k % 7919} of a very long text" for k in range(40_000))
SOME = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood at night"
CLASHING = ("n_tokens", "ids", "decoded", "score", "scan", "counts", "n", "id", "key", "class", "label", "root", "a", "b", "point", "text_and_spans")
TEXTS = [(1, SOME), (2, SOME), (2, SOME), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + " end"), (None, SOME), (8, "word"), (9, None)]


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(documents):
    return documents.where("false")


def by_id(df, key="doc_id"):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(tuple(v for k, v in r.asDict().items() if k != key))
    return out


def test_token_counts(documents, empty):
    args = (public_tokenizers.path(token_counts.VOCABULARY), public_tokenizers.PATTERN)
    rows = token_counts.sections(token_counts.count_tokens(documents, *args, into="counts")).select("doc_id", "section", "start", "end", "n_tokens", "document_tokens")
    got = by_id(rows)
    assert got[3] == got[4] == [(0, 0, 0, 0, 0)]
    assert got[2][0] == got[2][1] == got[1][0] == got[None][0]
    assert len(got[5]) == 2 and got[6][0][2] == len(LONG)
    assert token_counts.count_tokens(empty, *args).count() == 0
    assert "n_tokens" in token_counts.count_tokens(documents, *args).columns


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_allocation_rule(rule):
    rng = np.random.default_rng(7)
    for _ in range(300):
        cuts = np.unique(rng.integers(0, 40, 8))
        starts, ends = cuts[:-1:2], cuts[1::2]
        starts = starts[: len(ends)]
        token_ends = np.unique(rng.integers(1, 41, 12))
        token_starts = np.concatenate(([0], token_ends[:-1]))
        got, outside = token_counts.allocate(token_starts, token_ends, starts, ends, rule)
        want, none = [0] * len(starts), 0
        for a, b in zip(token_starts, token_ends):
            shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
            touched = [k for k, x in enumerate(shares) if x]
            if not touched:
                none += 1
            else:
                want[touched[0] if rule == "first" else touched[-1] if rule == "last" else max(touched, key=lambda k: (shares[k], -k))] += 1
        assert got.tolist() == want and outside == none


def test_token_counts_of_given_spans(spark):
    df = spark.createDataFrame([(1, "hello world again", [(0, 5), (6, 11)]), (2, None, None), (3, "x", [])], "doc_id int, text string, spans array<struct<s:int,e:int>>")
    got = by_id(token_counts.count_tokens(df, public_tokenizers.path(token_counts.VOCABULARY), public_tokenizers.PATTERN, spans="spans").select("doc_id", "counts.n_tokens", "counts.outside", "counts.tokens"))
    assert got == {1: [(3, 1, [1, 1])], 2: [(0, 0, [])], 3: [(1, 1, [])]}


def test_ngram_join(documents, empty):
    result, links = ngram_join.ngram_join(documents)
    got = by_id(result, "id")
    assert [r[1] for r in got[1]] == [1] and [r[1] for r in got[2]] == [1, 1]
    assert got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[5] == [(0, 5)] and got[8] == [(1, 8)] and got[9] == [(0, 9)]
    assert got[None][0][1] is None and got[6][0][1] == got[7][0][1] == 6
    assert {(r.a, r.b) for r in links.collect()} == {(1, 2), (6, 7)}
    assert ngram_join.ngram_join(empty)[0].count() == 0


def _sets(rng, base, count, edits, vocabulary):
    words = [f"w{x}" for x in rng.integers(0, vocabulary, base)]
    out = []
    for _ in range(count):
        copy = list(words)
        for _ in range(rng.integers(0, edits + 1)):
            copy[rng.integers(0, len(copy))] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("percent", "words"), [(85, 4), (80, 5), (70, 1)])
def test_ngram_join_equals_all_pairs(spark, percent, words):
    rng = np.random.default_rng(percent)
    texts = [t for base in (3, 6, 11, 12, 13, 14, 25, 27, 60, 130, 400) for k in range(3) for t in _sets(rng, base, 9, max(1, base // 12), 200)]
    shared = " ".join(f"s{k}" for k in range(50))
    texts += [shared + " " + t for t in _sets(rng, 12, 30, 12, 10**6)] + [t for b in range(4, 16) for t in _sets(rng, b, 6, 1, 10**6)]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                linked.add((j, i))
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    result, links = ngram_join.ngram_join(df, percent=percent, words=words)
    assert {r.id: (r.n_shingles, r.component_id) for r in result.collect()} == {k: (len(sets[k]), find(k)) for k in range(len(texts))}
    found = {(r.a, r.b) for r in links.collect()}
    assert found <= linked and len(linked) > 100


def test_count_tree_bound_loses_nothing():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (700, ngram_join.DIMENSIONS)).astype(np.int32)
    points[350:] = np.maximum(points[:350] - (rng.random((350, ngram_join.DIMENSIONS)) < 0.05), 0)
    sizes = points.sum(1)
    tree = ngram_join.CountTree(points, sizes)
    for k in range(0, 700, 7):
        bound = np.minimum(points, points[k]).sum(1)
        want = np.flatnonzero(bound >= ngram_join.needed_overlap(sizes, sizes[k], 85))
        assert sorted(tree.search(points[k], sizes[k], 85)) == want.tolist()


def test_points_of_large_counts_keep_them():
    points = np.random.default_rng(0).integers(0, 300, (50, ngram_join.DIMENSIONS)).astype(np.int32)
    points[:25] %= 256
    packed = ngram_join.packed_points(points)
    assert {len(p) for p in packed[:25]} == {ngram_join.DIMENSIONS} and max(map(len, packed)) == 4 * ngram_join.DIMENSIONS
    assert (ngram_join.unpacked_points(packed) == points).all() and (ngram_join.unpacked_points(packed[:25]) == points[:25]).all()


def test_component_boxes_and_trees_lose_no_pair():
    rng = np.random.default_rng(11)
    base = rng.poisson(2, (1, ngram_join.DIMENSIONS))
    noise = rng.integers(-1, 2, (200, ngram_join.DIMENSIONS)) * (rng.random((200, ngram_join.DIMENSIONS)) < 0.2)
    points = np.maximum(base + noise, 0).astype(np.int32)
    sizes, roots = points.sum(1), np.where(rng.random(200) < 0.5, rng.integers(0, 4, 200), np.arange(200))
    passed = np.minimum(points[:, None], points[None]).sum(2) >= ngram_join.needed_overlap(sizes[:, None], sizes[None], 85)
    table = pa.table({"root": roots, "n_shingles": sizes, "point": pa.array([p.tobytes() for p in points], pa.binary())})
    boxes = ngram_join.boxes_of(table)
    names, low = (boxes.column(c).to_numpy() for c in ("root", "n_shingles"))
    top = ngram_join.unpacked_points(boxes.column("point").to_pylist())
    for cuts in ([0, len(names)], [0, 20, 27, len(names)]):  # one long list; short ones and a longer one
        begins, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        found = {tuple(p) for p in ngram_join.root_pairs(names, low, top, begins, ends, 85)}
        want = set()
        for begin, end in zip(begins, ends):
            here = set(names[begin:end].tolist())
            for a, b in zip(*np.nonzero(passed)):
                if roots[a] < roots[b] and {roots[a], roots[b]} <= here:
                    want.add((roots[a], roots[b]))
        assert want <= found and len(want) > 20
    asks = rng.random(200) < 0.3
    order = np.lexsort((np.arange(200), roots % 3))
    stretch = (roots % 3)[order]
    cuts = np.flatnonzero(np.diff(stretch)) + 1
    ids = order.astype(np.int64)
    got = ngram_join.meeting_pairs(ids, asks[order], sizes[order], points[order], np.append(0, cuts), np.append(cuts, 200), 85)
    want = {(min(a, b), max(a, b)) for a, b in zip(*np.nonzero(passed)) if asks[a] and not asks[b] and roots[a] % 3 == roots[b] % 3}
    assert {tuple(p) for p in got} == want and len(want) > 100


def test_sentencepiece(documents, empty):
    model = public_tokenizers.path(pieces.MODEL)
    df = pieces.round_trip(documents, model, ids="ids", decoded="decoded")
    assert df.schema["ids"].dataType.simpleString() == "array<int>"
    got = {(r.doc_id, r.text): (r.ids, r.decoded) for r in df.collect()}
    assert all(decoded == (text or "") for (_, text), (_, decoded) in got.items())
    assert got[3, None][0] == got[4, ""][0] == []
    again = pieces.decode_ids(pieces.encode_texts(documents, model, into="k"), model, ids="k", into="t2")
    assert again.where("t2 <> coalesce(text, '')").count() == 0 and again.count() == len(TEXTS)
    assert pieces.round_trip(empty, model).count() == 0


def test_sentencepiece_equals_library_on_odd_texts():
    import random

    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    ours, library = pieces.PieceModel(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    for alphabet in (" ab", " \n", "th ", "aeinrt", "  ▁x", " .,-=_", "éèüñ ", "int(){}; \t", "中文 的", "😀a ́\x00", "=-*#/ ", "<s></s>0xA1"):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            ids = library.encode(text)
            assert ours.encode(text) == ids, text
            assert ours.decode(ids) == library.decode(ids), text
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 8))]
        assert ours.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, documents, empty, module, label):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, None), (None, 1), (6, 0), (99, 1)], f"doc_id bigint, {label} int")
    model = module.fit(documents, labels)
    scored = module.score(documents, model)
    got = by_id(scored.select("doc_id", "score"))
    assert all(0 <= s <= 1 for rows in got.values() for (s,) in rows) and sum(map(len, got.values())) == len(TEXTS)
    assert [len(got[k]) for k in (1, 2, 3, None)] == [1, 2, 1, 1]
    for same in ((3, 4, 5, 9), (1, 2, None)):
        assert np.ptp([s for k in same for (s,) in got[k]]) < 2e-6
    assert module.score(empty, model).count() == 0
    for nothing in (module.fit(empty, labels), module.fit(documents, labels.where("false"))):
        assert {s for rows in by_id(module.score(documents, nothing).select("doc_id", "score")).values() for (s,) in rows} == {0.5}


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    w = toxicity.start_weights(3)
    vocabulary = toxicity.read_words([b"idiot", b"the", b"clown", b"x", "über".encode()])
    windows, real = rng.integers(0, 5, (toxicity.WINDOW, 6)), np.ones((toxicity.WINDOW, 6), bool)
    real[20:, 2], real[:, 4] = False, False
    args = (vocabulary, windows, real, np.array([0, 1, 0, 1, 1, 0.0]), np.full(6, 1 / 6))
    _, grads = toxicity.gradients(w, *args)
    for k in w:
        where = [(vocabulary[0][i], 1) for i in range(3)] if k == "words" else [(vocabulary[1][i], 2) for i in range(3)] if k == "chars" else [tuple(rng.integers(0, s) for s in w[k].shape) for _ in range(3)]
        for i in where:
            old, loss = w[k][i], []
            for step in (1e-2, -1e-2):
                w[k][i] = old + step
                loss.append(toxicity.gradients(w, *args)[0])
            w[k][i] = old
            assert abs((loss[0] - loss[1]) / 2e-2 - grads[k][i]) < 2e-3


def test_toxicity_windows_cover_every_word():
    sizes = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500])
    text, first = toxicity.window_starts(sizes)
    for k, size in enumerate(sizes):
        mine = first[text == k]
        assert set(range(size)) <= {p for f in mine for p in range(f, f + toxicity.WINDOW)} and (mine < max(size, 1)).all()


def test_decontamination(spark, documents, empty):
    words = SOME.split()
    benchmark = spark.createDataFrame([(10, " ".join(words[1:15])), (9, "Word"), (9, "Word"), (11, None), (12, " . "), (None, "lazy dog")], "item_id bigint, text string").withColumn("scan", F.lit(1))
    got = {(r.doc_id, r.text): r.scan for r in decontaminate.decontaminate(documents, benchmark).collect()}
    assert (got[1, SOME].n_words, got[1, SOME].n_hit, got[1, SOME].items) == (len(words), 14, ["10"])
    assert SOME[got[1, SOME].span_starts[0] : got[1, SOME].span_ends[0]] == " ".join(words[1:15])
    assert got[3, None].n_words == got[4, ""].n_words == 0 and got[8, "word"].items == ["9"]
    assert got[6, LONG].n_hit == 0
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    nothing = decontaminate.decontaminate(documents, benchmark.where("false"))
    assert nothing.where("scan.n_hit > 0").count() == 0 and nothing.count() == len(TEXTS)


def test_a_large_test_set_is_scanned_in_slices(spark, documents, empty, monkeypatch):
    words = SOME.split()
    items = [(k, " ".join(words[k : k + 14])) for k in range(4)] + [(20, "Word"), (None, "lazy dog"), (21, LONG[:2000]), (22, None), (0, "night")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    key = lambda df: sorted(map(repr, (r.asDict(recursive=True) for r in df.collect())))
    want = key(decontaminate.decontaminate(documents, benchmark, into="class"))
    monkeypatch.setattr(decontaminate, "MAX_TEST_BYTES", 1000)
    sliced = decontaminate.decontaminate(documents, benchmark, into="class")
    assert key(sliced) == want and sliced.columns == documents.columns
    assert decontaminate.decontaminate(documents, benchmark, into="new").columns == [*documents.columns, "new"]
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


def test_decontamination_offsets_and_several_automata(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "AUTOMATON_CHARS", 40)
    items = [(str(k), f"Größe {k} " + " ".join(f"x{k}y{j}" for j in range(14))) for k in range(5)]
    text = "Ä, é! GRößE 3 -- " + ", ".join(f"X3y{j}" for j in range(14)) + " ünd größe 1 x1y0 ende"
    found = decontaminate.scan_text(text.encode(), decontaminate._automata("several", lambda: items, 13))
    assert found["items"] == ["3"] and found["n_hit"] == 16
    assert [text[a:b] for a, b in zip(found["span_starts"], found["span_ends"])] == ["GRößE 3 -- " + ", ".join(f"X3y{j}" for j in range(14))]


def _brute_archive(rows):
    first = {}
    for page, html in rows:
        html = html or ""
        if len(html.encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, html in rows:
        html = html or ""
        other = first.get(html)
        revisit = other is not None and page != other
        out.append((page, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=repr)


def test_warc(spark, tmp_path):
    marker = warc.MARKER.decode()
    big = f"<p>ü {marker}{marker} \r\n\r\n 0\r\n\r\n</p>" * 4000
    rows = [(1, big), (2, big), (2, big), (3, None), (4, ""), (5, "short"), (6, "short"), (None, big), (7, LONG), (7, "x" * 100), (8, "x" * 100), (9, marker), (10, marker[:-1] * 30)]
    pages = spark.createDataFrame([(p, "http://x/\r\n" + str(p), h) for p, h in rows], "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("copies", F.lit(1))
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, segment_bytes=50_000)
    records = warc.read_records(spark, path)
    assert records.where("record_type = 'continuation'").count() > 3
    found = warc.read_archive(spark, path)
    payloads = {(r.page_id, r.digest): bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert all(hashlib.sha256(p).hexdigest() == d for (_, d), p in payloads.items()) and payloads[1, hashlib.sha256(big.encode()).hexdigest()] == big.encode()
    folder = tmp_path / "tables"
    pages.write.parquet(str(folder / "pages.parquet"))
    assert sorted((tuple(r) for r in warc.op6_warc(spark, str(folder)).collect()), key=repr) == _brute_archive(rows)
    nothing = tmp_path / "none"
    pages.where("false").write.parquet(str(nothing / "pages.parquet"))
    assert warc.op6_warc(spark, str(nothing)).count() == 0


def test_warc_faults_are_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id bigint, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, segment_bytes=1000, compression="none")
    records = warc.read_records(spark, path)
    with pytest.raises(Exception, match="missing or of another total length"):
        warc.reassemble(records.where("segment <> 2")).collect()
    with pytest.raises(Exception, match="missing or of another total length"):
        warc.reassemble(records.withColumn("total_length", F.col("total_length") + 1)).collect()
    with pytest.raises(Exception, match="another digest"):
        warc.decode_payloads(warc.reassemble(records.withColumn("digest", F.lit("0")))).collect()
    assert warc.unchunked(warc.chunked(b"a" * 100_000, 7)) == b"a" * 100_000


def test_licenses(spark, documents, empty):
    notice = {name: text for name, _, text in licenses.NOTICES}
    rows = [
        (1, "before " * 40 + notice["mit-permission"] + " after" * 40), (2, notice["all-rights-line"].upper()), (3, None), (4, ""),
        (5, LONG + "\n" + notice["gpl3-line"]), (5, notice["mit-line"]), (None, notice["mit-line"] + "\n" + notice["mit-line"]),
        (6, notice["apache-header"].replace("required", "demanded")), (7, "released under the license"), (8, "all rights were reserved"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class", F.lit(1)).withColumn("band", F.lit(1)).withColumn("template", F.lit(1))
    got = {(r.doc_id, r.template): (r.contained, r.shingles, r.start) for r in licenses.scan(df).collect()}
    keys = {k for k in got if k[0] != 6}
    assert keys == {(1, "mit-permission"), (2, "all-rights-line"), (5, "gpl3-line"), (5, "mit-line"), (None, "mit-line")}
    assert (6, "apache-header") in got and got[6, "apache-header"][0] < got[6, "apache-header"][1]
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(documents).count() == 0


def test_token_files(spark, documents, empty, tmp_path):
    tokenizer = public_tokenizers.path(token_files.MODEL)
    path = str(tmp_path / "ids")
    token_files.write_token_files(documents, path, tokenizer)
    read = token_files.read_token_files(spark, path).select("doc_id", "file", F.size("ids").cast("long").alias("n_tokens"), "ids")
    rows = token_files.with_starts(read, [F.col("doc_id").asc_nulls_first(), "n_tokens"]).collect()
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert all(r.ids == [token_files.END_ID] for r in rows if r.doc_id in (3, 4, 5, 9))
    one = spark.read.orc(path).where("doc_id = 8")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,8)]" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    token_files.write_token_files(empty, str(tmp_path / "none"), tokenizer)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_tokenizer_cuts_equal_the_library():
    import random

    definition = open(public_tokenizers.path(token_files.MODEL), "rb").read()
    cached, rng = token_files.CachedTokenizer(definition), random.Random(3)
    assert cached.cuts
    texts = ["a<|endoftext|>b c", "x <|startoftext|>"]
    for alphabet in ("ab's 't", "aéÉ ̊", "12a ,.'!", "it'll x'RE 'd", "ΑΣ ς", "中文 1", "😀a \x00\x1c　\xa0", "İI ıKK", "a-b_c~`'́", "ßÿ×÷Àaé,.-"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    for begin in range(0, len(texts), 300):
        ids, at = cached.encode(texts[begin : begin + 300])
        for k, text in enumerate(texts[begin : begin + 300]):
            assert ids[at[k] : at[k + 1]].tolist() == cached.library.encode(text, add_special_tokens=False).ids, text


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.1, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [1.0, 0.0, 0.0], None),
        (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, nan, 0.0], 1), (8, [inf, 0.0, 0.0], 1), (9, [1.0, None, 0.0], 1), (10, [], 1),
        (11, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (12, [0.0, 1.0, 0.0], 1), (13, [3e38, 0.0, 0.0], 1), (14, [1e-40, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("class", F.lit(0)).withColumn("list", F.lit(0))
    got = by_id(vectors.near_duplicates(df), "id")
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[13] == got[14] == [(4, 1, False)]
    assert all(got[k] == [(0, k, True)] for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)) and got[None] == [(0, None, True)]
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_recall_with_many_lists(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((500, 24))
    near = np.repeat(base, 4, 0) + rng.standard_normal((2000, 24)) * rng.choice([0.02, 0.1, 0.3], (2000, 1))
    label = np.repeat(rng.integers(0, 3, 500), 4)
    df = spark.createDataFrame([(k, v.tolist(), int(label[k])) for k, v in enumerate(near)], "vec_id bigint, embedding array<double>, label int")
    got = {r.id: r.n_links for r in vectors.near_duplicates(df, lists=40, block=64, min_cosine=0.93).collect()}
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    want = linked.sum(1) - 1
    assert all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.99 * want.sum() > 0


def test_pipeline_stages(spark, documents, empty, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(1, 9)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "other words than these")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, documents, folder)
        assert stage(spark, empty, folder).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == documents.columns and result.count() <= len(TEXTS)
        if name == "near_duplicates":
            kept = sorted((r.doc_id for r in result.select("doc_id").collect()), key=lambda x: (x is None, x))
            assert kept == [1, 3, 4, 5, 6, 8, 9, None]
        if name == "decontamination":
            assert result.count() == len(TEXTS)
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["toxicity", "quality", "near_duplicates", "decontamination", "sentencepiece"]'
