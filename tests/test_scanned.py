"""The scan of scripts: what is code and what is not."""

import pytest

from patronage.operators.scripts import read_scripts, scanned_references

CASES = [
    ("SELECT 1 FROM a JOIN b.c ON x", ["a", "b.c"], []),
    ("-- FROM x\nSELECT * FROM y", ["y"], []),
    ("/* FROM a /* JOIN b */ FROM c */ FROM d", ["d"], []),
    ("/* /* /* /* FROM deep */ */ */ */ FROM d", ["d"], []),
    ("SELECT 'it''s FROM x -- ' FROM [my t].[a]]b] -- it's\nJOIN k", ["k", "my t.a]b"], []),
    ("WITH q AS (SELECT * FROM t1), r (a,b) AS (SELECT * FROM Q JOIN t2 ON 1=1) SELECT * FROM r, z JOIN q", ["t1", "t2"], ["q", "r"]),
    ("with recursive [a b] as (select 1 from x union all select 2 from [A B]) select * from \"a b\" join s.q", ["s.q", "x"], ["a b"]),
    ("WITH a AS NOT MATERIALIZED (SELECT 1 FROM b) SELECT * FROM a", ["b"], ["a"]),
    ('SELECT [JOIN me], "FROM you" FROM `x``y`', ["x`y"], []),
    ("SELECT EXTRACT(YEAR FROM d), trim(BOTH 'x' FROM s), from_date FROM f WHERE t.from = 1", ["f"], []),
    ("FROM fn(1) JOIN (SELECT 1 FROM g) h CROSS APPLY dbo.k c OUTER APPLY fn (2)", ["dbo.k", "g"], []),
    ("/* open FROM x", [], []),
    ("'open FROM x", [], []),
    ("select N'FROM a', in'x' from b", ["b"], []),
    ("DELETE FROM #tmp; SELECT * FROM @t JOIN a . [b c] . d", ["#tmp", "@t", "a.b c.d"], []),
    ("SELECT a FROM t1 a JOIN t1 b ON 1=1 JOIN T1 c", ["T1", "t1"], []),
    ("SELECT * FROM größe JOIN 表", ["größe", "表"], []),
    ("", [], []),
    (None, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(CASES)], "path int, text string")
    got = {r.path: (r.scanned_tables, r.scanned_ctes) for r in scanned_references(df).collect()}
    for k, (text, tables, ctes) in enumerate(CASES):
        assert got[k] == (tables, ctes), text


@pytest.mark.parametrize("filler", ["x", "*", "/", "''", "-", "[", "(", "\n", "*/*", "FROM "])
def test_long_comments_and_literals(spark, filler):
    long = filler * 200_000
    inner = long.replace("*/", "").replace("/*", "") if filler != "/" else long
    texts = [f"/*{inner} */ FROM t", f"'{long if filler == chr(39) * 2 else long.replace(chr(39), '')}' FROM t", f"SELECT 1 FROM t --{long.replace(chr(10), '')}"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "path int, text string")
    assert {tuple(r.scanned_tables) for r in scanned_references(df).collect()} == {("t",)}


def test_a_folder_of_scripts(spark, tmp_path):
    (tmp_path / "inner").mkdir()
    (tmp_path / "a.sql").write_bytes("SELECT 'ä'\r\nFROM x\n".encode())
    (tmp_path / "inner" / "b.sql").write_text("-- no line break")
    (tmp_path / "inner" / "empty.sql").write_text("")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in read_scripts(spark, str(tmp_path)).collect()}
    assert got == {"a.sql": "SELECT 'ä'\r\nFROM x\n", "b.sql": "-- no line break"}
