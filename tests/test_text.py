from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patronage.functions.text import code_text, fenced_blocks
from patronage.operators import messages, scripts

FENCE = "```"


def scan(text):
    """Line by line: a line starting with a fence opens a block, a bare fence closes it."""
    blocks, body = [], None
    for one in text.split("\n"):
        bare = one.strip(" \t")
        if body is None:
            body = [] if bare.startswith(FENCE) else None
        elif bare == FENCE:
            blocks.append("\n".join(body))
            body = None
        else:
            body.append(one)
    return blocks


def blocks_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fenced_blocks(F.col("t"))).collect()]


LINES = st.sampled_from(["", FENCE, " ```", "```  ", "```python", "a", "  b ", "x```", "``", "````", "``` c", "\t```\t", "é"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LINES, max_size=12).map("\n".join), min_size=20, max_size=60))
def test_blocks_like_a_line_scan(spark, texts):
    assert blocks_of(spark, texts) == [scan(t) for t in texts]


def test_blocks_by_hand(spark):
    texts = ["", "```\na\nb\n```", "```py\nx\n```\nrest\n```\n\n```\n```\nopen", "no fence", "```\n```"]
    assert blocks_of(spark, texts) == [[], ["a\nb"], ["x", ""], [], [""]]


def test_long_blocks_do_not_overflow(spark):
    body = "\n".join(f"line {i} " + "z" * 20 for i in range(60000))
    assert blocks_of(spark, [f"{FENCE}\n{body}\n{FENCE}", f"{FENCE}\n{body}"]) == [[body], []]


def test_code_text(spark):
    texts = ["  plain \n", "t\n```python\na = 1\n```\nand\n```pyspark\nb\n```", "```sql\nc\n```", "x ```y``` z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(code_text(F.col("t"))).collect()] == ["plain", "a = 1\n\n\nb", "sql\nc", "y"]


def chat(spark):
    rows = [
        (1, 0, "Planner", "plan"),
        (1, 1, "Engineer", "```\n# BRONZE LAYER START\nold\n```"),
        (1, 2, "Engineer", "```\n# BRONZE LAYER START\n1\n```\n```\n# GOLD LAYER START\n2\n```\n```\n# BRONZE LAYER START\n3\n```\n```\nplain\n```"),
        (1, 3, "Tester", "```\nassert\n```"),
        (2, 0, "Engineer", ""),
        (2, 1, "Lead", "lead"),
        (3, 5, None, None),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_last_response_and_fallback(spark):
    got = dict(messages.last_response(chat(spark), "Lead").collect())
    assert got == {1: "", 2: "lead", 3: ""}
    wanted = {"main": ("Engineer", "Lead"), "plan": ("Planner",)}
    rows = {r["conv_id"]: r for r in messages.response_fallback(chat(spark), wanted).collect()}
    assert rows[2]["main"] == "lead" and rows[2]["plan"] == "" and rows[3]["main"] == ""
    assert rows[1]["main"].startswith("```") and rows[1]["plan"] == "plan"


def test_stage_blocks_and_artifacts(spark):
    blocks = messages.code_blocks(chat(spark).where("turn = 2"))
    assert [(r["position"], r["block"].split("\n")[-1]) for r in blocks.collect()] == [(0, "1"), (1, "2"), (2, "3"), (3, "plain")]
    stages = {r["stage"]: r["block"][-1] for r in messages.stage_blocks(blocks).collect()}
    assert stages == {"bronze_layer": "3", "gold_layer": "2"}
    found = messages.artifacts(chat(spark), "Engineer", "Tester", "Planner").where("conv_id = 1").first()
    assert len(found["code_blocks"]) == 4 and found["test_blocks"] == ["assert"] and found["plan"] == "plan"


def test_all_stage_markers(spark):
    marks = ["# BRONZE LAYER START", "# STAGE 1: BASE DATA START", "# SILVER LAYER START"]
    marks += ["# STAGE 2: ADVANCED ANALYTICS START", "# GOLD LAYER START"]
    df = spark.createDataFrame([(1, i, m + " # BRONZE LAYER END") for i, m in enumerate(marks)], "conv_id int, position int, block string")
    got = {r["stage"]: r["block"] for r in messages.stage_blocks(df).collect()}
    assert list(got.values()) == [m + " # BRONZE LAYER END" for m in marks] or len(got) == 5
    assert set(got) == {"bronze_layer", "stage1_base_data", "silver_layer", "stage2_advanced_analytics", "gold_layer"}


def test_message_stats_and_snippets(spark):
    df = spark.createDataFrame([(1, 0, "a", "é" * 300), (1, 1, "a", "y" * 301), (1, 2, "b", None)], "conv_id int, turn int, role string, text string")
    assert sorted(messages.message_stats(df).collect()) == [("a", 2, 601), ("b", 1, 0)]
    got = [r["snippet"] for r in messages.text_snippets(df).orderBy("turn").collect()]
    assert got == ["é" * 300, "y" * 300 + "...", None]


def test_conversation_export(spark, tmp_path):
    target = str(tmp_path / "chat")
    messages.write_conversations(chat(spark), target)
    back = spark.read.json(target)
    assert back.count() == 7 and set(back.columns) == {"conv_id", "turn", "name", "content"}
    assert messages.conversation_export(chat(spark)).where("conv_id = 2 AND turn = 1").first()["message"] == '{"name":"Lead","content":"lead"}'


SCRIPTS = {
    "a.sql": "with x as (select 1) select * from dbo.T t join S.U u on 1=1 group by a order by row_number() over (order by b)",
    "b.sql": "UPDATE t SET a = 1",
    "sub/c.sql": "SELECT 1\nFROM\n  T JOIN T ON 1=1 JOIN (SELECT 2 FROM W) w",
}


def test_scripts(spark, tmp_path):
    for name, text in SCRIPTS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    loaded = scripts.read_scripts(spark, str(tmp_path))
    assert {r["text"] for r in loaded.collect()} == set(SCRIPTS.values())
    rows = {r["path"].rsplit("/", 1)[1]: r for r in scripts.sql_inventory(loaded).collect()}
    assert rows["a.sql"][1:] == (["S.U", "dbo.T"], ["x"], True, True, True, True)
    assert rows["b.sql"][1:] == ([], [], False, False, False, False)
    assert rows["c.sql"]["referenced_tables"] == ["T", "W"] and rows["c.sql"]["select_before_from"]
    names = {(r["path"].rsplit("/", 1)[1], r["table_name"]) for r in scripts.table_references(loaded).collect()}
    assert names == {("a.sql", "S.U"), ("a.sql", "dbo.T"), ("c.sql", "T"), ("c.sql", "W")}
