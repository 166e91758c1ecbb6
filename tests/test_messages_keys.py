"""Chat jobs with null conversations and repeated deliveries."""

from pyspark.sql import functions as F

from patronage.operators import messages

BLOCKS = "```\n# GOLD LAYER START\n{}\n```"


def chat(spark):
    rows = [
        (None, 0, "Lead", "early"), (None, 1, "Lead", "late"), (None, 2, "Engineer", BLOCKS.format(1)),
        (1, 3, "Lead", "a"), (1, 3, "Lead", "b"), (1, 3, "Lead", "b"), (1, 3, "Engineer", BLOCKS.format(2)), (1, 3, "Engineer", BLOCKS.format(2)),
        (2, None, "Lead", "no turn"), (2, 1, "Other", "x"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_null_conversations_keep_their_texts(spark):
    got = [tuple(r) for r in messages.last_response(chat(spark), "Lead").collect()]
    assert sorted(got, key=repr) == sorted([(None, "late"), (1, "b"), (2, "")], key=repr)


def test_repeated_turns_give_one_row(spark):
    rows = messages.last_responses(chat(spark), ["Lead", "Engineer"]).collect()
    assert {r["conv_id"]: (r["Lead"], r["Engineer"]) for r in rows} == {None: ("late", BLOCKS.format(1)), 1: ("b", BLOCKS.format(2)), 2: ("", "")}
    assert len(rows) == 3
    assert messages.artifacts(chat(spark), "Engineer", "Lead", "Lead").count() == 3
    assert messages.response_fallback(chat(spark), {"main": ("Lead", "Engineer")}).count() == 3


def test_stage_blocks_of_null_and_repeated_ids(spark):
    blocks = messages.code_blocks(chat(spark))
    got = sorted(((r["conv_id"], r["stage"], r["block"][-1]) for r in messages.stage_blocks(blocks).collect()), key=repr)
    assert got == [(1, "gold_layer", "2"), (None, "gold_layer", "1")]


def test_latest_texts_take_one_shuffle_and_no_join(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    blocks = df.select("conv_id", F.col("turn").alias("position"), F.col("text").alias("block"))
    for found in (messages.last_responses(df, ["user", "system"]), messages.stage_blocks(blocks), messages.artifacts(df, "a", "b", "c")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_texts_without_a_turn_and_roles_without_text(spark):
    rows = [(1, None, "user", "lost"), (1, 2, "user", None), (2, 1, "user", "a"), (2, 3, "user", "b"), (2, 3, "user", "c"), (3, 9, "other", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.user, r.system) for r in messages.last_responses(df, ["user", "system"]).collect()}
    assert got == {1: ("", ""), 2: ("c", ""), 3: ("", "")}
