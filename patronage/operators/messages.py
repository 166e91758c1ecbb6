"""Jobs over chat tables: columns conv_id, turn, role, text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions import fixed_values as fx
from patronage.functions.columns import first_match, snippet
from patronage.functions.text import fenced_blocks, stage_of


def last_responses(messages: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Each conversation with the latest text of every given role, "" where the role said nothing.

    One aggregation that combines on the map side: of each conversation in a task one text of each role asked for is
    moved, and texts of other roles never. Null is a conversation like others; of several texts of one role in its
    last turn the greatest counts, and a text without turn counts as not said.
    """

    def latest(role: str) -> Column:
        said = (F.col("role") == role) & F.col("text").isNotNull() & F.col("turn").isNotNull()
        newest = F.max_by("text", F.when(said, F.struct("turn", "text")))
        return F.coalesce(newest, F.lit("")).alias(role)

    return messages.select("conv_id", "role", "turn", F.when(F.col("role").isin(*roles), F.col("text")).alias("text")).groupBy("conv_id").agg(*map(latest, roles))


def last_response(messages: DataFrame, role: str) -> DataFrame:
    return last_responses(messages, [role]).withColumnRenamed(role, "response")


def response_fallback(messages: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each named result the latest text of the first of its roles that said something, else ""."""
    roles = list(dict.fromkeys(role for order in wanted.values() for role in order))
    latest = last_responses(messages, roles)
    return latest.select(
        "conv_id",
        *[
            first_match([(F.col(role) != "", F.col(role)) for role in order], "").alias(name)
            for name, order in wanted.items()
        ],
    )


def code_blocks(texts: DataFrame, id_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """One row per fenced block with its position."""
    return texts.select(id_col, F.posexplode(fenced_blocks(F.col(text_col))).alias("position", "block"))


def stage_blocks(blocks: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The last block of each stage; blocks without a marker are left out. Null is an id like others; of several blocks
    in one position the greatest counts."""
    marked = blocks.withColumn("stage", stage_of(F.col("block"))).where(F.col("stage").isNotNull())
    return marked.groupBy(id_col, "stage").agg(F.max_by("block", F.struct("position", "block")).alias("block"))


def artifacts(messages: DataFrame, code_role: str, test_role: str, plan_role: str) -> DataFrame:
    """Per conversation: code blocks of one speaker, test blocks of another, the last text of a third."""
    latest = last_responses(messages, list(dict.fromkeys((code_role, test_role, plan_role))))
    return latest.select(
        "conv_id",
        fenced_blocks(F.col(code_role)).alias("code_blocks"),
        fenced_blocks(F.col(test_role)).alias("test_blocks"),
        F.col(plan_role).alias("plan"),
    )


def message_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(
        F.count(F.lit(1)).alias("messages"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"),
    )


def text_snippets(messages: DataFrame, limit: int = fx.SNIPPET_CHARS) -> DataFrame:
    return messages.select("conv_id", "turn", snippet(F.col("text"), limit).alias("snippet"))


def conversation_export(messages: DataFrame) -> DataFrame:
    """Messages as JSON documents, in conversation order once written: one line per message.

    A line per message, not one array per conversation, so that no conversation has to fit in one row.
    """
    document = F.to_json(F.struct(F.col("role").alias("name"), F.col("text").alias("content")))
    return messages.select("conv_id", "turn", document.alias("message"))


def write_conversations(messages: DataFrame, path: str) -> None:
    """JSON Lines files in (conv_id, turn) order."""
    (
        messages.select("conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("content"))
        .repartitionByRange("conv_id", "turn")
        .sortWithinPartitions("conv_id", "turn")
        .write.mode("overwrite")
        .json(path)
    )
