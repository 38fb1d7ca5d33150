"""Corpora built from a turn-level table ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Positions that the first of two aggregations puts together.
CHUNK_TURNS = 64


def assemble_chat(turns: DataFrame, span: int | None = None) -> DataFrame:
    """``(conv_id, part, messages)`` with messages in turn order.

    A conversation is one record, ``part`` 0, however long it is: stretches of turns
    are put together first and joined to the whole record then. With ``span`` it
    becomes one record for each ``turn div span``, which ``part`` numbers. The set
    aggregate merges repeated deliveries of one message before the shuffle;
    different messages at one position are all kept.
    """
    message = F.struct("turn", "role", F.col("text").alias("content"))
    part = F.expr(f"turn div {int(span)}") if span else F.lit(0).cast("bigint")
    return (
        turns.groupBy("conv_id", part.alias("part"), F.expr(f"turn div {CHUNK_TURNS}").alias("chunk"))
        .agg(F.collect_set(message).alias("some"))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("ordered"))
        .select(
            "conv_id",
            "part",
            F.transform(
                "ordered", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
            ).alias("messages"),
        )
    )


def chat_lines(records: DataFrame) -> DataFrame:
    """Replace ``messages`` by ``value``, the record as one JSON line."""
    rest = [c for c in records.columns if c != "messages"]
    return records.select(*rest, F.to_json(F.struct("messages")).alias("value"))


def reply_tasks(turns: DataFrame, salt: int = 1) -> DataFrame:
    """Task records ``(conv_id, turn, task, input, expected_output)``.

    Every user turn is paired with every assistant turn at the next position, as a
    join would, null texts and repeated rows included; rows without a conversation
    or position have no pair. Both rows map to the user's position, so one aggregate
    on ``(conv_id, position)`` pairs them: one scan, no self-join, and the rows of a
    long conversation spread over all tasks. The texts of one position are gathered
    in one group; ``salt`` deals a contested one over ``salt`` x ``salt`` groups, to
    which each row goes ``salt`` times.
    """
    user = F.col("role") == "user"
    position = F.when(user, F.col("turn")).otherwise(F.col("turn") - 1)
    rows = turns.filter(F.col("role").isin("user", "assistant")).select(
        "conv_id", position.alias("turn"), user.alias("user"), F.struct("text").alias("said")
    )
    rows = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    cell = []
    if salt > 1:
        own = F.pmod(F.xxhash64("said"), F.lit(salt))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).withColumn("own", own)
        cell = [
            F.when(F.col("user"), F.col("own")).otherwise(F.col("other")).alias("row"),
            F.when(F.col("user"), F.col("other")).otherwise(F.col("own")).alias("column"),
        ]
    return (
        rows.groupBy("conv_id", "turn", *cell)
        .agg(
            F.collect_list(F.when(F.col("user"), F.col("said"))).alias("asked"),
            F.collect_list(F.when(~F.col("user"), F.col("said"))).alias("replied"),
        )
        .select("conv_id", "turn", F.explode("asked").alias("asked"), "replied")
        .select("conv_id", "turn", "asked", F.explode("replied").alias("replied"))
        .select(
            "conv_id",
            "turn",
            F.lit("reply").alias("task"),
            F.col("asked.text").alias("input"),
            F.col("replied.text").alias("expected_output"),
        )
    )
