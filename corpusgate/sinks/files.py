"""Sinks: training text, accepted and rejected lines, manifests, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.session import new_path


def write_text_column(rendered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The ``text`` column alone, as Parquet."""
    rendered.select("text").write.mode(mode).parquet(path)


def write_chat_lines(turns: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Turns ``(conv_id, turn, role, text)`` as chat records, one JSON line for each
    conversation, however many turns it has.

    Turns are sorted by conversation and position and written one by one, each with the
    part of the line around it, so no task ever holds a conversation: the writer's
    separator is a blank, which JSON allows between values, and the last turn brings the
    line end. Repeated deliveries of a message are one; different messages at one
    position are all kept, by role and text. Lines but the first of a file begin with a
    blank, and a file may end in one.
    """
    turn = turns.select("conv_id", "turn", "role", F.col("text").alias("content")).distinct()
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    first = F.lag(F.lit(1)).over(place).isNull()
    last = F.lead(F.lit(1)).over(place).isNull()
    message = F.to_json(F.struct("role", "content"), {"ignoreNullFields": "false"})
    piece = F.concat(F.when(first, '{"messages":[').otherwise(","), message, F.when(last, "]}\n").otherwise(""))
    pieces = turn.select(piece.alias("value"))
    pieces.write.mode(mode).option("lineSep", " ").option("maxRecordsPerFile", 0).text(path)


def with_verdict(validated: DataFrame) -> DataFrame:
    """Add ``verdict``; a rejected line keeps its text, an accepted one its record."""
    bad = F.col("rule").isNotNull()
    return validated.withColumn("verdict", F.when(bad, "rejected").otherwise("accepted")).withColumn(
        "value", F.when(bad, F.col("value"))
    )


def write_judged(validated: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Accepted and rejected lines in one pass, as two ``verdict=`` folders.

    One job, no shuffle and no cached copy: each task writes both folders.
    """
    with_verdict(validated).write.mode(mode).partitionBy("verdict").parquet(path)


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    judged = spark.read.parquet(path).filter("verdict = 'accepted'")
    return judged.drop("verdict", "value", "rule", "message", "remediation")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("verdict = 'rejected'").drop("verdict", "record")


def write_manifest(manifest: DataFrame, path: str, history: str | None = None) -> None:
    """The run record as JSON, and appended to a Parquet history if one is named.

    The record is computed once, so both hold the same time and digests.
    """
    once = new_path(manifest.sparkSession, "manifest")
    manifest.withColumn("hyperparameters", F.to_json("hyperparameters")).write.parquet(once)
    made = manifest.sparkSession.read.parquet(once)
    manifest = made.withColumn("hyperparameters", F.parse_json("hyperparameters"))
    manifest.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    if history is not None:
        made.write.mode("append").parquet(history)


def result_json(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows as JSON text; characters beyond ASCII stay as they are."""
    return df.select(
        F.to_json(F.struct(*(cols or df.columns)), {"ignoreNullFields": "false"}).alias("value")
    )


def write_results(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-item evaluation rows as Parquet."""
    scored.write.mode(mode).parquet(path)
