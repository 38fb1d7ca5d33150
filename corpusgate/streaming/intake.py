"""Continuous intake of arriving line files and running validation counts.

Counts exist in two forms. ``start_counts`` writes what each batch holds and keeps no
state. ``start_running_counts`` keeps the totals of open windows in the state store and
forgets a window once the watermark has passed it; rows that come later still are what
``late_counts`` shows, so that both together hold every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgate.errors import ENV_ERROR, CorpusError
from corpusgate.functions.digest import sha256_hex
from corpusgate.operators.rules import validate
from corpusgate.session import prepare
from corpusgate.sinks.files import write_judged


def line_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``(file, arrived, line_id, value)`` of files as they arrive.

    A stream has no line numbers; ``file`` and the hash of the line name a row.
    """
    prepare(spark)
    return (
        spark.readStream.options(**options)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("arrived"),
            sha256_hex(F.col("value")).alias("line_id"),
            "value",
        )
    )


def _holds_files(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and len(system.listStatus(place)) > 0


def _start(stream: DataFrame, write, out: str, checkpoint: str, trigger: dict | None, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch and its folder below ``out`` to ``write``.

    Folders are numbered by the checkpoint, so a repeated batch overwrites itself. A
    fresh checkpoint would number other batches alike; it is refused for an output
    that holds something.
    """
    spark = stream.sparkSession
    if _holds_files(spark, out) and not _holds_files(spark, f"{checkpoint}/offsets"):
        raise CorpusError(
            ENV_ERROR,
            f"{out} holds batches of another checkpoint",
            "Name the checkpoint that belongs to it, or a new output folder.",
        )
    return (
        stream.writeStream.foreachBatch(lambda batch, number: write(batch, f"{out}/batch={number}"))
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_intake(
    stream: DataFrame,
    schema: str,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Validate a stream of lines into ``out/batch=N/verdict=…``."""

    def write(batch: DataFrame, folder: str) -> None:
        write_judged(batch, folder, mode="overwrite")

    return _start(validate(stream, schema), write, out, checkpoint, trigger)


def arrival_counts(validated: DataFrame, time: str = "arrived", seconds: int = 3600) -> DataFrame:
    """``(window_start, window_end, rule, n)``: rows per rule and window of ``seconds``.

    Rows without a time are counted under a NULL window.
    """
    width = F.lit(seconds * 1_000_000).cast("bigint")
    micros = F.unix_micros(time)
    start = micros - F.pmod(micros, width)
    rule = F.coalesce("rule", F.lit("valid")).alias("rule")
    return validated.groupBy(
        F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + width).alias("window_end"), rule
    ).agg(F.count("*").alias("n"))


def start_counts(
    validated: DataFrame,
    out: str,
    checkpoint: str,
    time: str = "arrived",
    seconds: int = 3600,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write each batch's counts; ``read_counts`` adds them up.

    No state is kept and no row is too late.
    """

    def write(batch: DataFrame, folder: str) -> None:
        arrival_counts(batch, time, seconds).write.mode("overwrite").parquet(folder)

    return _start(validated, write, out, checkpoint, trigger)


def running_counts(validated: DataFrame, time: str = "arrived", seconds: int = 3600, delay: str = "1 hour") -> DataFrame:
    """``(window_start, window_end, rule, n)`` of a stream, by stateful aggregation.

    A window is forgotten ``delay`` after the latest time seen before the batch, so the
    state holds the windows of that span and no more. Rows for forgotten windows, and
    rows without a time, are left out.
    """
    rule = F.coalesce("rule", F.lit("valid")).alias("rule")
    counts = validated.withWatermark(time, delay).groupBy(F.window(time, f"{int(seconds)} seconds").alias("w"), rule)
    return counts.agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rule", "n"
    )


def start_running_counts(
    validated: DataFrame,
    out: str,
    checkpoint: str,
    time: str = "arrived",
    seconds: int = 3600,
    delay: str = "1 hour",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write, batch by batch, the new totals of the windows that changed."""

    def write(batch: DataFrame, folder: str) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return _start(running_counts(validated, time, seconds, delay), write, out, checkpoint, trigger, "update")


def read_running_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last total of each window and rule. Totals only grow, so it is the largest."""
    return spark.read.parquet(out).groupBy("window_start", "window_end", "rule").agg(F.max("n").alias("n"))


def late_counts(all_counts: DataFrame, running: DataFrame) -> DataFrame:
    """The rows of ``read_counts`` that ``read_running_counts`` does not hold: those that
    came after their window was forgotten, and, under a NULL window, those without a time."""
    keys = ["window_start", "window_end", "rule"]
    alike = F.lit(True)
    for k in keys:
        alike = alike & F.col(f"a.{k}").eqNullSafe(F.col(f"r.{k}"))
    late = F.col("a.n") - F.coalesce("r.n", F.lit(0))
    joined = all_counts.alias("a").join(running.alias("r"), alike, "left")
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], late.alias("n")).filter("n > 0")


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts over all batches so far."""
    return spark.read.parquet(out).groupBy("window_start", "window_end", "rule").agg(F.sum("n").alias("n"))
