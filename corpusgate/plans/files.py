"""Queries that pass through line files and streams.

Each writes the given table as JSON lines below the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.operators.fingerprint import corpus_digest, file_digests, line_digests
from corpusgate.operators.reports import file_report as report_of
from corpusgate.operators.rules import validate
from corpusgate.plans.chat import sql_hash
from corpusgate.plans.tables import damaged_task_lines, table
from corpusgate.plans.tasks import JUDGED
from corpusgate.session import new_path, prepare
from corpusgate.sources.lines import read_records, running_offsets
from corpusgate.streaming.intake import (
    late_counts,
    line_stream,
    read_counts,
    read_running_counts,
    start_counts,
    start_intake,
    start_running_counts,
)


def _turn_files(spark: SparkSession, sf_dir: str) -> str:
    """Turns as sorted JSON line files, a blank line before every system turn."""
    path = new_path(spark, "turns")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    (
        table(spark, sf_dir, "conversations")
        .repartitionByRange("conv_id", "turn")
        .sortWithinPartitions("conv_id", "turn")
        .select(F.when(F.col("role") == "system", F.concat(F.lit("\n"), line)).otherwise(line))
        .write.text(path)
    )
    return path


def _task_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "tasks")
    damaged_task_lines(spark, sf_dir).select("value").write.text(path)
    return path


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line number and record position of every turn in the sorted files.

    Positions count through the files in name order: running sums over one row
    per file, in two levels, are joined back onto the lines.
    """
    lines = read_records(spark, _turn_files(spark, sf_dir))
    key = F.from_json("value", "conv_id bigint, turn bigint")
    last = lines.groupBy("file").agg(
        F.max("line_no").alias("n_lines"), F.max("index").alias("last_index")
    )
    counted = last.select("file", F.col("n_lines").alias("lines"), (F.col("last_index") + 1).alias("records"))
    offsets = running_offsets(counted, "file", ["lines", "records"])
    return lines.join(offsets.drop("lines", "records"), "file").select(
        key["conv_id"].alias("conv_id"),
        key["turn"].alias("turn"),
        (F.col("line_no") + F.col("lines_before")).alias("line_no"),
        (F.col("index") + F.col("records_before")).alias("record_index"),
    )


LINE_NUMBERS = """
SELECT conv_id, turn,
       row_number() OVER w + count(*) FILTER (role = 'system') OVER w AS line_no,
       row_number() OVER w - 1 AS record_index
FROM conversations WINDOW w AS (ORDER BY conv_id, turn)
"""


def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the per-file validation report."""
    per_file = report_of(spark, _task_files(spark, sf_dir), "task")
    return per_file.agg(
        *[F.sum(c).alias(c) for c in ("lines", "blanks", "records", "valid", "invalid")]
    )


FILE_REPORT = f"""
SELECT count(*) AS lines, 0::BIGINT AS blanks, count(*) AS records,
       count(*) FILTER (rule IS NULL) AS valid, count(rule) AS invalid FROM {JUDGED}
"""


def _shard_files(spark: SparkSession, sf_dir: str) -> str:
    """Turns as sixteen files whose contents follow from the table alone."""
    path = new_path(spark, "shards")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    (
        table(spark, sf_dir, "conversations")
        .withColumn("shard", F.expr("conv_id % 16"))
        .repartition("shard")
        .sortWithinPartitions("shard", "conv_id", "turn", "role", "text")
        .select("shard", F.when(F.col("role") == "system", F.concat(F.lit("\n"), line)).otherwise(line).alias("value"))
        .write.partitionBy("shard")
        .text(path)
    )
    return path


def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, records and digest of every file."""
    return file_digests(spark, _shard_files(spark, sf_dir)).select("bytes", "line_count", "sha256")


FILE_FINGERPRINT = """
SELECT sum(strlen(line))::BIGINT AS bytes, count(*) AS line_count,
       sha256(string_agg(line, '' ORDER BY conv_id, turn, role, text)) AS sha256
FROM (SELECT *, CASE WHEN role = 'system' THEN chr(10) ELSE '' END
             || to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text})::VARCHAR || chr(10) AS line
      FROM conversations)
GROUP BY conv_id % 16
"""


def file_line_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, lines and splittable digest of every file."""
    return line_digests(spark, _shard_files(spark, sf_dir)).select("bytes", "lines", "digest")


FILE_LINE_DIGEST = f"""
WITH rows AS (
  SELECT conv_id % 16 AS shard, conv_id, turn, role, text,
         unnest(CASE WHEN role = 'system' THEN ['', line] ELSE [line] END) AS line, unnest(CASE WHEN role = 'system' THEN [0, 1] ELSE [1] END) AS part
  FROM (SELECT *, to_json({{'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text}})::VARCHAR AS line FROM conversations)),
numbered AS (SELECT shard, line, row_number() OVER (PARTITION BY shard ORDER BY conv_id, turn, role, text, part) AS line_no FROM rows)
SELECT sum(strlen(line) + 1)::BIGINT AS bytes, count(*) AS lines,
       sha256(sum(strlen(line) + 1)::BIGINT::VARCHAR || ':' || sum({sql_hash('line_no::VARCHAR', 'line')})::VARCHAR) AS digest
FROM numbered GROUP BY shard
"""


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the contents of all files; their names are new in each run."""
    return corpus_digest(file_digests(spark, _shard_files(spark, sf_dir)))


CORPUS_FINGERPRINT = f"""
SELECT count(*) AS files, sum(line_count)::BIGINT AS line_count,
       sum(('0x' || left(sha256('s64:' || sha256), 15))::BIGINT)::VARCHAR AS digest
FROM ({FILE_FINGERPRINT})
"""


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per rule after streaming intake of the task files."""
    lines = line_stream(spark, _task_files(spark, sf_dir))
    out = new_path(spark, "intake")
    start_intake(lines, "task", out, new_path(spark, "intake-state")).awaitTermination()
    rule = F.coalesce("rule", F.lit("valid")).alias("rule")
    return spark.read.parquet(out).groupBy("verdict", rule).agg(F.count("*").alias("n"))


STREAM_INTAKE = f"""
SELECT CASE WHEN rule IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, coalesce(rule, 'valid') AS rule, count(*) AS n FROM {JUDGED} GROUP BY 1, 2
"""


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat lines per rule and hour of a stream of the events: the totals from the state
    store, and the rows that came after their window was forgotten."""
    prepare(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    kind = F.col("event_type")
    role = F.when(kind == "view", "user").when(kind == "click", "assistant").otherwise(kind)
    message = F.array(F.struct(role.alias("role"), F.col("props").alias("content")))
    # The table's times carry no zone; they are read, and shown, as UTC.
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    lines = events.select(
        utc.cast("timestamp").alias("ts"),
        F.to_json(F.struct(message.alias("messages"))).alias("value"),
    )
    judged = validate(lines, "chat")
    every, open_ = new_path(spark, "counts"), new_path(spark, "running")
    runs = [
        start_counts(judged, every, new_path(spark, "counts-state"), "ts"),
        start_running_counts(judged, open_, new_path(spark, "running-state"), "ts"),
    ]
    for run in runs:
        run.awaitTermination()
    running = read_running_counts(spark, open_)
    rows = running.unionByName(late_counts(read_counts(spark, every), running))
    shown = F.to_utc_timestamp("window_start", F.current_timezone())
    hour = F.date_format(shown, "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rows.groupBy(hour, "rule").agg(F.sum("n").alias("n"))


STREAM_COUNTS = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       CASE WHEN event_type IN ('view', 'click') THEN 'valid' ELSE 'role_invalid' END AS rule,
       count(*) AS n
FROM events
GROUP BY 1, 2
"""

QUERIES = {
    "line_numbers": (line_numbers, LINE_NUMBERS),
    "file_report": (file_report, FILE_REPORT),
    "file_fingerprint": (file_fingerprint, FILE_FINGERPRINT),
    "file_line_digest": (file_line_digest, FILE_LINE_DIGEST),
    "corpus_fingerprint": (corpus_fingerprint, CORPUS_FINGERPRINT),
    "stream_intake": (stream_intake, STREAM_INTAKE),
    "stream_counts": (stream_counts, STREAM_COUNTS),
}
