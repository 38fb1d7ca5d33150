"""Validated suites and run records from files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.errors import ENV_ERROR, CorpusError
from corpusgate.operators.rules import require_valid, valid_records, validate
from corpusgate.session import prepare
from corpusgate.sources.lines import read_records

RUN_RECORD = (
    "model string, method string, dataset struct<sha256:string,line_count:bigint>, "
    "hyperparameters variant, timestamp string, _corrupt_record string"
)


def read_suite(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, index, line_no, task, input, expected_output)``.

    Raises on the first bad line; ``index`` is the 0-based position in the file.
    """
    judged = validate(read_records(spark, path), "task")
    require_valid(judged, ["file", "line_no"])
    return valid_records(judged)


def read_runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Run records of many run directories, one JSON document per file.

    A file that is not a run record stays as a row with ``_corrupt_record`` set.
    """
    prepare(spark)
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        raise CorpusError(
            ENV_ERROR, f"cannot read run records at {path}", "Check that the path exists."
        ) from exc
    record = F.from_json("value", RUN_RECORD, {"mode": "PERMISSIVE"})
    return texts.select(F.col("_metadata.file_path").alias("file"), record.alias("r")).select("file", "r.*")
