"""Which schema a record, a file or a corpus uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.errors import USER_ERROR, CorpusError
from corpusgate.functions import json as J
from corpusgate.functions.messages import TASK_KEYS
from corpusgate.functions.text import sql_is_blank
from corpusgate.session import prepare
from corpusgate.sources.lines import drop_blank, file_names, raw_lines

OUTCOME = f"{J.HIDDEN}outcome"


def _detected() -> str:
    """``chat``, ``task`` or NULL for a parsed record.

    Any object with ``messages`` is chat, extra keys or not. An object whose
    keys all belong to the task schema and include ``task`` is task.
    """
    keys = J.keys()
    known = ", ".join(f"'{k}'" for k in TASK_KEYS)
    return (
        f"CASE WHEN array_contains({keys}, 'messages') THEN 'chat' "
        f"WHEN array_contains({keys}, 'task') AND size(array_except({keys}, array({known}))) = 0 "
        f"THEN 'task' END"
    )


def with_detected_schema(lines: DataFrame) -> DataFrame:
    """Add ``detected`` to the non-blank lines; one projection."""
    prepare(lines.sparkSession)
    J.require_free(lines, ["detected", "is_json"])
    outcome = (
        f"named_struct('detected', if({J.is_strict()}, {_detected()}, NULL), "
        f"'is_json', {J.is_strict()}, "
        f"'blank', {sql_is_blank('value')})"
    )
    settled = J.settled(J.parse_json(lines), OUTCOME, F.expr(outcome))
    return settled.filter(f"NOT {OUTCOME}.blank").select(
        *[f"`{c}`" for c in lines.columns], f"{OUTCOME}.detected", f"{OUTCOME}.is_json"
    )


def schema_profile(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Histogram of detected schemas; undetectable records count under ``unknown``."""
    name = F.coalesce("detected", F.lit("unknown")).alias("detected")
    return with_detected_schema(lines).groupBy(*(by or []), name).agg(F.count("*").alias("n"))


def detect_corpus_schema(
    spark: SparkSession, path: str | list[str], default: str | None = None
) -> str:
    """Schema of the corpus's first non-blank record, in file name and line order.

    Files are opened one by one until one holds a record. A scan of one file
    hands out its splits in order, and ``take`` starts with the first of them,
    so normally one split of one file is read. With ``default`` every failure
    to detect gives the default; without, it raises.
    """
    try:
        files = file_names(raw_lines(spark, path))
    except CorpusError:
        if default is not None:
            return default
        raise
    for file in files:
        first = drop_blank(raw_lines(spark, path, only_file=file)).select("value").take(1)
        if not first:
            continue
        row = with_detected_schema(spark.createDataFrame(first, "value string")).first()
        if row["detected"] is not None:
            return row["detected"]
        if default is not None:
            return default
        reason = "first record has no known schema" if row["is_json"] else "first record is not JSON"
        raise CorpusError(USER_ERROR, f"{file}: {reason}", "Use the chat or the task schema.")
    if default is not None:
        return default
    raise CorpusError(USER_ERROR, f"{path}: no record to detect a schema from", "Add records.")
