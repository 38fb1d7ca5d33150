"""Queries over documents as task records, and scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.digest import sha256_hex
from corpusgate.functions.text import ASCII_WHITESPACE, UNICODE_WHITESPACE, strip, strip_ascii
from corpusgate.operators.detect import schema_profile as profile
from corpusgate.operators.render import prompts, render_task
from corpusgate.operators.rules import (
    first_violation,
    rule_counts,
    summarise,
    valid_records,
    validate,
)
from corpusgate.operators.score import (
    predict,
    score,
    score_by,
    score_predicted,
    score_total as total_of,
)
from corpusgate.plans.tables import NBSP, damaged_task_lines, table
from corpusgate.sinks.files import result_json

_RULE = """
CASE doc_id % 10
  WHEN 0 THEN 'missing_key:expected_output' WHEN 1 THEN 'key_not_string:task'
  WHEN 2 THEN 'unexpected_keys' WHEN 3 THEN 'unexpected_keys' WHEN 4 THEN 'invalid_json'
  WHEN 5 THEN 'key_not_string:input' WHEN 6 THEN 'missing_key:task' WHEN 7 THEN 'not_object' END
"""
_MESSAGE = """
CASE doc_id % 10
  WHEN 0 THEN 'missing required key "expected_output"' WHEN 1 THEN '"task" must be a string, got int'
  WHEN 2 THEN 'unexpected keys [''bonus''] in task record'
  WHEN 3 THEN 'unexpected keys [''messages''] in task record' WHEN 4 THEN 'invalid JSON'
  WHEN 5 THEN '"input" must be a string, got NoneType' WHEN 6 THEN 'missing required key "task"'
  WHEN 7 THEN 'expected a JSON object, got list' END
"""
JUDGED = f"(SELECT doc_id, source, {_RULE} AS rule, {_MESSAGE} AS message FROM documents)"


def validate_task_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing rule and message of every damaged task line."""
    return validate(damaged_task_lines(spark, sf_dir), "task").select("doc_id", "rule", "message")


VALIDATE_TASK_RULES = f"SELECT doc_id, rule, message FROM {JUDGED}"


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, valid ones and first bad one per source."""
    return summarise(validate(damaged_task_lines(spark, sf_dir), "task"), ["source"], "doc_id")


VALIDATION_SUMMARY = f"""
SELECT source, count(*) AS records, count(*) FILTER (rule IS NULL) AS valid,
       count(rule) AS invalid, min(doc_id) FILTER (rule IS NOT NULL) AS first_bad_doc_id
FROM {JUDGED} GROUP BY source
"""


def task_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per rule."""
    return rule_counts(validate(damaged_task_lines(spark, sf_dir), "task"))


TASK_RULE_COUNTS = f"SELECT coalesce(rule, 'valid') AS rule, count(*) AS n FROM {JUDGED} GROUP BY 1"


def task_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bad line per source."""
    judged = validate(damaged_task_lines(spark, sf_dir), "task")
    return first_violation(judged, ["source"], ["doc_id"]).drop("remediation")


TASK_FIRST_VIOLATION = f"""
SELECT source, doc_id, rule, message FROM {JUDGED} j WHERE rule IS NOT NULL
  AND doc_id = (SELECT min(doc_id) FROM {JUDGED} k WHERE k.source = j.source AND k.rule IS NOT NULL)
"""


def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of detected schemas in a mixed corpus."""
    return profile(damaged_task_lines(spark, sf_dir))


SCHEMA_PROFILE = """
SELECT CASE WHEN doc_id % 10 IN (2, 4, 6, 7) THEN 'unknown' WHEN doc_id % 10 = 3 THEN 'chat'
            ELSE 'task' END AS detected, count(*) AS n FROM documents GROUP BY 1
"""


def task_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training text of every valid task line."""
    rendered = render_task(valid_records(validate(damaged_task_lines(spark, sf_dir), "task")), "</s>")
    return rendered.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), sha256_hex(F.col("text")).alias("sha256")
    )


TASK_RENDER = f"""
SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha256 FROM (
  SELECT doc_id, 'Task: ' || lang || chr(10) || 'Input: ' || text || chr(10) || 'Output: '
         || source || '</s>' AS t, {_RULE} AS rule FROM documents) WHERE rule IS NULL
"""


def _rated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A suite (is a document long?) and predictions (the labels' view of it).

    Labels cover some documents only, so predictions are missing for the rest.
    """
    suite = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("task"),
        F.when(F.col("n_chars") >= 1000, "good").otherwise("poor").alias("expected_output"),
    )
    word = F.when(F.col("quality") == 1, "good").otherwise("poor")
    predictions = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.concat(F.lit(NBSP), word, F.lit("\n")))
        .otherwise(word)
        .alias("prediction"),
    )
    return suite, predictions


_SCORED = """
(SELECT d.doc_id, d.lang AS task,
        CASE WHEN n_chars >= 1000 THEN 'good' ELSE 'poor' END AS expected_output,
        CASE WHEN quality IS NULL THEN NULL ELSE
          CASE WHEN toxic = 1 THEN chr(160) ELSE '' END || CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END
          || CASE WHEN toxic = 1 THEN chr(10) ELSE '' END END AS prediction,
        coalesce((n_chars >= 1000) = (quality = 1), false) AS exact_match
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
_PERCENT = "coalesce(round_even(sum(exact_match::INT) * 100.0 / nullif(count(*), 0), 2), 0)::DOUBLE"


def score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match per item."""
    return score(*_rated(spark, sf_dir), ["doc_id"]).drop("n_predictions")


SCORE_ITEMS = f"SELECT * FROM {_SCORED}"


def score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, matches and percentage of the whole suite."""
    return total_of(score(*_rated(spark, sf_dir), ["doc_id"]))


SCORE_TOTAL = f"""
SELECT count(*) AS total, sum(exact_match::INT)::BIGINT AS exact_match, {_PERCENT} AS exact_match_pct
FROM {_SCORED}
"""


def score_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per task, with a total row."""
    return score_by(score(*_rated(spark, sf_dir), ["doc_id"]))


SCORE_BY_TASK = f"""
SELECT task, grouping(task) = 1 AS is_total, count(*) AS total, sum(exact_match::INT)::BIGINT AS exact_match,
       {_PERCENT} AS exact_match_pct FROM {_SCORED} GROUP BY ROLLUP (task)
"""


def _byte_counter():
    """A stand-in model: repeats the prompt, then the input's size in bytes."""

    def answer(batch: pd.Series) -> pd.Series:
        size = batch.map(lambda p: len(p[len("Task: count\nInput: ") : -len("\nOutput:")].encode()))
        return batch + " " + size.astype(str)

    return answer


def predict_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a user-supplied model, scored with and without its echo.

    The task is to count characters; the stand-in counts bytes.
    """
    suite = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.lit("count").alias("task"),
        F.col("text").alias("input"),
        F.length("text").cast("string").alias("expected_output"),
    )
    predicted = predict(prompts(suite).drop("task", "input"), _byte_counter)
    plain = score_predicted(predicted).withColumnRenamed("exact_match", "exact_plain")
    return score_predicted(plain, skip_echo=True).select(
        "conv_id", "turn", "prediction", "exact_plain", "exact_match"
    )


PREDICT_STUB = """
SELECT conv_id, turn, 'Task: count' || chr(10) || 'Input: ' || text || chr(10) || 'Output: '
       || strlen(text) AS prediction, false AS exact_plain, strlen(text) = length(text) AS exact_match
FROM conversations
"""


def strip_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of every document after each of the two strips."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length(strip(F.concat(F.lit(f"\t{NBSP}"), text, F.lit(NBSP)))).cast("bigint").alias("stripped"),
        F.length(strip_ascii(F.concat(F.lit(f"\t{NBSP}"), text, F.lit(" ")))).cast("bigint").alias("stripped_ascii"),
    )


def _sql_chars(chars: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in chars)


STRIP_PROFILE = f"""
SELECT doc_id, length(trim(text, {_sql_chars(UNICODE_WHITESPACE)})) AS stripped,
       length(trim(chr(9) || chr(160) || text || ' ', {_sql_chars(ASCII_WHITESPACE)})) AS stripped_ascii
FROM documents
"""


def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one JSON text."""
    return result_json(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "text"])


RESULTS_JSON = """
SELECT to_json({'doc_id': doc_id, 'source': source, 'lang': lang, 'text': text})::VARCHAR AS value
FROM documents
"""

QUERIES = {
    "validate_task_rules": (validate_task_rules, VALIDATE_TASK_RULES),
    "validation_summary": (validation_summary, VALIDATION_SUMMARY),
    "task_rule_counts": (task_rule_counts, TASK_RULE_COUNTS),
    "task_first_violation": (task_first_violation, TASK_FIRST_VIOLATION),
    "schema_profile": (schema_profile, SCHEMA_PROFILE),
    "task_render": (task_render, TASK_RENDER),
    "score_items": (score_items, SCORE_ITEMS),
    "score_total": (score_total, SCORE_TOTAL),
    "score_by_task": (score_by_task, SCORE_BY_TASK),
    "predict_stub": (predict_stub, PREDICT_STUB),
    "strip_profile": (strip_profile, STRIP_PROFILE),
    "results_json": (results_json, RESULTS_JSON),
}
