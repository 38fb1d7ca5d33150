"""Classification queries over the events table, read as a log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.operators.classify import is_oom, with_exit_class, with_model_size, with_scope
from corpusgate.plans.tables import table

_K = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _by_type(**values: str) -> Column:
    out = None
    for name, value in values.items():
        test = F.col("event_type") == name
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def scope_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope of every request, the method written in various ways."""
    method = _by_type(view=" LoRA ", click="QLORA", signup="full", purchase="Full-FT", error="prefix")
    requests = table(spark, sf_dir, "events").select(
        "event_id", F.lit("base-8b").alias("model"), method.alias("method")
    )
    return with_scope(requests, "model", "method").select(
        "event_id", "scope_class", "ok", "out_of_scope", "warning", "scope_message", "downgrade_to"
    )


SCOPE_CLASSES = """
WITH r AS (SELECT event_id, event_type IN ('view', 'click') AS ok,
  CASE event_type WHEN 'view' THEN ' LoRA ' WHEN 'click' THEN 'QLORA' WHEN 'signup' THEN 'full'
    WHEN 'purchase' THEN 'Full-FT' ELSE 'prefix' END AS m,
  CASE WHEN event_type IN ('view', 'click') THEN 'adapter'
    WHEN event_type IN ('signup', 'purchase') THEN 'full_tuning' ELSE 'unsupported' END AS c FROM events)
SELECT event_id, c AS scope_class, ok, NOT ok AS out_of_scope,
  CASE c WHEN 'full_tuning' THEN 'method ''' || m || ''' trains all weights; use lora or qlora'
    WHEN 'unsupported' THEN 'method ''' || m || ''' is not supported; use lora or qlora' END AS warning,
  'model ''base-8b'' with method ''' || m || CASE WHEN ok THEN ''' is in scope' ELSE ''' is out of scope' END AS scope_message,
  CASE WHEN NOT ok THEN 'lora' END AS downgrade_to FROM r
"""


def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest parameter count named in model identifiers of five shapes."""
    user, k = F.col("user_id").cast("string"), _k().cast("string")
    kind = F.col("event_type")
    model = (
        F.when(kind == "view", F.concat(F.lit("org/base-"), user, F.lit("B-a"), k, F.lit("b")))
        .when(kind == "click", F.concat(F.lit("base_v"), user, F.lit("."), k, F.lit("b")))
        .when(kind == "signup", F.concat(k, F.lit("."), user, F.lit("b-instruct")))
        .when(kind == "purchase", F.concat(F.lit("base-"), user, F.lit("b-"), k, F.lit("b")))
        .otherwise(F.concat(F.lit("base-"), user, F.lit("bx")))
    )
    sized = with_model_size(table(spark, sf_dir, "events").withColumn("model", model), "model")
    return sized.select("event_id", "params_b", "large")


MODEL_SIZE = f"""
WITH s AS (SELECT event_id, CASE event_type WHEN 'view' THEN user_id::DOUBLE WHEN 'click' THEN NULL
    WHEN 'signup' THEN CAST(k || '.' || user_id AS DOUBLE)
    WHEN 'purchase' THEN greatest(user_id, k)::DOUBLE END AS params_b
  FROM (SELECT *, {_K} AS k FROM events))
SELECT event_id, params_b, coalesce(params_b > 10, false) AS large FROM s
"""


def exit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs per class of exit status."""
    code = F.when(F.col("event_type") == "error", _k() + 100).otherwise(_k())
    jobs = with_exit_class(table(spark, sf_dir, "events").select(code.alias("code")), "code")
    return jobs.groupBy("exit_class").agg(F.count("*").alias("n"), F.sum("code").alias("codes"))


EXIT_CLASSES = f"""
SELECT CASE code WHEN 0 THEN 'ok' WHEN 1 THEN 'user' WHEN 2 THEN 'environment'
         WHEN 137 THEN 'out_of_memory' ELSE 'infrastructure' END AS exit_class,
       count(*) AS n, sum(code)::BIGINT AS codes
FROM (SELECT CASE WHEN event_type = 'error' THEN {_K} + 100 ELSE {_K} END AS code FROM events) GROUP BY 1
"""


def oom_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that tell of exhausted memory, by error name or message."""
    name = _by_type(view="torch.OutOfMemoryError", click="AcceleratorError", signup="RuntimeError")
    message = F.when(
        F.col("value") < 10, F.concat(F.lit("CUDA error: Out of Memory at step "), _k().cast("string"))
    ).otherwise(F.concat(F.lit("failed at step "), _k().cast("string")))
    return table(spark, sf_dir, "events").select("event_id", is_oom(name, message).alias("oom"))


OOM_CLASSES = """
SELECT event_id, event_type IN ('view', 'click') OR value < 10 AS oom FROM events
"""

QUERIES = {
    "scope_classes": (scope_classes, SCOPE_CLASSES),
    "model_size": (model_size, MODEL_SIZE),
    "exit_classes": (exit_classes, EXIT_CLASSES),
    "oom_classes": (oom_classes, OOM_CLASSES),
}
