"""Classification of training requests and job logs by small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.params import is_large, largest_param_count
from corpusgate.functions.text import contains_any, label

# Method label -> class.
METHOD_CLASSES = [
    ("lora", "adapter"),
    ("qlora", "adapter"),
    ("full", "full_tuning"),
    ("full_ft", "full_tuning"),
    ("full-ft", "full_tuning"),
    ("fullft", "full_tuning"),
]

# Exit status -> class; anything else is "infrastructure".
EXIT_CLASSES = [(0, "ok"), (1, "user"), (2, "environment"), (137, "out_of_memory")]

# Signs of an out-of-memory failure.
OOM_NAMES = ["outofmemory", "acceleratorerror"]
OOM_TEXTS = ["out of memory"]


def with_scope(df: DataFrame, model: str, method: str) -> DataFrame:
    """Add ``scope_class, ok, out_of_scope, warning, scope_message, downgrade_to``.

    The lookup table has six rows, whatever the data. A null method is unsupported; it
    and a null model are shown as empty.
    """
    spark = df.sparkSession
    table = F.broadcast(
        spark.createDataFrame(METHOD_CLASSES, "_label string, scope_class string")
    )
    joined = df.withColumn("_label", label(F.col(method))).join(table, "_label", "left")
    kind = F.coalesce("scope_class", F.lit("unsupported"))
    ok = kind == "adapter"
    shown = F.concat(F.lit("method '"), F.coalesce(F.col(method), F.lit("")), F.lit("'"))
    warning = F.when(
        kind == "full_tuning", F.concat(shown, F.lit(" trains all weights; use lora or qlora"))
    ).when(kind == "unsupported", F.concat(shown, F.lit(" is not supported; use lora or qlora")))
    request = F.concat(F.lit("model '"), F.coalesce(F.col(model), F.lit("")), F.lit("' with "), shown)
    return joined.drop("_label").withColumns(
        {
            "scope_class": kind,
            "ok": ok,
            "out_of_scope": ~ok,
            "warning": warning,
            "scope_message": F.concat(
                request, F.when(ok, " is in scope").otherwise(" is out of scope")
            ),
            "downgrade_to": F.when(~ok, "lora"),
        }
    )


def with_model_size(df: DataFrame, model: str) -> DataFrame:
    """Add ``params_b`` (NULL when no count is named) and ``large``."""
    return df.withColumns(
        {"params_b": largest_param_count(F.col(model)), "large": is_large(F.col(model))}
    )


def with_exit_class(df: DataFrame, code: str) -> DataFrame:
    """Add ``exit_class``; the lookup table has four rows."""
    table = F.broadcast(
        df.sparkSession.createDataFrame(EXIT_CLASSES, "_code bigint, exit_class string")
    )
    joined = df.join(table, F.col(code).cast("bigint") == F.col("_code"), "left").drop("_code")
    return joined.withColumn("exit_class", F.coalesce("exit_class", F.lit("infrastructure")))


def is_oom(name: Column, message: Column) -> Column:
    """Whether an error's class name or message tells of exhausted memory."""
    return contains_any(name, OOM_NAMES) | contains_any(message, OOM_TEXTS)
