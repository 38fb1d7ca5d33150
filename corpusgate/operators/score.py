"""Exact-match scoring of predictions against an evaluation suite."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgate.functions.json import HIDDEN
from corpusgate.functions.text import strip

Predictor = Callable[[pd.Series], pd.Series]


def predict(prompted: DataFrame, load: Callable[[], Predictor]) -> DataFrame:
    """Add ``prediction`` from a user-supplied model.

    ``load`` runs once per task and returns a function from a batch of prompts
    to a batch of predictions; batches arrive over Arrow.
    """
    schema = T.StructType(prompted.schema.fields + [T.StructField("prediction", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(prediction=model(batch["prompt"]))

    return prompted.mapInPandas(run, schema)


def drop_echo(prompt: Column, prediction: Column) -> Column:
    """The prediction without the prompt, where a model repeats it first."""
    rest = F.substring(prediction, F.length(prompt) + 1, F.length(prediction))
    return F.when(F.startswith(prediction, prompt), rest).otherwise(prediction)


def one_prediction(predictions: DataFrame, on: list[str]) -> DataFrame:
    """One row per item: copies collapse, of several texts the smallest counts.

    ``n_predictions`` keeps the number of rows seen. The aggregate merges before
    the shuffle, and its partitioning is the one the join needs.
    """
    return predictions.groupBy(*on).agg(
        F.min("prediction").alias("prediction"), F.count("*").alias("n_predictions")
    )


def exact_match(prediction: Column, expected: Column) -> Column:
    """Equal after stripping both; case counts; no prediction is no match."""
    return F.coalesce(strip(prediction) == strip(expected), F.lit(False))


def score(suite: DataFrame, predictions: DataFrame, on: list[str], salt: int = 1) -> DataFrame:
    """Join predictions onto the suite and mark exact matches.

    ``on`` identifies an item; every item stays, also without a prediction. A column
    of the suite that is named like an added one is kept as ``suite_...``.
    Items are normally unique. If one key holds many suite rows, ``salt`` deals
    them out over that many tasks, copies of a row too, each task with its own copy
    of the key's single prediction.
    """
    single = one_prediction(predictions, on)
    suite = suite.withColumnsRenamed({c: f"suite_{c}" for c in ("prediction", "n_predictions", "exact_match")})
    if salt > 1:
        part = f"{HIDDEN}salt"
        suite = suite.withColumn(part, F.pmod(F.xxhash64(*suite.columns, F.spark_partition_id()), F.lit(salt)))
        salts = F.array(*[F.lit(i).cast("bigint") for i in range(salt)])
        single = single.withColumn(part, F.explode(salts))
        joined = suite.join(single, [*on, part], "left").drop(part)
    else:
        joined = suite.join(single, on, "left")
    return joined.withColumn("exact_match", exact_match(F.col("prediction"), F.col("expected_output")))


def score_predicted(predicted: DataFrame, skip_echo: bool = False) -> DataFrame:
    """Score rows that already carry their prediction; no join."""
    text = F.col("prediction")
    if skip_echo:
        text = drop_echo(F.col("prompt"), text)
    return predicted.withColumn("exact_match", exact_match(text, F.col("expected_output")))


def _percent(exact: Column, total: Column) -> Column:
    """``100 * exact / total`` to two digits, half to even; 0.0 without items.

    Decimal arithmetic rounds exact ties to even, as binary floats do for ties
    they can hold; for other decimal ties a float's own error decides.
    """
    share = (exact * 100).cast("decimal(20,0)") / F.nullif(total, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(F.bround(share, 2).cast("double"), F.lit(0.0))


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), F.count_if("exact_match").alias("exact_match")]


def _with_percent(counts: DataFrame) -> DataFrame:
    return counts.withColumn("exact_match_pct", _percent(F.col("exact_match"), F.col("total")))


def score_total(scored: DataFrame) -> DataFrame:
    """One row: total, exact_match, exact_match_pct."""
    return _with_percent(scored.agg(*_counts()))


def score_by(scored: DataFrame, by: str = "task") -> DataFrame:
    """One row per ``by`` and one for all of them, which ``is_total`` tells from
    that of a NULL."""
    return _with_percent(scored.rollup(by).agg((F.grouping(by) == 1).alias("is_total"), *_counts()))
