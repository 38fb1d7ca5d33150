"""Token counts, and how much of a corpus goes beyond a length budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.text import UNICODE_WHITESPACE

# The default sequence length of a run.
MAX_SEQ_LEN = 2048
QUANTILES = (0.5, 0.9, 0.99)
ACCURACY = 10_000

Counter = Callable[[list[str]], list[int]]


def words(text: Column) -> Column:
    """Words between white space; an approximation of tokens that needs no tokenizer."""
    spaces = "[" + UNICODE_WHITESPACE.replace(" ", "\\ ") + "]+"
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{spaces}|{spaces}$", "")
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, spaces)))


def tokenizer_file(path: str, add_special_tokens: bool = True) -> Callable[[], Counter]:
    """A loader for ``token_counter`` from a tokenizer file that all executors can read."""

    def load() -> Counter:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)]

    return load


def token_counter(load: Callable[[], Counter], rows_at_once: int = 256, chars_at_once: int = 1 << 20):
    """A column function from text to its number of tokens; null counts as empty.

    ``load`` runs once in a task and returns a function from texts to counts. Texts are
    handed to it in runs of at most ``rows_at_once`` and about ``chars_at_once``, so
    memory does not follow the size of a batch.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load()
        for batch in batches:
            out: list[int] = []
            some: list[str] = []
            size = 0
            for text in batch.fillna(""):
                if some and (len(some) >= rows_at_once or size + len(text) > chars_at_once):
                    out += counter(some)
                    some, size = [], 0
                some.append(text)
                size += len(text)
            if some:
                out += counter(some)
            yield pd.Series(out, dtype="int64")

    return count


def over_budget(rows: DataFrame, length: str, budget: int = MAX_SEQ_LEN) -> DataFrame:
    """The rows that are longer than the budget; a filter."""
    return rows.filter(F.col(length) > budget)


def length_budget(
    rows: DataFrame,
    length: str,
    by: list[str] | None = None,
    budget: int = MAX_SEQ_LEN,
    quantiles: tuple[float, ...] = QUANTILES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``(by, rows, total, longest, over, cut, quantiles)`` of a column of lengths.

    ``over`` rows are longer than ``budget`` and ``cut`` is how many tokens they have
    beyond it; both are exact, as are the sums. ``quantiles`` come from a sketch that
    merges across tasks: the rank of each is off by at most ``1 / accuracy`` of the
    rows. Buffers have a fixed size, so a group of any number of rows is reduced before
    the shuffle. Null lengths are rows without a length.
    """
    value = F.col(length).cast("bigint")
    beyond = F.greatest(value - budget, F.lit(0).cast("bigint"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(value), F.lit(0)).alias("total"),
        F.max(value).alias("longest"),
        F.count_if(value > budget).alias("over"),
        F.coalesce(F.sum(beyond), F.lit(0)).alias("cut"),
        F.percentile_approx(value, list(quantiles), accuracy).alias("quantiles"),
    )
