"""From raw documents to packed training sequences, in five stages.

A stage takes ``(spark, docs, sf_dir)``, where ``docs`` was read from Parquet, and
returns a DataFrame that is written and read again for the next. Row identity is a
row's place in those files, so repeated rows and ids are told apart without a copy.
Texts that are null count as empty; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm import decontaminate, exact, packing, simhash, toxicity
from corpusgate.llm.common import staged, stored_row, table, without

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    score = toxicity.scorer(docs, table(spark, sf_dir, "labels"))
    return docs.filter(score("text") < 0.5).select(DOCUMENT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    groups = exact.exact_groups(docs, rid=stored_row())
    return without(docs, groups.filter("NOT kept")).select(DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    groups = staged(simhash.near_groups(docs, rid=stored_row()), "pipeline-near")
    first = groups.filter("doc_id <=> component_id").groupBy("root").agg(F.min("rid").alias("first"))
    first = first.select(F.col("first").alias("rid"))
    return without(docs, groups.select("rid").join(first, "rid", "left_anti")).select(DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), rid=stored_row())
    return without(docs, found.filter("contaminated")).select(DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
