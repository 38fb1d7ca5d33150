"""Exact duplicates by deterministic naming of blocks and of pairs of names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import lists, map_texts, numbered, staged, table, text_bytes

BLOCK_BYTES = 16384


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _rows(docs: DataFrame, size: int, digest, rid) -> DataFrame:
    """``(rid, doc_id, text_sha256, digests)``, a digest for each block of the text."""

    def work(rows: pa.RecordBatch, _):
        data, bounds = text_bytes(rows.column(2))
        data = data.tobytes()
        shas, counts, digests = [], [], []
        for start, end in zip(bounds[:-1], bounds[1:]):
            text = data[start:end]
            blocks = _blocks(text, size)
            shas.append(hashlib.sha256(text).hexdigest())
            counts.append(len(blocks))
            digests += [digest(b) for b in blocks]
        return rows.column(0), rows.column(1), shas, lists(np.array(counts), digests, pa.binary())

    return map_texts(numbered(docs, rid), "rid string, doc_id bigint, text_sha256 string, digests array<binary>", work)


def _distinct_blocks(docs: DataFrame, size: int, digest) -> DataFrame:
    """``(block, digest)`` of all distinct blocks; equal ones of a task meet before the shuffle."""

    def work(rows: pa.RecordBatch, _):
        data, bounds = text_bytes(rows.column(0))
        data = data.tobytes()
        found = dict.fromkeys(b for s, e in zip(bounds[:-1], bounds[1:]) for b in _blocks(data[s:e], size))
        return list(found), [digest(b) for b in found]

    return map_texts(docs.select("text"), "block binary, digest binary", work).dropDuplicates(["block"])


def _named(distinct: DataFrame, by: list[str], keep: list[str], name: str) -> DataFrame:
    """Distinct values with integer names given in sorted order, task by task."""
    ordered = distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())
    return staged(ordered.select(*keep, "name"), name)


def _collides(names: DataFrame) -> bool:
    return not names.groupBy("digest").count().filter("count > 1").isEmpty()


def document_names(docs: DataFrame, size: int = BLOCK_BYTES, digest=None, rid: Column | None = None) -> DataFrame:
    """``(rid, doc_id, text_sha256, n_blocks, name)``: rows are equal texts exactly
    when they agree in ``n_blocks`` and ``name``.

    Blocks of ``size`` bytes are compared byte by byte: the distinct ones are sorted
    and named. A row finds its blocks' names by their 128-bit digests, which is
    exact as long as no two of the named blocks share one; that is checked, and if it
    fails, blocks themselves are joined. Then neighbouring names are paired and the
    distinct pairs named, until one name is left; every round halves the rows.
    """
    digest = digest or (lambda block: xxhash.xxh3_128_digest(block))
    rows = staged(_rows(docs, size, digest, rid), "exact-rows")
    names = _named(_distinct_blocks(docs, size, digest), ["block"], ["digest"], "exact-blocks")
    if _collides(names):
        rows, names = _by_block(docs, size, rid)
    counts = rows.select("rid", "doc_id", "text_sha256", F.size("digests").alias("n_blocks"))
    places = rows.select("rid", F.size("digests").alias("left"), F.posexplode("digests").alias("at", "digest"))
    level = staged(places.join(names, "digest").select("rid", "left", "at", "name"), "exact-level")
    longest = counts.agg(F.max("n_blocks")).first()[0] or 1
    last = level.filter("left = 1").select("rid", "name")
    while longest > 1:
        even = F.col("at") % 2 == 0
        pairs = staged(
            level.filter("left > 1")
            .groupBy("rid", F.expr("(left + 1) div 2").cast("int").alias("left"), F.expr("at div 2").cast("int").alias("at"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            ),
            "exact-pairs",
        )
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], "exact-names")
        level = staged(pairs.join(names, ["a", "b"]).select("rid", "left", "at", "name"), "exact-level")
        last = last.unionByName(level.filter("left = 1").select("rid", "name"))
        longest = (longest + 1) // 2
    return counts.join(last, "rid")


def _by_block(docs: DataFrame, size: int, rid) -> tuple[DataFrame, DataFrame]:
    """Rows and names with each block as its own digest."""
    rows = staged(_rows(docs, size, bytes, rid), "exact-rows")
    return rows, _named(_distinct_blocks(docs, size, bytes), ["block"], ["digest"], "exact-blocks")


def exact_groups(docs: DataFrame, size: int = BLOCK_BYTES, digest=None, rid: Column | None = None) -> DataFrame:
    """``(rid, doc_id, keep_id, group_size, kept, text_sha256)``, a row per document.

    Of equal texts the row with the largest ``doc_id`` stays; of several rows with
    that id, one. A null text is empty, and all empty texts are equal. A null
    ``doc_id`` ranks below all others. An empty table gives an empty result.
    """
    named = staged(document_names(docs, size, digest, rid), "exact-named")
    best = F.max(F.struct("doc_id", "rid"))
    groups = named.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    # Written first: of a join of two plain shuffles Spark splits a hot group.
    return named.join(staged(groups, "exact-groups"), ["n_blocks", "name"]).select(
        "rid",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("rid")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
