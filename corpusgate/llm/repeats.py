"""Windows of text that occur more than once: what the two substring operators share.

Both operators give every window of a document a key that depends on nothing but
the window's content, so equal windows have equal keys. A *place* is a stretch of
neighbouring windows of one document that share a key occurrence: ``(num, key, ctx,
at, n)``, where ``num`` names the document, ``at`` the first window, ``n`` their
count, and ``ctx`` hashes all the text under them. Windows inside one place differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import settled

PLACES = "array<struct<key:bigint,ctx:bigint,at:int,n:int>>"


def shared_places(read: DataFrame, name: str, *order: str) -> DataFrame:
    """``(num, *order, key, ctx, at, n)`` of the places whose key occurs again.

    Counts are reduced before the shuffle and written, so the join back is one of two
    plain shuffles, of which Spark splits a hot key.
    """
    places = read.select("num", *order, F.explode("places").alias("p")).select("num", *order, "p.*")
    often = places.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return settled(places.join(settled(often, f"{name}-keys"), "key"), name)


def classes(shared: DataFrame, name: str, *order: str) -> DataFrame:
    """Places with equal text as one class: ``(key, ctx, size, rivals, first)``.

    ``first`` is the place that comes first by ``order``, document and start, ``rivals`` the
    number of classes that share the key. Only where there are rivals can windows of
    different places still be equal.
    """
    first = F.min(F.struct(*order, "num", "at", "n")).alias("first")
    alike = settled(shared.groupBy("key", "ctx").agg(F.count("*").alias("size"), first), name)
    rivals = alike.groupBy("key").agg(F.count("*").alias("rivals"))
    return alike.join(settled(rivals, f"{name}-counts"), "key")


def spans_by_document(spans: DataFrame) -> DataFrame:
    """``(num, starts, ends)``: the spans ``(num, s, e)`` of each document as arrays."""
    grouped = spans.groupBy("num").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return grouped.select("num", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends"))


def with_text(rows: DataFrame, docs: DataFrame, rid: Column) -> DataFrame:
    """``rows``, one per document with its ``rid``, and the document's ``text``."""
    texts = docs.select(rid.cast("string").alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(texts, "rid")
