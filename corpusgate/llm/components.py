"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import staged


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)`` pairs; ``root`` is the smallest
    node of its component.

    Two alternating rounds of joins and minima: first every node hands its larger
    neighbours to its smallest one, then its smaller ones, until all hang directly
    from a root. Minima are reduced before the shuffle, so a node with many
    neighbours is no large group. Null ends are ignored.
    """
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = staged(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = staged(small.filter("a <> b").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct())
