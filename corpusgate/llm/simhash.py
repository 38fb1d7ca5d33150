"""Near duplicates by SimHash and tiled exact comparison of fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import map_texts, numbered, staged, table, text_bytes
from corpusgate.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
TILE = 1 << 15
INNER = 256


def simhash(data: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text, as an unsigned number; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    many = max(len(words) - shingle + 1, 1)
    first, last = starts[:many].tolist(), (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first, last)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, many, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > many, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """``(rid, doc_id, fp)``, the fingerprint as a signed 64-bit number."""

    def work(rows: pa.RecordBatch, _):
        data, bounds = text_bytes(rows.column(2))
        data = data.tobytes()
        found = [simhash(data[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
        return rows.column(0), rows.column(1), np.array(found, np.uint64).view(np.int64)

    return map_texts(numbered(docs, rid), "rid string, doc_id bigint, fp bigint", work)


class Forest:
    """Sets of nodes, merged from arrays of pairs; the smallest index is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        at = self.parent[at]
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def _segments(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit parts of each fingerprint."""
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _arranged(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered so that neighbours have like bit counts, and the smallest
    and largest counts of each run of ``INNER``."""
    parts = _segments(fp)
    order = np.lexsort(parts.T)
    starts = np.arange(0, len(fp), INNER)
    return order, np.minimum.reduceat(parts[order], starts), np.maximum.reduceat(parts[order], starts)


def linked(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest, as pairs of fingerprints, with the components of all pairs of a
    ``left`` and a ``right`` one that differ in at most ``radius`` bits.

    Runs whose bit counts, summed over the parts, differ by more are skipped: two
    values differ in at least as many bits as their counts do. The others are
    compared in full.
    """
    both = np.concatenate([left, right])
    forest = Forest(len(both))
    lo, llow, lhigh = _arranged(left)
    ro, rlow, rhigh = _arranged(right)
    ro = ro + len(left)
    for i in range(len(llow)):
        gap = np.maximum(0, np.maximum(llow[i] - rhigh, rlow - lhigh[i])).sum(axis=1)
        a = lo[i * INNER : (i + 1) * INNER]
        for j in np.flatnonzero(gap <= radius):
            b = ro[j * INNER : (j + 1) * INNER]
            x, y = np.nonzero(np.bitwise_count(both[a][:, None] ^ both[b][None, :]) <= radius)
            if len(x):
                forest.join(a[x], b[y])
    roots = forest.roots(np.arange(len(both)))
    moved = np.flatnonzero(roots != np.arange(len(both)))
    return both[moved], both[roots[moved]]


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(a, b)``: links that join the distinct ``fp`` within ``radius`` bits into the
    same components as all such pairs would.

    Fingerprints with equally many bits set are dealt into tiles of about ``tile``.
    Tile pairs whose counts differ beyond the radius never meet, each other pair is
    one group of at most two tiles and returns a forest, not its pairs. Exact
    comparison of all tiles grows with the square of the distinct fingerprints,
    divided by what the counts rule out.
    """
    prints = prints.select("fp", F.bit_count("fp").alias("bits"))
    sizes = prints.groupBy("bits").agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("n"))
    tiles = sizes.select("bits", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    prints = prints.join(F.broadcast(sizes), "bits").withColumn("part", F.expr("cast(pmod(xxhash64(fp), n) as int)"))
    other = tiles.select(F.col("bits").alias("bits2"), F.col("part").alias("part2"))
    reach = F.explode(F.sequence(F.col("bits"), F.col("bits") + radius))
    pairs = tiles.select("bits", "part", reach.alias("bits2")).join(other, "bits2")
    pairs = pairs.filter("bits < bits2 OR part <= part2")
    pairs = staged(pairs.select("bits", "part", "bits2", "part2", F.monotonically_increasing_id().alias("pair")), "simhash-tiles")
    left = prints.join(pairs.select("bits", "part", "pair"), ["bits", "part"]).select("pair", F.lit(0).alias("side"), "fp")
    mine = prints.select("fp", F.col("bits").alias("bits2"), F.col("part").alias("part2"))
    right = mine.join(pairs.select("bits2", "part2", "pair"), ["bits2", "part2"]).select("pair", F.lit(1).alias("side"), "fp")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, side = group["fp"].to_numpy().view(np.uint64), group["side"].to_numpy()
        if (side == 0).all() or (side == 1).all():
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        a, b = linked(fp[side == 0], fp[side == 1], radius)
        apart = a != b
        return pd.DataFrame({"a": a[apart].view(np.int64), "b": b[apart].view(np.int64)})

    return left.union(right).groupBy("pair").applyInPandas(compare, "a bigint, b bigint")


def near_groups(docs: DataFrame, radius: int = RADIUS, rid: Column | None = None) -> DataFrame:
    """``(rid, doc_id, fp, component_id, root)`` per document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, and
    ``component_id`` is the smallest ``doc_id`` reachable by links; ``root`` names the
    component by its smallest fingerprint. Equal fingerprints
    are one node with its smallest id, however many documents share it. Texts
    without words, null ones included, have fingerprint zero and are linked like any
    other; fewer than four words are one shingle; repeated rows are documents of
    their own; a null id counts only where its component has no other.
    """
    read = staged(fingerprints(docs, rid), "simhash-docs")
    nodes = staged(read.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = staged(components(staged(near_links(nodes, radius), "simhash-links")), "simhash-roots")
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "root").select("fp", "component_id", "root")
    return read.join(named, "fp").select("rid", "doc_id", "fp", "component_id", "root")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", text.alias("fingerprint"), "component_id")
