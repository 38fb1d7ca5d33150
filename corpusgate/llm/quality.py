"""Document quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Powers, held_out, lists, map_texts, numbered, span_hashes, staged, table, text_bytes, word_spans

SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, SMOOTH = 64, 4, 80, 0.15, 1.0
THRESHOLD = 0.3
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\v\f", b".", b",", b"!", b"?", b"|", b"#$%&*", b":;'\"()-_/@<>[]{}=+^~`\\"]
N_STATS = len(_GROUPS) + 2 + 13


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(column: pa.Array, powers: Powers) -> np.ndarray:
    """A row of ``N_STATS`` numbers per text; all are zero for an empty one."""
    data, bounds = text_bytes(column)
    n = len(column)
    kind = np.full(256, len(_GROUPS), np.int64)
    kind[128:] += 1
    for i, group in enumerate(_GROUPS):
        kind[list(group)] = i
    size = np.diff(bounds)
    k = len(_GROUPS) + 2
    text = np.repeat(np.arange(n), size)
    kinds = kind[data]
    counts = np.bincount(text * k + kinds, minlength=n * k).reshape(n, k)
    starts, ends, of = word_spans((data > 32) | (data == 0), bounds)
    words = np.bincount(of, minlength=n)
    length = ends - starts
    lengths, squares = (np.bincount(of, length.astype(float) ** p, minlength=n) for p in (1, 2))
    mean = _ratio(lengths, words)
    hashes = span_hashes(data, starts, ends, powers)
    order = np.lexsort((hashes, of))
    so, sh = of[order], hashes[order]
    new = np.ones(len(so), bool)
    new[1:] = (so[1:] != so[:-1]) | (sh[1:] != sh[:-1])
    distinct = np.bincount(so[new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(so)))
    most = np.zeros(n)
    np.maximum.at(most, so[new], runs)
    again = np.zeros(len(of), bool)
    again[1:] = (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])
    lines = counts[:, 4] + (size > 0)
    final = data[ends - 1] if len(ends) else data[:0]
    opening = kinds[starts] if len(starts) else kinds[:0]
    upper = np.concatenate([[0], np.cumsum(kinds == 0)])
    shout = (upper[ends] - upper[starts] >= 2) if len(starts) else opening == 0
    doubled = (final == np.where(length > 1, data[np.maximum(ends - 2, 0)], 0)) & (kinds[np.maximum(ends - 1, 0)] > 1) if len(ends) else opening == 0

    def share(mask: np.ndarray) -> np.ndarray:
        return _ratio(np.bincount(of[mask], minlength=n).astype(float), words)

    more = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(_ratio(squares, words) - mean**2, 0)),
        _ratio(distinct, words), _ratio(most, words), share(again), _ratio(words, lines), np.log1p(lines),
        share((kind[final] > 5)), share(opening == 0), share(shout), share(doubled),
    ]
    return np.column_stack([counts / np.maximum(size, 1)[:, None], *more])


class Trees:
    """Complete binary trees as flat arrays: node ``i`` has children ``2i+1`` and ``2i+2``."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, 2**depth - 1), np.int64)
        self.threshold = np.zeros((0, 2**depth - 1))
        self.value = np.zeros((0, 2**depth))

    def add(self, feature, threshold, value) -> None:
        self.feature = np.vstack([self.feature, feature])
        self.threshold = np.vstack([self.threshold, threshold])
        self.value = np.vstack([self.value, value])

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for the log loss, grown level by level from histograms of gradients."""
    if len(y) == 0:
        return Trees(0.0, depth)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if y.min() == y.max():
        return model
    n, f = x.shape
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    binned = np.column_stack([np.searchsorted(edges[:, j], x[:, j], side="left") for j in range(f)])
    slots = binned + np.arange(f) * BINS
    raw = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * BINS) + slots).ravel()
            gs, hs = (
                np.bincount(at, np.repeat(v, f), minlength=many * f * BINS).reshape(many, f, BINS).cumsum(axis=2)
                for v in (g, h)
            )
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + SMOOTH) + (gt - gs) ** 2 / (ht - hs + SMOOTH) - gt**2 / (ht + SMOOTH)
            gain[(hs < 1) | (ht - hs < 1)] = -1
            flat = gain[:, :, :-1].reshape(many, -1)
            best = flat.argmax(axis=1)
            split = flat[np.arange(many), best] > 1e-6
            bj, bb = best // (BINS - 1), best % (BINS - 1)
            feature[first : first + many] = bj
            threshold[first : first + many] = np.where(split, edges[bb, bj], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        value = -RATE * np.bincount(leaf, g, minlength=2**depth) / (np.bincount(leaf, h, minlength=2**depth) + SMOOTH)
        model.add(feature, threshold, value)
        raw += value[leaf]
    return model


def document_statistics(docs: DataFrame) -> DataFrame:
    """``(rid, doc_id, stats)``."""

    def work(rows: pa.RecordBatch, powers):
        stats = statistics(rows.column(2), powers)
        return rows.column(0), rows.column(1), lists(np.full(len(stats), N_STATS), stats.ravel(), pa.float64())

    return map_texts(numbered(docs), "rid string, doc_id bigint, stats array<double>", work, lambda: Powers(0x9E3779B97F4A7C15))


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``(rid, doc_id, held_out, score, predicted)`` per document.

    The model is fitted on at most ``sample_rows`` labelled documents that are not
    held out, the first by a hash of their id; statistics and scores cover all.
    Nothing but the text enters the statistics. Of several labels of an id the
    largest counts; null labels and ids are skipped. Without labels every score is
    0.5. Null and empty texts have zero statistics and a score like any other.
    """
    stats = staged(document_statistics(docs), "quality-statistics")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").filter(
        F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))
    )
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = stats.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "rid").limit(sample_rows).select("stats", "quality").toPandas()
    x = np.array(sample["stats"].tolist(), float).reshape(len(sample), N_STATS)
    found = fit(x, sample["quality"].to_numpy(float))
    sent = stats.sparkSession.sparkContext.broadcast((found.base, found.depth, found.feature, found.threshold, found.value))

    def run(batches):
        base, depth, *arrays = sent.value
        model = Trees(base, depth)
        model.add(*arrays)
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_STATS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(model.score(flat))], names=["rid", "doc_id", "score"]
            )

    out = stats.mapInArrow(run, "rid string, doc_id bigint, score double")
    return out.select(
        "rid",
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rid")
