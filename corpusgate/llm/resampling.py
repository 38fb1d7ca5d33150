"""Importance resampling towards a target distribution by bit-sliced aggregation.

A document's hashed n-gram counts are kept as bit planes: plane ``k`` has bit ``b`` set
where the count of bucket ``b`` has bit ``k``. The gains of the buckets are sliced the
same way, by sign and bit. The sum of count times gain over all buckets is then
exact integer work: for each pair of planes AND, count bits, times a power of two.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgate.llm.common import map_texts, slices, staged, table, text_bytes, word_spans

BUCKETS = 10_000
NGRAM = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000
CHUNK_BYTES = 1 << 20
LONG_WORD = 64
PLANE_BYTES = 8 << 20


def _fold() -> np.ndarray:
    """Bytes with A-Z in lower case; 0 for bytes outside words."""
    out = np.zeros(256, np.uint8)
    out[48:58], out[97:123], out[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
    out[65:91] = np.arange(97, 123)
    return out


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320) ^ (out >> 1), out >> 1).astype(np.uint32)
    return out


FOLD, CRC = _fold(), _crc_table()


class Joined:
    """CRC-32 of joined byte strings from the CRC-32 of their parts.

    Putting ``n`` bytes behind a string is a linear map of its CRC, kept as four tables
    of 256 entries for each ``n`` up to ``LONG_WORD``.
    """

    def __init__(self):
        one = np.arange(256, dtype=np.uint32)
        shift = np.stack([one << np.uint32(8 * i) for i in range(4)])
        steps = [shift]
        for _ in range(LONG_WORD):
            shift = CRC[shift & 255] ^ (shift >> np.uint32(8))
            steps.append(shift)
        self.tables = np.stack(steps)

    def __call__(self, crc: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """CRCs of strings of CRC ``crc``, each followed by ``size`` bytes of CRC ``tail``."""
        out, left = crc, size
        while True:
            step = np.minimum(left, LONG_WORD)
            out = (
                self.tables[step, 0, out & 255]
                ^ self.tables[step, 1, (out >> np.uint32(8)) & 255]
                ^ self.tables[step, 2, (out >> np.uint32(16)) & 255]
                ^ self.tables[step, 3, out >> np.uint32(24)]
            )
            left = left - step
            if not left.any():
                return out ^ tail


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span; all spans advance by one byte at a time, long ones alone."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(size, kind="stable")
    order = order[: np.searchsorted(size[order], LONG_WORD, side="right")]
    first = np.searchsorted(size[order], np.arange(1, LONG_WORD + 1))
    for j in range(LONG_WORD):
        live = order[first[j] :]
        if not len(live):
            break
        state = out[live]
        out[live] = CRC[(state ^ data[starts[live] + j]) & 255] ^ (state >> np.uint32(8))
    out = ~out
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


class Features:
    """Buckets of all runs of 1 to ``ngram`` words of a batch of texts."""

    def __init__(self, ngram: int = NGRAM, buckets: int = BUCKETS):
        self.ngram, self.buckets, self.joined = ngram, buckets, Joined()
        self.space = np.uint32(zlib.crc32(b" "))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number and bucket of each feature, and the words of each text."""
        raw, bounds = text_bytes(column)
        data = FOLD[raw]
        starts, ends, of = word_spans(data != 0, bounds)
        words = np.bincount(of, minlength=len(bounds) - 1)
        crc, size = word_crcs(data, starts, ends), ends - starts
        run, owners, found = crc, [of], [crc]
        one = np.ones(1, np.int64)
        for n in range(1, self.ngram):
            if len(starts) <= n:
                break
            whole = self.joined(run[:-1], one, self.space)
            run = self.joined(whole, size[n:], crc[n:])
            same = of[n:] == of[:-n]
            owners.append(of[n:][same])
            found.append(run[same])
        return np.concatenate(owners), (np.concatenate(found) % np.uint32(self.buckets)).astype(np.int64), words


def bit_planes(values: np.ndarray, rows: int, buckets: int) -> list[np.ndarray]:
    """The bit planes of a sparse matrix of counts, ``values`` being ``row * buckets +
    bucket`` of each occurrence: for each bit an array of rows by 64-bit words."""
    words = -(-buckets // 64)
    at, counts = np.unique(values, return_counts=True)
    row, bucket = at // buckets, at % buckets
    cell, bit = row * words + bucket // 64, np.uint64(1) << (bucket % 64).astype(np.uint64)
    planes = []
    while counts.any():
        plane = np.zeros(rows * words, np.uint64)
        held = (counts & 1) == 1
        if held.any():  # cells come sorted, so the bits of a cell are neighbours
            cells, bits = cell[held], bit[held]
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            plane[cells[first]] = np.bitwise_or.reduceat(bits, first)
        planes.append(plane.reshape(rows, words))
        counts = counts >> 1
    return planes


class Gains:
    """The gains of all buckets as signed bit planes."""

    def __init__(self, gains: np.ndarray):
        words = -(-len(gains) // 64)
        self.planes = []
        for sign in (1, -1):
            size = np.maximum(sign * gains.astype(np.int64), 0)
            for k in range(int(size.max(initial=0)).bit_length()):
                bits = np.zeros(words * 64, np.uint8)
                bits[: len(gains)] = (size >> k) & 1
                self.planes.append((sign << k, np.packbits(bits, bitorder="little").view(np.uint64)))

    def sums(self, counts: list[np.ndarray], rows: int) -> np.ndarray:
        """Per row, the sum over all buckets of count times gain."""
        total = np.zeros(rows, np.int64)
        for j, plane in enumerate(counts):
            live = np.flatnonzero(plane.any(axis=1))
            held = plane[live]
            for factor, gain in self.planes:
                both = np.bitwise_count(held & gain).sum(axis=1, dtype=np.int64)
                total[live] += both * (factor << j)
        return total


def bucket_totals(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket.

    Every task counts into one array of fixed size, so the shuffle has at most
    ``buckets`` rows a task and the driver gets ``buckets`` numbers.
    """

    def count(batches):
        features, totals = Features(ngram, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            size = np.diff(text_bytes(batch.column(0))[1])
            for rows in slices(batch, size, CHUNK_BYTES):
                totals += np.bincount(features(rows.column(0))[1], minlength=buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():  # one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The floored, scaled logarithm of each bucket's smoothed target over source share."""
    s, t = int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(SCALE * math.log((float(b + 1) * float(s + buckets)) / (float(a + 1) * float(t + buckets))))
            for a, b in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weights(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the floored mean gain of
    a text's features; 0 without any."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(gains)  # one number per bucket
    buckets = len(gains)
    many = max(1, PLANE_BYTES // (buckets // 8 + 8))

    def setup():
        return Features(ngram, buckets), Gains(sent.value)

    def work(rows: pa.RecordBatch, state):
        features, sliced = state
        out = []
        for start in range(0, len(rows), many):
            part = rows.slice(start, many)
            of, bucket, words = features(part.column(1))
            n = np.bincount(of, minlength=len(part))
            total = sliced.sums(bit_planes(of * buckets + bucket, len(part), buckets), len(part))
            out.append((words, n, np.floor_divide(total, np.maximum(n, 1))))
        return rows.column(0), *(np.concatenate(c).astype(np.int64) for c in zip(*out))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_texts(
        rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint", work, setup, chunk_bytes=CHUNK_BYTES
    )


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The floored, scaled Gumbel noise of an id, from its hash under ``seed``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(uniform))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` with their place, from 1, in the given order.

    A range partitioned sort is written once; a row's place is that in its part plus
    the rows of the parts before. No task sees more than a part, and a small random
    column, the last to sort by, lets equal rows be dealt over several.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col("_even").asc()]
    dealt = staged(rows.withColumn("_even", F.rand(SEED)), "ranked-rows")
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked-sorted")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = written.groupBy(part).agg(F.count("*").alias("n")).collect()  # one row per partition
    before, offsets = 0, []
    for p, n in sorted(map(tuple, sizes)):
        offsets.append((p, before))
        before += n
    offsets = spark.createDataFrame(offsets, T._parse_datatype_string("_part bigint, _before bigint"))
    placed = written.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(rank, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop(
        "_part", "_before", "_at", "_even"
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``, a row per document.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are
    drawn without replacement, by weight plus Gumbel noise: the highest scores, ties to the smaller
    ``doc_id``. ``rank`` is null where a document is not drawn. A null text has no
    words, no features and weight 0. Repeated ids are rows of their own with the same
    noise; equal rows take neighbouring ranks. A null id draws noise as an empty one
    and ranks behind equal scores. An empty ``target`` or ``docs`` counts as no features.
    """
    source = bucket_totals(docs, ngram, buckets)
    gains = bucket_gains(source, bucket_totals(target, ngram, buckets), buckets)
    rows = weights(docs, gains, ngram).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = staged(rows, "resample-scores")
    fit = rows.filter(F.col("n_words") >= least_words)
    draws = percent * fit.count() // 100
    placed = ranked(fit, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    short = rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(short)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
