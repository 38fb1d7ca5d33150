"""Benchmark passages in documents, by winnowed fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusgate.llm.common import (
    Powers,
    map_texts,
    numbered,
    scrambled,
    sha256_hex,
    span_hashes,
    staged,
    table,
    text_bytes,
    word_spans,
)

WINDOW_WORDS = 10
GRAM_WORDS = 5
FILTER_BITS = 1 << 24
_WORD_BASE = 0x9E3779B97F4A7C15
_GRAM_FACTORS = [pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) | 1 for j in range(64)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: its lower-case form, and whether it belongs to a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    word = np.zeros(256, bool)
    word[ord("0") : ord("9") + 1] = word[ord("a") : ord("z") + 1] = word[128:] = True
    return lower, word


class Words:
    """The words of a run of texts as numbers."""

    def __init__(self, column: pa.Array, powers: Powers):
        lower, word = _tables()
        data, bounds = text_bytes(column)
        self.data = lower[data]
        self.starts, self.ends, self.text = word_spans(word[self.data], bounds)
        self.hashes = span_hashes(self.data, self.starts, self.ends, powers)
        self.counts = np.bincount(self.text, minlength=len(column)).astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts

    def joined(self, begin: int, end: int, raw: bytes) -> str:
        return b" ".join(raw[s:e] for s, e in zip(self.starts[begin:end], self.ends[begin:end])).decode()


def winnow(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the chosen ``gram``-word runs.

    Of every ``window`` consecutive runs within a text the last of the smallest
    hash is chosen. Two spans of ``gram + window - 1`` equal words choose alike, so
    each such span holds a fingerprint that its copies hold at the same place.
    """
    h, span = words.hashes, gram + window - 1
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        grams += h[j : j + len(grams)] * np.uint64(_GRAM_FACTORS[j])
    grams = scrambled(grams + np.uint64(gram))
    starts = np.flatnonzero(words.text[: len(h) - span + 1] == words.text[span - 1 :])
    best, at = grams[starts], starts
    for j in range(1, window):
        other = grams[starts + j]
        smaller = other <= best
        best, at = np.where(smaller, other, best), np.where(smaller, starts + j, at)
    at = np.unique(at)
    return at, grams[at]


def _shapes(items: DataFrame, span: int, gram: int) -> list[tuple[int, int, int]]:
    """``(window words, gram, windows)`` to winnow by: the common one, and one for
    each length of a shorter item, of which there are fewer than ``span``."""
    short = items.filter((F.col("n_words") > 0) & (F.col("n_words") < span)).select("n_words").distinct()
    return [(span, gram, span - gram + 1)] + sorted((r[0], r[0], 1) for r in short.collect())


def _item_words(benchmark: DataFrame) -> DataFrame:
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    read = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
    return read.select("item_id", "words", F.size("words").alias("n_words"))


def _fingerprint_rows(benchmark: DataFrame, shapes) -> DataFrame:
    def work(rows: pa.RecordBatch, powers):
        words = Words(rows.column(0), powers)
        parts = []
        for span, gram, window in shapes:
            at, hashes = winnow(words, gram, window)
            if span < shapes[0][0]:
                hashes = hashes[words.counts[words.text[at]] == span]
            parts.append(hashes.view(np.int64))
        return [np.concatenate(parts)]

    return map_texts(benchmark.select("text"), "hash bigint", work, lambda: Powers(_WORD_BASE)).distinct()


def _bit_filter(prints: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` slots hold a fingerprint; at most ``bits`` bits whatever the
    benchmark's size."""
    words = prints.groupBy(F.expr(f"pmod(hash, {bits}) div 64").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pmod(hash, 64) as int)))").alias("bits")
    )
    held = np.zeros(bits // 64, np.int64)
    for row in words.toLocalIterator():
        held[row[0]] = row[1]
    return np.unpackbits(held.view(np.uint8), bitorder="little")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window_words: int = WINDOW_WORDS,
    gram_words: int = GRAM_WORDS,
    filter_bits: int = FILTER_BITS,
    rid: Column | None = None,
) -> DataFrame:
    """``(rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` per document.

    Winnowing with ``gram_words``-word runs guarantees a fingerprint in every
    ``window_words`` consecutive words. A document's fingerprints pass a bit filter
    of fixed size made from the benchmark's, those that remain are joined with them,
    and each match brings the words around it, as far as a window through it can
    reach. These are cut into windows and joined with the benchmark's as text, so a
    hash never decides. A shorter item is one window of its own length.

    Null and empty texts have no words and no hits; so do items. Repeated rows count
    each, items that share an id count once, a null item id is never listed.
    """
    items = staged(_item_words(benchmark), "decon-items")
    shapes = _shapes(items, window_words, gram_words)
    prints = staged(_fingerprint_rows(benchmark, shapes), "decon-prints")
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(_bit_filter(prints, filter_bits), bitorder="little"))

    def work(rows: pa.RecordBatch, powers):
        words = Words(rows.column(2), powers)
        held, raw = sent.value, None
        found = []
        for span, gram, window in shapes:
            at, hashes = winnow(words, gram, window)
            slot = (hashes.view(np.int64) % filter_bits).astype(np.int64)
            passed = (held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            for p, h in zip(at[passed].tolist(), hashes[passed].view(np.int64).tolist()):
                raw = words.data.tobytes() if raw is None else raw
                text = words.text[p]
                first = words.firsts[text]
                begin = max(p + gram - span, first)
                end = min(p + span, first + words.counts[text])
                found.append((text, h, begin - first, span, words.joined(begin, end, raw)))
        found.sort(key=lambda x: x[0])
        counts = np.bincount([x[0] for x in found], minlength=rows.num_rows) if found else np.zeros(rows.num_rows, int)
        fields = [("hash", pa.int64()), ("at", pa.int64()), ("span", pa.int32()), ("words", pa.string())]
        columns = [pa.array([x[i + 1] for x in found], type=kind) for i, (_, kind) in enumerate(fields)]
        hits = pa.StructArray.from_arrays(columns, fields=[pa.field(n, k) for n, k in fields])
        bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]), type=pa.int32())
        return rows.column(0), rows.column(1), words.counts, pa.ListArray.from_arrays(bounds, hits)

    schema = (
        "rid string, doc_id bigint, n_words bigint, "
        "hits array<struct<hash:bigint,at:bigint,span:int,words:string>>"
    )
    read = staged(map_texts(numbered(docs, rid), schema, work, lambda: Powers(_WORD_BASE)), "decon-docs")
    near = read.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.*")
    near = near.join(prints, "hash", "left_semi")

    size = F.when(F.col("n_words") < window_words, F.col("n_words")).otherwise(window_words)
    windows = items.filter("n_words > 0").withColumn("span", size.cast("int"))
    windows = _cut(windows.withColumn("at", F.lit(0).cast("bigint")), "item_id").select("item_id", "span", "window")
    windows = windows.distinct()
    listed = windows.select("span", "window").distinct()
    listed = staged(listed.withColumn("window_id", F.monotonically_increasing_id()), "decon-windows")
    mine = _cut(near.withColumn("words", F.split("words", " ")), "rid").distinct()
    matched = staged(mine.join(listed, ["span", "window"]).select("rid", "at", "span", "window_id"), "decon-matches")

    before = W.partitionBy("rid").orderBy("at", "span").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("at") + F.col("span")
    reach = F.coalesce(F.max(end).over(before), F.lit(0))
    fresh = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(F.col("at"), reach))
    hit = matched.select("rid", fresh.alias("fresh")).groupBy("rid").agg(F.sum("fresh").alias("n_hit"))
    pairs = matched.select("rid", "window_id").distinct()
    pairs = pairs.join(windows.join(listed, ["span", "window"]).select("window_id", "item_id"), "window_id")
    ids = pairs.groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    out = read.select("rid", "doc_id", "n_words").join(hit, "rid", "left").join(ids, "rid", "left")
    return out.select(
        "rid",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
        sha256_hex(F.coalesce(F.array_join("ids", ","), F.lit(""))).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _cut(rows: DataFrame, key: str) -> DataFrame:
    """``(key, at, span, window)``: every window of ``span`` words of ``words``."""
    starts = F.when(F.size("words") >= F.col("span"), F.sequence(F.lit(0), F.size("words") - F.col("span")))
    cut = rows.select(key, "at", "span", "words", F.explode(starts).alias("move"))
    text = F.array_join(F.slice("words", F.col("move") + 1, F.col("span")), " ")
    return cut.select(key, (F.col("at") + F.col("move")).alias("at"), "span", text.alias("window"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def _sql_words(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_sql_words('text')} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), {WINDOW_WORDS}) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
