"""Removal of byte strings that occurred before, by external suffix sorting."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Powers, map_texts, numbered, settled, span_hashes, staged, stored_row, table, text_bytes
from corpusgate.llm.recompression import _place_lists
from corpusgate.llm.repeats import PLACES, classes, shared_places, spans_by_document, with_text
from corpusgate.llm.suffixes import repeated_positions

WINDOW_BYTES = 100
GRAM_BYTES = 24
SEGMENT = 1 << 20
# Classes of one key that may meet in a shard, and the bytes a shard is meant to hold: its
# suffix tuples take nine times as much, of which 64 MB stay in memory.
RIVALS = 4096
SHARD_BYTES = 4 << 20
_GRAM_BASE, _TEXT_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_PLACE_BITS = np.uint64((1 << 24) - 1)


def places(data: np.ndarray, bounds: np.ndarray, window: int, gram: int, powers):
    """Text number, key, context hash, first window and number of windows of all places.

    A window's key is the smallest hash of its ``gram``-byte runs, the last of equal
    ones; neighbouring windows that take the same run are one place.
    """
    n = len(data) - window + 1
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)
    starts = np.flatnonzero(text[: max(n, 0)] == text[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    at = np.arange(len(data) - gram + 1)
    hashes = span_hashes(data, at, at + gram, powers[0])
    low = (hashes & ~_PLACE_BITS) | (_PLACE_BITS - at.astype(np.uint64))
    reach, need = 1, window - gram + 1
    while reach * 2 <= need:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < need:
        low = np.minimum(low[: len(low) - (need - reach)], low[need - reach :])
    anchor = (_PLACE_BITS - (low[starts] & _PLACE_BITS)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    return text[begin], hashes[anchor[first]], span_hashes(data, begin, begin + count + window - 1, powers[1]), begin, count


def _segmented(data, bounds, window, gram, powers):
    """``places`` part by part; every window lies in one part whole."""
    parts = []
    for s in range(0, max(len(data), 1), SEGMENT):
        e = min(s + SEGMENT + window - 1, len(data))
        part = list(places(data[s:e], np.clip(bounds - s, 0, e - s), window, gram, powers))
        part[3] = part[3] + s
        parts.append(part)
    return [np.concatenate(c) for c in zip(*parts)]


def read_places(docs: DataFrame, rid: Column, window: int, gram: int) -> DataFrame:
    """``(rid, num, doc_id, n_bytes, sha256, places)``."""

    def work(rows: pa.RecordBatch, powers):
        data, bounds = text_bytes(rows.column(2))
        raw = data.tobytes()
        shas = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(bounds[:-1], bounds[1:])]
        of, key, ctx, at, n = _segmented(data, bounds, window, gram, powers)
        return rows.column(0), rows.column(1), np.diff(bounds), shas, _place_lists(rows.num_rows, of, key, ctx, at - bounds[of], n)

    schema = f"rid string, doc_id bigint, n_bytes bigint, sha256 string, places {PLACES}"
    read = map_texts(
        numbered(docs, rid), schema, work, lambda: (Powers(_GRAM_BASE), Powers(_TEXT_BASE)), chunk_bytes=SEGMENT
    )
    return staged(read.withColumn("num", F.monotonically_increasing_id()), "suffix-read")


def _contexts(rows: DataFrame, window: int) -> DataFrame:
    """``(key, doc_id, num, at, n, many, context)``: the text under each listed place."""

    def work(rows: pa.RecordBatch, _):
        data, bounds = text_bytes(rows.column(3))
        raw = data.tobytes()
        out: list[list] = [[] for _ in range(7)]
        for i in range(rows.num_rows):
            num, doc_id = rows.column(0)[i].as_py(), rows.column(1)[i].as_py()
            for p in rows.column(2)[i].as_py():
                begin = bounds[i] + p["at"]
                row = (p["key"], doc_id, num, p["at"], p["n"], p["many"], raw[begin : begin + p["n"] + window - 1])
                for column, value in zip(out, row):
                    column.append(value)
        return out

    chosen = rows.select("num", "doc_id", "listed", "text")
    schema = "key bigint, doc_id bigint, num bigint, at int, n int, many boolean, context binary"
    return map_texts(chosen, schema, work, chunk_bytes=SEGMENT)


def _later_spans(contexts: DataFrame, window: int, shards: int) -> DataFrame:
    """``(num, s, e)``: spans of bytes covered by strings that start earlier, from one
    suffix array per shard. A shard holds all places of its keys, in document order."""

    def run(batches):
        nums, ats, ns = [], [], []

        def pieces():
            for batch in batches:
                nums.append(batch.column(0).to_numpy())
                ats.append(batch.column(1).to_numpy().astype(np.int64))
                ns.append(batch.column(2).to_numpy().astype(np.int64))
                for context in batch.column(3):
                    yield np.frombuffer(context.as_buffer(), np.uint8)

        with tempfile.TemporaryDirectory() as folder:
            found = repeated_positions(pieces(), window, folder)
        if not len(found):
            return
        num, at, size = (np.concatenate(x) for x in (nums, ats, ns))
        starts = np.concatenate([[0], np.cumsum(size + window - 1)])
        of = np.searchsorted(starts, found, side="right") - 1
        cut = np.flatnonzero((np.diff(found, prepend=-2) != 1) | (np.diff(of, prepend=-1) != 0))
        last = np.append(cut[1:], len(found)) - 1
        begin = at[of[cut]] + found[cut] - starts[of[cut]]
        end = at[of[last]] + found[last] - starts[of[last]] + window
        yield pa.RecordBatch.from_arrays(
            [pa.array(num[of[cut]]), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["num", "s", "e"]
        )

    dealt = contexts.repartition(shards, "key").sortWithinPartitions("doc_id", "num", "at")
    return dealt.select("num", "at", "n", "context").mapInArrow(run, "num bigint, s int, e int")


def _windows(contexts: DataFrame, window: int) -> DataFrame:
    """``(doc_id, num, at, h1, h2)``: every window of the places, with a 128-bit hash."""

    def work(rows: pa.RecordBatch, powers):
        data, bounds = text_bytes(rows.column(4))
        n = rows.column(3).to_numpy().astype(np.int64)
        of = np.repeat(np.arange(rows.num_rows), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = bounds[of] + step
        at = (rows.column(2).to_numpy()[of] + step).astype(np.int32)
        hashes = [span_hashes(data, start, start + window, p).view(np.int64) for p in powers]
        return [rows.column(0).take(pa.array(of)), rows.column(1).take(pa.array(of)), at, *hashes]

    chosen = contexts.select("doc_id", "num", "at", "n", "context")
    schema = "doc_id bigint, num bigint, at int, h1 bigint, h2 bigint"
    setup = lambda: [Powers(b) for b in (_TEXT_BASE, _SECOND_BASE)]
    return map_texts(chosen, schema, work, setup, column="context", chunk_bytes=SEGMENT)


def _later_windows(contexts: DataFrame, window: int) -> DataFrame:
    """``(num, s, e)`` of the windows that start earlier too, however many share a key.

    Windows are dealt by their own hash and counted before the shuffle; equal ones are
    found by a join with one row for each string, whose hot keys Spark splits."""
    windows = settled(_windows(contexts, window), "suffix-windows")
    first = F.min(F.struct("doc_id", "num", "at")).alias("first")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("c"), first).filter("c > 1").select("h1", "h2", "first")
    later = windows.join(settled(again, "suffix-again"), ["h1", "h2"]).filter("num <> first.num OR at <> first.at")
    return later.select("num", F.col("at").alias("s"), (F.col("at") + window).alias("e"))


def _kept(rows: DataFrame) -> DataFrame:
    """``(num, n_removed, n_spans, kept_sha256)`` after the bytes under the spans are gone."""

    def work(rows: pa.RecordBatch, _):
        data, bounds = text_bytes(rows.column(3))
        removed, spans, shas = [], [], []
        for i in range(rows.num_rows):
            text = data[bounds[i] : bounds[i + 1]]
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, rows.column(1)[i].values.to_numpy(), 1)
            np.add.at(change, rows.column(2)[i].values.to_numpy(), -1)
            gone = np.cumsum(change)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            shas.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        return rows.column(0), removed, spans, shas

    chosen = rows.select("num", "starts", "ends", "text")
    return map_texts(chosen, "num bigint, n_removed bigint, n_spans bigint, kept_sha256 string", work)


def without_later_copies(
    docs: DataFrame, window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, rid: Column | None = None
) -> DataFrame:
    """``(rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document.

    Bytes under a ``window``-byte string that also starts earlier go: in a document of
    smaller ``doc_id``, or earlier in the same one. Strings are judged on the input
    and never cross documents. Shards are made so that equal strings meet: each string
    has a key, the smallest hash of its ``gram``-byte runs, and only text under keys
    that occur again is sorted. Places with the same text are one class, whose first
    place stays in and stands for it; the others are covered. Where classes share a
    key, a suffix array with common prefixes decides which of their strings are equal;
    where more than ``RIVALS`` do, 128-bit hashes of their strings decide, so that no
    shard grows with a frequent passage. The texts are shuffled twice, to cut out the
    strings of such keys and to remove what was found, each after the shuffles before it
    are deleted.

    Null and empty texts have no bytes, shorter ones no string. A null id comes before
    all others, rows that share an id are ordered by their place in the input. ``rid``
    must name rows the same way each time ``docs`` is read; without it the texts are
    staged.
    """
    if rid is None:
        docs = staged(numbered(docs), "suffix-docs")
        rid = F.col("rid")
    read = read_places(docs, rid, window, gram)
    shared = shared_places(read, "suffix-shared", "doc_id")
    alike = settled(classes(shared, "suffix-classes", "doc_id"), "suffix-rivals")
    copies = shared.join(alike.filter("size > 1").select("key", "ctx", "first"), ["key", "ctx"])
    copies = copies.filter("num <> first.num OR at <> first.at")
    covered = copies.select("num", F.col("at").alias("s"), (F.col("at") + F.col("n") + window - 1).alias("e"))
    rivals = alike.filter("rivals > 1").withColumn("many", F.col("rivals") > RIVALS)
    doubtful = rivals.select("first.doc_id", "first.num", F.struct("key", "first.at", "first.n", "many").alias("p"))
    listed = doubtful.groupBy("num").agg(F.first("doc_id").alias("doc_id"), F.collect_list("p").alias("listed"))
    contexts = _contexts(with_text(settled(listed.join(read.select("num", "rid"), "num"), "suffix-listed"), docs, rid), window)
    contexts = settled(contexts, "suffix-contexts")
    n_bytes, n_many = contexts.agg(F.sum(F.when(~F.col("many"), F.col("n") + window)), F.count_if("many")).first()
    shards = max(-(-(n_bytes or 0) // SHARD_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    spans = covered.union(_later_spans(contexts.filter("NOT many"), window, shards))
    if n_many:
        spans = spans.union(_later_windows(contexts.filter("many"), window))
    spans = settled(spans_by_document(spans).join(read.select("num", "rid"), "num"), "suffix-spans")
    touched = _kept(with_text(spans, docs, rid))
    out = read.select("num", "rid", "doc_id", "n_bytes", "sha256").join(touched, "num", "left")
    none = F.lit(0).cast("bigint")
    return out.select(
        "rid",
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_later_copies(table(spark, sf_dir, "documents"), rid=stored_row()).drop("rid")
