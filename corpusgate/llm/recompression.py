"""Substring dedup by recompression: long repeats of words share high symbols."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import (
    Powers,
    map_texts,
    numbered,
    scrambled,
    span_hashes,
    staged,
    stored_row,
    table,
    text_bytes,
    word_spans,
)
from corpusgate.llm.repeats import PLACES, classes, shared_places, spans_by_document, with_text

WINDOW_WORDS = 35
SYMBOL_WORDS = 20
ROUNDS = 9
RUN_ROUNDS = (0, 3, 6)
SEGMENT_WORDS = 1 << 20
_LINE_BASE, _SECOND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_FAR = 1 << 40


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return scrambled(a * np.uint64(0xBF58476D1CE4E5B9) + scrambled(b + np.uint64(salt)))


class Symbols:
    """A sequence of named symbols over words; texts follow one another.

    ``lo`` and ``hi`` bound the words that a symbol depends on: wherever these words
    stand, the same symbol is made of the same words among them. A symbol that
    depends on where its text begins or ends has bounds beyond any window.
    """

    def __init__(self, name, text, lo, hi):
        self.name, self.text, self.lo, self.hi = name, text, lo, hi

    def _before(self):
        """``lo`` of each symbol's left neighbour."""
        out = np.concatenate([[-_FAR], self.lo[:-1]])
        out[1:][self.text[1:] != self.text[:-1]] = -_FAR
        return out

    def _behind(self):
        out = np.concatenate([self.hi[1:], [_FAR]])
        out[:-1][self.text[1:] != self.text[:-1]] = _FAR
        return out

    def runs(self, salt: int) -> tuple[Symbols, np.ndarray]:
        """Equal neighbours become one symbol named by what and how many they are."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        count = last - first + 1
        long = count > 1
        name = np.where(long, _mixed(self.name[first], count.astype(np.uint64), salt), self.name[first])
        return Symbols(name, self.text[first], self._before()[first], self._behind()[last]), long

    def pairs(self, salt: int) -> tuple[Symbols, np.ndarray]:
        """Names fall into left and right ones by a fixed bit; a left one followed by a
        right one becomes one symbol."""
        right = (scrambled(self.name + np.uint64(salt)) & np.uint64(1)) == 1
        paired = np.zeros(len(right), bool)
        paired[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(len(right), bool)
        second[1:] = paired[:-1]
        keep = np.flatnonzero(~second)
        made = paired[keep]
        after = np.minimum(keep + 1, len(right) - 1)
        name = np.where(made, _mixed(self.name[keep], self.name[after], salt), self.name[keep])
        lo = np.where(right[keep], self._before()[keep], self.lo[keep])
        hi = np.where(made, self.hi[after], np.where(right[keep], self.hi[keep], self._behind()[keep]))
        return Symbols(name, self.text[keep], lo, hi), made


def levels(hashes: np.ndarray, text: np.ndarray, window: int) -> list[tuple]:
    """``(level, names, lo, hi)`` of the symbols new at each level that depend on at most
    ``window`` words."""
    at = np.arange(len(hashes))
    now = Symbols(hashes, text, at, at + 1)
    out = [(0, hashes, at, at + 1)]
    for turn in range(ROUNDS):
        steps = [now.runs] if turn in RUN_ROUNDS else []
        for make in [*steps, None]:
            level = 2 * turn + (make is None) + 1
            now, made = (make or now.pairs)(level)
            held = made & (now.hi - now.lo <= window)
            if held.any():
                out.append((level, now.name[held], now.lo[held], now.hi[held]))
    return out


def places(hashes: np.ndarray, text: np.ndarray, window: int, powers: Powers):
    """Text number, key, context hash, first window and number of windows of all places.

    A window's key is the first of the highest new symbols that depend on few words,
    all of the window, so equal windows have equal keys at equal distances.
    """
    starts = np.flatnonzero(text[: max(len(text) - window + 1, 0)] == text[window - 1 :])
    key, anchor = np.zeros(len(starts), np.uint64), np.full(len(starts), -1)
    base = 0
    open_ = np.arange(len(starts))
    for level, name, lo, hi in reversed(levels(hashes, text, min(SYMBOL_WORDS, window))) if len(starts) else ():
        at = np.searchsorted(lo, starts[open_])
        at[at == len(lo)] = len(lo) - 1
        fits = (lo[at] >= starts[open_]) & (hi[at] <= starts[open_] + window)
        key[open_[fits]] = _mixed(name[at[fits]], np.full(fits.sum(), level, np.uint64), 77)
        anchor[open_[fits]] = base + at[fits]
        base += len(name)
        open_ = open_[~fits]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    ctx = span_hashes(hashes, begin, begin + count + window - 1, powers)
    return text[begin], key[first], ctx, begin, count


def _words(column: pa.Array):
    """The words of all texts, their text numbers, and their hashes. A hash of the whole
    word, not a polynomial: long words of a regular pattern must not meet."""
    data, bounds = text_bytes(column)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends, text = word_spans(~space, bounds)
    raw = data.tobytes()
    words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
    return words, text, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _joined_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _place_lists(n_rows: int, text, key, ctx, at, n) -> pa.ListArray:
    fields = [pa.field("key", pa.int64()), pa.field("ctx", pa.int64()), pa.field("at", pa.int32()), pa.field("n", pa.int32())]
    columns = [key.view(np.int64), ctx.view(np.int64), at.astype(np.int32), n.astype(np.int32)]
    values = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=fields)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def _segmented(hashes, text, window, powers):
    """``places`` of long inputs part by part; every window lies in one part whole."""
    if len(hashes) <= SEGMENT_WORDS:
        return places(hashes, text, window, powers)
    parts = []
    for s in range(0, len(hashes), SEGMENT_WORDS):
        e = min(s + SEGMENT_WORDS + window - 1, len(hashes))
        part = list(places(hashes[s:e], text[s:e], window, powers))
        part[3] = part[3] + s
        parts.append(part)
    return [np.concatenate(c) for c in zip(*parts)]


def read_places(docs: DataFrame, rid: Column, window: int) -> DataFrame:
    """``(rid, num, doc_id, n_words, sha256, places)``."""

    def work(rows: pa.RecordBatch, powers):
        words, text, hashes = _words(rows.column(2))
        counts = np.bincount(text, minlength=rows.num_rows)
        first = np.cumsum(counts) - counts
        shas = [_joined_sha(words[f : f + c]) for f, c in zip(first, counts)]
        of, key, ctx, at, n = _segmented(hashes, text, window, powers)
        held = _place_lists(rows.num_rows, of, key, ctx, at - first[of], n)
        return rows.column(0), rows.column(1), counts.astype(np.int64), shas, held

    schema = f"rid string, doc_id bigint, n_words bigint, sha256 string, places {PLACES}"
    read = map_texts(numbered(docs, rid), schema, work, lambda: Powers(_LINE_BASE))
    return staged(read.withColumn("num", F.monotonically_increasing_id()), "substring-read")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """``(num, at, h1, h2)``: every window of the spans, with a 128-bit hash."""

    def work(rows: pa.RecordBatch, powers):
        _, text, hashes = _words(rows.column(3))
        first = np.searchsorted(text, np.arange(rows.num_rows))
        counts = np.array([len(x) for x in rows.column(1)], np.int64)
        of = np.repeat(np.arange(rows.num_rows), counts)
        begin = rows.column(1).flatten().to_numpy().astype(np.int64)
        end = rows.column(2).flatten().to_numpy().astype(np.int64)
        n = end - begin
        of = np.repeat(of, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        start = first[of] + at
        nums = rows.column(0).to_numpy()[of]
        return [nums, at] + [span_hashes(hashes, start, start + window, p).view(np.int64) for p in powers]

    bases = (_LINE_BASE, _SECOND_BASE)
    spans = rows.select("num", "starts", "ends", "text")
    return map_texts(spans, "num bigint, at bigint, h1 bigint, h2 bigint", work, lambda: [Powers(b) for b in bases])


def _kept(rows: DataFrame) -> DataFrame:
    """``(num, n_removed, kept_sha256)`` after the words under the spans are gone."""

    def work(rows: pa.RecordBatch, _):
        words, text, _ = _words(rows.column(3))
        first = np.searchsorted(text, np.arange(rows.num_rows + 1))
        removed, shas = [], []
        for i in range(rows.num_rows):
            size = first[i + 1] - first[i]
            change = np.zeros(size + 1, np.int64)
            np.add.at(change, rows.column(1)[i].values.to_numpy(), 1)
            np.add.at(change, rows.column(2)[i].values.to_numpy(), -1)
            keep = first[i] + np.flatnonzero(np.cumsum(change)[:size] == 0)
            removed.append(size - len(keep))
            shas.append(_joined_sha([words[i] for i in keep.tolist()]))
        return rows.column(0), removed, shas

    spans = rows.select("num", "starts", "ends", "text")
    return map_texts(spans, "num bigint, n_removed bigint, kept_sha256 string", work)


def repeated_spans(docs: DataFrame, read: DataFrame, rid: Column, window: int) -> DataFrame:
    """``(num, s, e)``: spans of words that together cover every repeated window."""
    shared = shared_places(read, "substring-shared")
    alike = staged(classes(shared, "substring-classes"), "substring-rivals")
    whole = shared.join(alike.filter("size > 1").select("key", "ctx"), ["key", "ctx"])
    whole = whole.select("num", F.col("at").alias("s"), (F.col("at") + F.col("n") + window - 1).alias("e"))
    doubtful = alike.filter("rivals > 1").select("first.num", F.col("first.at").alias("s"), F.expr("first.at + first.n").alias("e"))
    listed = spans_by_document(doubtful).join(read.select("num", "rid"), "num")
    windows = staged(_windows(with_text(listed, docs, rid), window), "substring-windows")
    again = windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2")
    found = windows.join(staged(again, "substring-again"), ["h1", "h2"]).select("num", F.col("at").cast("int").alias("s"))
    return whole.union(found.select("num", "s", F.col("s") + window))


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS, rid: Column | None = None) -> DataFrame:
    """``(rid, doc_id, n_words, n_removed, kept_sha256)`` per document.

    Words under a window of ``window`` words that also starts anywhere else go; all
    windows are judged on the input. Runs of equal symbols and then pairs of left and
    right symbols are named in rounds. A name is a 64-bit function of its parts and
    so the same everywhere, without a dictionary that would have to be shuffled in
    every round; a text keeps its words until a symbol's name occurs twice. Symbols
    that occur again bring the windows around them, places with the same text are
    settled as a class, and one place of each class is compared window by window
    with its rivals, by 128-bit hashes.

    Null and empty texts have no words; shorter texts have no window; repeated rows
    are documents of their own, so a copied document of ``window`` words or more goes
    with its copy. A null id stays null. ``rid`` must name rows the same way each time
    ``docs`` is read; without it the texts are staged.
    """
    if rid is None:
        docs = staged(numbered(docs), "substring-docs")
        rid = F.col("rid")
    read = read_places(docs, rid, window)
    spans = staged(spans_by_document(repeated_spans(docs, read, rid, window)), "substring-spans")
    touched = _kept(with_text(spans.join(read.select("num", "rid"), "num"), docs, rid))
    out = read.select("num", "rid", "doc_id", "n_words", "sha256").join(touched, "num", "left")
    return out.select(
        "rid",
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), rid=stored_row()).drop("rid")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW_WORDS - 1}], ' ') AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW_WORDS - 2})) AS i FROM d)),
again AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW_WORDS})) AS p FROM win SEMI JOIN again USING (t)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
