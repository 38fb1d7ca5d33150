"""Best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import slices, staged, table, text_bytes

CAPACITY = 2048
OPEN_BINS = 1024
END_ID = 0
CHUNK_BYTES = 1 << 20
# Pieces of part-filled bins that one task packs again, and where their sequence ids start.
LOOSE = 1 << 17
AGAIN = 1 << 62


class OpenBins:
    """Bounded-space best fit.

    Bit ``f`` of ``free`` is set while some open bin has ``f`` places left. A piece
    goes to the open bin it fills best. If none has room a new one is opened, and
    if that is one too many the fullest open bin closes. ``closed`` gathers the bins
    that are full or were closed.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        bin_id = stack.pop()
        if not stack:
            self.free &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """The bin that gets a piece of ``size`` and the piece's place in it."""
        fitting = self.free >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open >= self.limit:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            free, bin_id = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.bins[left].append(bin_id)
            self.free |= 1 << left
            self.open += 1
        else:
            self.closed.append(bin_id)
        return bin_id, self.capacity - free


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the others, in order, from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _fast_coder(vocabulary: str) -> Callable[[str], np.ndarray] | None:
    """A coder for a byte-level vocabulary whose merges stand in the order of their ids:
    then ids are ranks, and a rank coder gives the tokenizer's own ids several times faster."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as file:
        made = json.load(file)
    model, cutter = made["model"], made.get("pre_tokenizer") or {}
    usual = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if model.get("type", "BPE") != "BPE" or not usual or not plain or made.get("normalizer"):
        return None
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)):
        return None
    byte, added = _byte_of(), made.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        return None
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if len([t for t in ranks if len(t) == 1]) != 256 or len(ranks) != 256 + len(merged):
        return None
    coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coder.encode_to_numpy(text, allowed_special="all").astype("<u4")


_CODERS: dict[str, Callable[[str], np.ndarray]] = {}


def coder(vocabulary: str, fast: bool = True) -> Callable[[str], np.ndarray]:
    """The ids of a text by the tokenizer file ``vocabulary`` with its default settings
    and no special tokens added; made once in a worker process. Strings of added tokens
    in a text become those tokens, as by default."""
    key = f"{vocabulary} {fast}"
    if key not in _CODERS:
        from tokenizers import Tokenizer

        made = _fast_coder(vocabulary) if fast else None
        if made is None:
            tokenizer = Tokenizer.from_file(vocabulary)
            made = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        _CODERS[key] = made
    return _CODERS[key]


def piece_sizes(n: int, capacity: int) -> list[int]:
    """A document of ``n`` ids: whole if it fits, else full pieces behind a shorter first one."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    ids: bool = True,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)``, a row per piece.

    ``ids`` are little-endian unsigned 32-bit token ids, the end id included; with
    ``ids=False`` the column is ``ids_crc32``, their checksum. Each scan task packs the
    documents it reads, in their order, and holds the pieces of ``open_bins`` bins. What
    is left in open bins at its end is packed again in a second round, in groups of about
    ``LOOSE`` pieces, largest first, so that the number of sequences does not grow with
    the number of tasks; only sizes are shuffled for it. A null or empty text is the end
    id alone, repeated rows are packed each, a null ``doc_id`` stays null, and texts of
    any length are cut. ``sequence_id`` holds the task's or group's number and a count.
    """
    kind = "ids binary" if ids else "ids_crc32 bigint"
    columns = f"doc_id bigint, piece int, start bigint, length bigint, {kind}, sequence_id bigint, offset bigint, loose boolean"
    names = [c.split()[0] for c in columns.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encode, bins, held = coder(path), OpenBins(capacity, open_bins), {}
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40

        def rows(done: list[tuple], loose: bool) -> pa.RecordBatch:
            data = [[*c] for c in zip(*done)] or [[] for _ in names[:-1]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary() if ids else pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(data, kinds)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([loose] * len(done), pa.bool_())], names=names)

        for batch in batches:
            for part in slices(batch, np.diff(text_bytes(batch.column(1))[1]), CHUNK_BYTES):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    coded = encode(text or "").tobytes() + end
                    start = 0
                    for piece, size in enumerate(piece_sizes(len(coded) // 4, capacity)):
                        bin_id, offset = bins.place(size)
                        mine = coded[4 * start : 4 * (start + size)]
                        row = (doc_id, piece, start, size, mine if ids else zlib.crc32(mine), base + bin_id, offset)
                        held.setdefault(bin_id, []).append(row)
                        start += size
                yield rows([row for b in bins.closed for row in held.pop(b)], False)
                bins.closed.clear()
        yield rows([row for some in held.values() for row in some], True)

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, columns)
    made = staged(made, "packing-pieces")
    loose = made.filter("loose").drop("loose")
    moved = staged(_packed_again(loose.select("sequence_id", "offset", "length"), capacity), "packing-again")
    moved = loose.join(moved, ["sequence_id", "offset"])
    moved = moved.withColumns({"sequence_id": F.col("new_sequence"), "offset": F.col("new_offset")})
    return made.filter("NOT loose").drop("loose").union(moved.select(*names[:-1]))


def _packed_again(loose: DataFrame, capacity: int) -> DataFrame:
    """``(sequence_id, offset, new_sequence, new_offset)``: pieces that the tasks left in
    part-filled bins, by best fit from the largest on, a group of bounded size at a time."""
    groups = -(-loose.count() // LOOSE)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        bins = OpenBins(capacity, len(rows))
        at = [bins.place(size) for size in rows["length"].tolist()]
        base = AGAIN | int(key[0]) << 30
        return rows.assign(new_sequence=[base + b for b, _ in at], new_offset=[o for _, o in at]).drop(columns="length")

    group = F.expr(f"pmod(xxhash64(sequence_id, offset), {max(groups, 1)})").alias("group")
    schema = "sequence_id bigint, offset bigint, new_sequence bigint, new_offset bigint"
    return loose.select("sequence_id", "offset", "length").groupBy(group).applyInPandas(fit, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ids=False)
