"""Staged tables, Arrow passes over whole texts, and byte arrays of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusgate.session import new_path

CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once below ``spark.checkpoint.dir`` and read
    back: lineage ends here, and generated ids keep their values."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """As ``staged``; the shuffle files of the write go when it ends, not when the driver
    next collects garbage. For large shuffles that follow one another."""
    conf, option = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(option)
    conf.set(option, "true")
    try:
        return staged(df, name)
    finally:
        conf.set(option, before)


def numbered(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """``(rid, doc_id, text)``: ``rid`` tells rows apart that share a ``doc_id``.

    It is the caller's expression, or a count that is fixed only once the rows, or
    what is made of them, are staged."""
    number = F.monotonically_increasing_id() if rid is None else rid
    return docs.select(number.cast("string").alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def stored_row() -> Column:
    """Identifies a row of a DataFrame read from Parquet by file and place."""
    return F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` as read from Parquet without the rows whose ``rid`` is in ``dropped``;
    ``rid`` is ``stored_row()``."""
    gone = dropped.select(F.col("rid").alias("_gone"))
    return docs.withColumn("_stored", stored_row()).join(gone, F.col("_stored") == F.col("_gone"), "left_anti").drop("_stored")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; an unknown id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and each text's bounds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, size: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes together, or one longer row."""
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    schema: str,
    work: Callable,
    setup: Callable | None = None,
    column: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Apply ``work(rows, state)`` to small runs of rows, in their order.

    ``work`` gets an Arrow batch and returns its output columns, Arrow or numpy.
    Memory follows ``chunk_bytes`` or the longest text, never the partition.
    ``setup()`` makes the state of a task.
    """
    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
            for rows in slices(batch, np.diff(bounds), chunk_bytes):
                columns = work(rows, state)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, kinds)],
                    schema=kinds,
                )

    return df.mapInArrow(run, schema)


def lists(counts: np.ndarray, values, kind: pa.DataType) -> pa.ListArray:
    """One list per row, of ``counts`` of the ``values``."""
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, type=kind))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(max(n, 1 << 16), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span ``values[start:end]``; equal spans hash alike
    wherever they stand."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    whole = (sums[ends] - sums[starts]) * down[starts]
    return scrambled(whole + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(is_word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of word bytes."""
    if len(is_word) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    inner = bounds[1:-1]
    inner = inner[inner < len(is_word)]
    first[inner] = is_word[inner]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    before = inner[inner > 0] - 1
    last[before] = is_word[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)
