"""Fingerprints of files, corpora and tables, and the manifests built on them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgate.functions.digest import hash_sum, row_hash, row_text, sha256_hex
from corpusgate.functions.text import utc_stamp
from corpusgate.session import new_path
from corpusgate.sources.lines import file_list, number_lines, raw_lines

_MARK = b"\xef\xbb\xbf"
# Endings by which Spark's readers choose a decompressor.
COMPRESSED = (".gz", ".bz2", ".deflate", ".zst", ".lz4", ".snappy")
_WHOLE = str(1 << 50)  # no file is longer


class _FileHash:
    """SHA-256 and line count of one file, fed with runs of its lines.

    The reader leaves out the last line end and a leading byte order mark; the number
    of bytes that are missing tells which. A file that the reader decompresses has no
    known size, and each of its lines counts as ended.
    """

    def __init__(self, name: str, size: int):
        self.name, self.size, self.fed, self.lines = name, size, -1, 0
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(_MARK)

    def add(self, lines: list[bytes]) -> None:
        run = b"\n".join(lines if self.fed < 0 else [b"", *lines])
        self.fed = max(self.fed, 0) + len(run)
        self.lines += sum(1 for line in lines if line.strip())
        self.plain.update(run)
        self.marked.update(run)

    def row(self) -> tuple[str, str, int]:
        rest = 1 if self.name.endswith(COMPRESSED) else self.size - self.fed
        if rest not in (0, 1, 3, 4):
            raise ValueError(f"{self.name} has {self.size} bytes, but its lines have {self.fed}")
        digest = self.marked if rest > 1 else self.plain
        digest.update(b"\n" * (rest % 3))
        return self.name, digest.hexdigest(), self.lines


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, sha256, line_count)`` from ``(file, size, value)``, the lines of files in order."""
    now = None

    def done() -> pa.RecordBatch:
        columns = [[x] for x in now.row()]
        return pa.RecordBatch.from_pydict(dict(zip(("file", "sha256", "line_count"), columns)))

    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        start = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if now is None or now.name != name:
                if now is not None:
                    yield done()
                now = _FileHash(name, batch.column(1)[start].as_py())
            now.add(batch.column(2).slice(start, end - start).to_pylist())
            start = end
    if now is not None:
        yield done()


def file_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, bytes, sha256, line_count)`` per file.

    ``sha256`` covers the raw bytes, ``line_count`` the ``\\n``-separated lines that are
    not blank as ASCII bytes; of a file that Spark's readers decompress by its name,
    both are of its lines as read, each of them ended. A file of any size is read once,
    as a stream, by one task, because the hash is sequential; files are hashed side by side.
    Nothing is shuffled but a row for each file. ``line_digests`` splits files.
    """
    files = file_list(spark, path)
    # In a session of its own a file is one split, and no split holds two files.
    whole = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        whole.conf.set(key, _WHOLE)
    lines = whole.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"),
    )
    hashed = new_path(spark, "file-digests")
    lines.mapInArrow(_hash_files, "file string, sha256 string, line_count bigint").write.parquet(hashed)
    return files.join(spark.read.parquet(hashed), "file", "left").select(
        "file",
        "bytes",
        F.coalesce("sha256", sha256_hex(F.lit("").cast("binary"))).alias("sha256"),
        F.coalesce("line_count", F.lit(0).cast("bigint")).alias("line_count"),
    )


def line_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, bytes, lines, digest)`` per file, where a file is read by many tasks.

    ``digest`` is the SHA-256 of the file's size and of the sum of a hash for each line
    and its number. Sums merge, so it is the same however the file is split, and no line
    is moved; numbers make it depend on the order. The size of the file tells a missing
    last line end.
    """
    lines = number_lines(raw_lines(spark, path, line_sep="\n"))
    sums = lines.groupBy("file").agg(
        F.count("*").alias("lines"), hash_sum(row_hash([F.col("line_no"), F.col("value")])).alias("sum")
    )
    text = F.concat_ws(":", F.col("bytes").cast("string"), F.coalesce("sum", F.lit("0")))
    return file_list(spark, path).join(sums, "file", "left").select(
        "file", "bytes", F.coalesce("lines", F.lit(0).cast("bigint")).alias("lines"), sha256_hex(text).alias("digest")
    )


def corpus_digest(digests: DataFrame, root: str | None = None) -> DataFrame:
    """One row for a whole directory: ``(files, line_count, digest)``.

    The digest sums a hash per file, of its contents and, with ``root``, of its path
    below that folder; it depends on every file and on no order. The job fails if a
    file is not below ``root``.
    """
    parts = [F.col("sha256")]
    if root is not None:
        top = re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/") + "/"
        at = F.instr("file", top)
        outside = F.raise_error(F.concat(F.col("file"), F.lit(f" is not below {root}"))).cast("string")
        parts.insert(0, F.when(at > 0, F.substr("file", at + F.length(F.lit(top)))).otherwise(outside))
    return digests.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("line_count"), F.lit(0)).alias("line_count"),
        hash_sum(row_hash(parts)).alias("digest"),
    )


def table_digest(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Row count and order-insensitive digest of ``cols``, per group if asked.

    Equal rows count each time; times count as microseconds, whatever the session's
    time zone. One hash aggregate with a map-side partial sum.
    """
    timed = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    values = [F.unix_micros(c) if c in timed else F.col(c) for c in cols]
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"),
        hash_sum(row_hash(values)).alias("digest"),
    )


def manifest(
    digest: DataFrame,
    *,
    model: str,
    method: str,
    hyperparameters: Column,
    timestamp: str | Column | None = None,
    sha256: str = "sha256",
    line_count: str = "line_count",
) -> DataFrame:
    """Run record rows: model, method, dataset, hyperparameters, timestamp."""
    return digest.select(
        F.lit(model).alias("model"),
        F.lit(method).alias("method"),
        F.struct(F.col(sha256).alias("sha256"), F.col(line_count).alias("line_count")).alias("dataset"),
        hyperparameters.alias("hyperparameters"),
        utc_stamp(timestamp).alias("timestamp"),
    )


def manifest_drift(before: DataFrame, after: DataFrame, on: list[str], digest: str) -> DataFrame:
    """Status per key of two manifests: same, changed, added or removed. Null keys
    match each other."""
    left = before.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(on)], F.col(digest).alias("before"))
    right = after.select(*[F.col(c).alias(f"_a{i}") for i, c in enumerate(on)], F.col(digest).alias("after"))
    alike = F.lit(True)
    for i in range(len(on)):
        alike = alike & F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}"))
    keys = [F.coalesce(f"_b{i}", f"_a{i}").alias(c) for i, c in enumerate(on)]
    status = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") == F.col("after"), "same")
        .otherwise("changed")
    )
    return left.join(right, alike, "full_outer").select(*keys, status.alias("status"))


def run_groups(runs: DataFrame) -> DataFrame:
    """Runs that share model, method, data and hyperparameters."""
    return runs.groupBy(
        "model", "method", F.col("dataset.sha256").alias("sha256"), F.to_json("hyperparameters").alias("settings")
    ).agg(
        F.count("*").alias("runs"),
        F.min("timestamp").alias("first_run"),
        F.max("timestamp").alias("last_run"),
    )


def exact_duplicates(rows: DataFrame, cols: list[str], key: str) -> DataFrame:
    """``(digest, copies, first)`` of the contents of ``cols`` that several rows share;
    ``first`` is the smallest ``key``, the row to keep. Copies merge before the shuffle."""
    digest = sha256_hex(row_text([F.col(c) for c in cols])).alias("digest")
    groups = rows.groupBy(digest).agg(F.count("*").alias("copies"), F.min(key).alias("first"))
    return groups.filter("copies > 1")
