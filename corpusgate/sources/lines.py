"""Line files as DataFrames, with physical line numbers and record positions.

A line number in a file that is read as many splits is the line's rank inside
its split plus the number of lines in the earlier splits of the file. The first
read counts lines per split, the second adds the offsets. No line is shuffled
while the split table (one small row per split) is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.errors import ENV_ERROR, CorpusError
from corpusgate.functions.text import is_blank
from corpusgate.functions.json import HIDDEN
from corpusgate.session import prepare, shared_dir, staged

# The split table is broadcast up to this many rows (about 200 bytes each);
# beyond, lines and offsets meet in a shuffled join on (file, block), whose
# groups are no larger than one split.
BROADCAST_SPLITS = 500_000

_ROW_BITS = 33  # bits monotonically_increasing_id() leaves for the row number


def raw_lines(
    spark: SparkSession,
    path: str | list[str],
    line_sep: str | None = None,
    only_file: str | None = None,
) -> DataFrame:
    r"""``(file, block, seq, value)``: one row per physical line, blanks kept.

    ``seq`` rises along each split but is no line number yet. Lines end at
    ``\n``, ``\r\n`` or ``\r`` unless ``line_sep`` says otherwise. ``only_file``
    keeps the scan to one file of the path.
    """
    prepare(spark)
    reader = spark.read.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    try:
        text = reader.text(path)
    except AnalysisException as exc:
        raise CorpusError(
            ENV_ERROR, f"cannot open {path}", "Check that the path exists and is readable."
        ) from exc
    if only_file is not None:
        text = text.filter(F.col("_metadata.file_path") == only_file)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def split_table(raw: DataFrame) -> DataFrame:
    """One row per split: where its lines and its non-blank lines start.

    The window runs over this table only, never over lines.
    """
    counts = raw.groupBy("file", "block").agg(
        F.min("seq").alias("first_seq"),
        F.count("*").alias("n_lines"),
        F.count_if(~is_blank(F.col("value"))).alias("n_records"),
    )
    in_file = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    partition = F.shiftright("first_seq", _ROW_BITS)
    in_partition = (
        Window.partitionBy(partition)
        .orderBy("first_seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.select(
        "file",
        "block",
        "first_seq",
        "n_lines",
        "n_records",
        F.coalesce(F.sum("n_lines").over(in_file), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("n_records").over(in_file), F.lit(0)).alias("records_before"),
        (
            F.shiftleft(partition, _ROW_BITS)
            + F.coalesce(F.sum("n_records").over(in_partition), F.lit(0))
        ).alias("first_record_seq"),
    )


def _with_offsets(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Join offsets onto lines; the table is checkpointed so its size is known."""
    shared_dir(lines.sparkSession)
    fixed = splits.checkpoint()
    small = fixed.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    return lines.join(F.broadcast(fixed) if small else fixed.hint("merge"), ["file", "block"], "left")


def _checked(position: Column, first: Column, count: Column, seq: Column) -> Column:
    """The position, or a failed job if the two reads were split differently."""
    return F.when((seq >= first) & (seq < first + count), position).otherwise(
        F.raise_error(F.lit("a file was split differently in the two reads")).cast("bigint")
    )


def number_lines(raw: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """``(file, line_no, value)``: 1-based physical numbers, blanks included."""
    joined = _with_offsets(raw, split_table(raw) if splits is None else splits)
    line_no = F.col("seq") - F.col("first_seq") + F.col("lines_before") + 1
    return joined.select(
        "file",
        _checked(line_no, F.col("first_seq"), F.col("n_lines"), F.col("seq")).alias("line_no"),
        "value",
    )


def drop_blank(lines: DataFrame) -> DataFrame:
    """Drop blank lines; the others keep their numbers."""
    return lines.filter(~is_blank(F.col("value")))


def number_records(raw: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """``(file, index, line_no, value)`` of the non-blank lines.

    ``index`` is the 0-based position among the non-blank lines of the file.
    """
    splits = split_table(raw) if splits is None else splits
    kept = drop_blank(raw).withColumn("record_seq", F.monotonically_increasing_id())
    joined = _with_offsets(kept, splits)
    index = F.col("record_seq") - F.col("first_record_seq") + F.col("records_before")
    line_no = F.col("seq") - F.col("first_seq") + F.col("lines_before") + 1
    return joined.select(
        "file",
        _checked(
            index, F.col("first_record_seq"), F.col("n_records"), F.col("record_seq")
        ).alias("index"),
        _checked(line_no, F.col("first_seq"), F.col("n_lines"), F.col("seq")).alias("line_no"),
        "value",
    )


def running_offsets(rows: DataFrame, order: str, counts: list[str]) -> DataFrame:
    """``rows`` with ``<count>_before``: the sum of each count over all rows that come
    earlier by ``order``, which is unique.

    A prefix sum in two levels: rows are range partitioned and summed up inside their
    part, and the totals of the parts, one row each, are added up before.
    """
    spark = rows.sparkSession
    part = f"{HIDDEN}part"
    dealt = staged(rows.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "offsets")
    totals = dealt.groupBy(part).agg(*[F.sum(c).alias(c) for c in counts]).orderBy(part).collect()  # one row per part
    sums, before = [0] * len(counts), []
    for row in totals:
        before.append((row[part], *sums))
        sums = [s + (row[c] or 0) for s, c in zip(sums, counts)]
    names = [f"{HIDDEN}{c}" for c in counts]
    schema = ", ".join([f"{part} int", *[f"{n} bigint" for n in names]])
    inside = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(spark.createDataFrame(before, schema)), part)
    for count, name in zip(counts, names):
        out = out.withColumn(f"{count}_before", F.col(name) + F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return out.drop(part, *names)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return number_lines(raw_lines(spark, path))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return number_records(raw_lines(spark, path))


def file_names(df: DataFrame) -> list[str]:
    """Names of a file relation's files in order, empty ones too.

    They come from the listing the driver already holds; no file is opened.
    """
    return sorted(name.replace("file:///", "file:/", 1) for name in df.inputFiles())


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, bytes)`` of all files, empty ones too; no content is read."""
    prepare(spark)
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as exc:
        raise CorpusError(
            ENV_ERROR, f"cannot open {path}", "Check that the path exists and is readable."
        ) from exc
    names = spark.createDataFrame([(name,) for name in file_names(found)], "file string")
    # A scan leaves empty files out.
    sizes = found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))
    return names.join(sizes, "file", "left").select(
        "file", F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes")
    )
