"""Validation report of line files: counts per file in one read.

The report needs line numbers of bad lines only, and a file's first bad line is
the first one of its earliest bad split. So the lines are read once, reduced to
one row per split, and the numbers come from running sums over that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.operators.rules import BLANK, require_schema, validate
from corpusgate.sources.lines import file_list, raw_lines


def file_report(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Per file: lines, blanks, records, valid, invalid, first_bad_line, rule.

    ``rule`` is ``no_records`` for a file without any record, else the rule of
    the first bad line, else NULL.
    """
    require_schema(schema)
    raw = raw_lines(spark, path)
    # Grouping by the outcome keeps every aggregate buffer a number (hash
    # aggregation, no sort).
    judged = validate(raw, schema, keep_blank=True)
    outcome = F.coalesce("rule", F.lit("valid"))
    outcomes = judged.groupBy("file", "block", outcome.alias("outcome")).agg(
        F.count("*").alias("n"), F.min("seq").alias("seq")
    )
    bad = ~F.col("outcome").isin(BLANK, "valid")
    splits = outcomes.groupBy("file", "block").agg(
        F.sum("n").alias("lines"),
        F.sum(F.when(F.col("outcome") == BLANK, F.col("n")).otherwise(0)).alias("blanks"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("invalid"),
        F.min("seq").alias("first_seq"),
        F.min(F.when(bad, F.struct("seq", F.col("outcome").alias("rule")))).alias("first_bad"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.withColumn(
        "first_bad",
        F.when(
            F.col("first_bad").isNotNull(),
            F.struct(
                (
                    F.col("first_bad.seq")
                    - F.col("first_seq")
                    + F.coalesce(F.sum("lines").over(before), F.lit(0))
                    + 1
                ).alias("line_no"),
                F.col("first_bad.rule").alias("rule"),
            ),
        ),
    )
    per_file = numbered.groupBy("file").agg(
        F.sum("lines").alias("lines"),
        F.sum("blanks").alias("blanks"),
        F.sum("invalid").alias("invalid"),
        F.min("first_bad").alias("first_bad"),
    )
    zero = F.lit(0).cast("bigint")
    records = F.coalesce(F.col("lines") - F.col("blanks"), zero)
    return (
        file_list(spark, path)
        .join(per_file, "file", "left")
        .select(
            "file",
            F.coalesce("lines", zero).alias("lines"),
            F.coalesce("blanks", zero).alias("blanks"),
            records.alias("records"),
            (records - F.coalesce("invalid", zero)).alias("valid"),
            F.coalesce("invalid", zero).alias("invalid"),
            F.col("first_bad.line_no").alias("first_bad_line"),
            F.when(records == 0, F.lit("no_records")).otherwise(F.col("first_bad.rule")).alias("rule"),
        )
    )
