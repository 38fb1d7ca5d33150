"""Hashes of values and rows; everything here is mergeable across partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def row_text(cols: list[Column]) -> Column:
    """Unambiguous text of several values: ``n`` for NULL, else length:value.

    The length keeps neighbouring values apart, the tag keeps NULL apart from
    every string.
    """
    parts = []
    for col in cols:
        text = col.cast("string")
        parts.append(
            F.coalesce(F.concat(F.lit("s"), F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))
        )
    return F.concat(*parts)


def row_hash(cols: list[Column]) -> Column:
    """60-bit number from the SHA-256 of a row's text."""
    head = F.substring(sha256_hex(row_text(cols)), 1, 15)
    return F.conv(head, 16, 10).cast("bigint")


def hash_sum(hashes: Column) -> Column:
    """Order-insensitive sum of row hashes, as text.

    A sum, unlike XOR, does not cancel equal rows. ``decimal(38,0)`` holds the
    sum of more than 10^19 rows. Partial sums merge, so one hot group is summed
    on the map side like any other.
    """
    return F.coalesce(F.sum(hashes.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
