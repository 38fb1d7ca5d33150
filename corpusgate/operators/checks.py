"""Typed, ranged and set constraints over table columns.

All constraints of a table are counted in one aggregate over one scan; the
report has one row per check.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named condition that marks a row as bad."""

    id: str
    bad: Column
    message: str
    remediation: str
    severity: str = "error"


def required(col: str, severity: str = "error") -> Check:
    return Check(
        f"{col}:required", F.col(col).isNull(), f"{col} must be present", f"Fill {col}.", severity
    )


def int_min(col: str, minimum: int, severity: str = "error") -> Check:
    """Values below ``minimum``; absent values are left to ``required``."""
    return Check(
        f"{col}:int_min",
        F.col(col) < minimum,
        f"{col} must be >= {minimum}",
        f"Set {col} to an integer >= {minimum}.",
        severity,
    )


def _limit(bound: float) -> Column:
    """A bound as a decimal, so that whole numbers are not rounded to doubles."""
    exact = Decimal(str(bound))
    if not exact.is_finite() or len(f"{abs(exact):f}") > 38:
        return F.lit(float(bound))
    return F.lit(exact)


def in_range(
    col: str,
    minimum: float | None = None,
    maximum: float | None = None,
    severity: str = "error",
    allow_nan: bool = False,
) -> Check:
    """Values of a numeric column outside the inclusive bounds, either of which may
    be missing.

    Whole and decimal numbers are compared exactly. NaN is bad unless ``allow_nan``.
    Spark orders NaN above every number, so it is tested on its own.
    """
    value = F.col(col)
    out, shown = F.lit(False), []
    if minimum is not None:
        out = out | (value < _limit(minimum))
        shown.append(f"at least {minimum}")
    if maximum is not None:
        out = out | (value > _limit(maximum))
        shown.append(f"at most {maximum}")
    bad = F.when(F.isnan(value.cast("double")), F.lit(not allow_nan)).otherwise(out)
    bounds = " and ".join(shown) or "a number"
    return Check(f"{col}:in_range", bad, f"{col} must be {bounds}", f"Make {col} {bounds}.", severity)


def one_of(col: str, allowed: list[str], severity: str = "error", fold: bool = False) -> Check:
    """Values outside a closed set; case counts unless ``fold``."""
    value = F.lower(F.col(col)) if fold else F.col(col)
    shown = ", ".join(sorted(allowed))
    return Check(
        f"{col}:one_of",
        ~value.isin(allowed),
        f"{col} must be one of {shown}",
        f"Use one of {shown}.",
        severity,
    )


def is_type(df: DataFrame, col: str, wanted: str, severity: str = "error") -> Check:
    """A schema check: it fails for every row or for none."""
    actual = df.schema[col].dataType.simpleString()
    return Check(
        f"{col}:type",
        F.lit(actual != wanted),
        f"{col} must be of type {wanted}, is {actual}",
        f"Cast {col} to {wanted}.",
        severity,
    )


def check_columns(df: DataFrame, checks: list[Check]) -> DataFrame:
    """``(id, passed, bad_rows, severity, message, remediation)``, a row per check."""
    counts = df.agg(
        *[F.count_if(F.coalesce(c.bad, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c.id).alias("id"),
                (F.col(f"c{i}") == 0).alias("passed"),
                F.col(f"c{i}").alias("bad_rows"),
                F.lit(c.severity).alias("severity"),
                F.lit(c.message).alias("message"),
                F.when(F.col(f"c{i}") > 0, c.remediation).otherwise("").alias("remediation"),
            )
            for i, c in enumerate(checks)
        ]
    )
    return counts.select(F.inline(rows))


def healthy(report: DataFrame) -> DataFrame:
    """One row: whether every check passed, whatever its severity."""
    return report.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("healthy"),
        F.count_if(~F.col("passed")).alias("failed"),
    )


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill absent values; present values are never replaced."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
