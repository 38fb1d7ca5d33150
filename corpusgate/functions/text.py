"""Whitespace, labels and quoting on string columns, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace in str.strip() and
# in bytes.strip().
UNICODE_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ASCII_WHITESPACE = "\t\n\x0b\x0c\r "


def strip(col: Column) -> Column:
    """Unicode-aware strip of both ends (``btrim`` alone removes only 0x20)."""
    return F.btrim(col, F.lit(UNICODE_WHITESPACE))


def strip_ascii(col: Column) -> Column:
    """Strip of both ends, ASCII whitespace only."""
    return F.btrim(col, F.lit(ASCII_WHITESPACE))


def is_blank(col: Column) -> Column:
    """Whether only whitespace is left; stops at the first other character."""
    return F.ltrim(col, F.lit(UNICODE_WHITESPACE)) == ""


def is_blank_ascii(col: Column) -> Column:
    return F.ltrim(col, F.lit(ASCII_WHITESPACE)) == ""


def label(col: Column) -> Column:
    """Normalised label: stripped and lower-cased."""
    return F.lower(strip(col))


def contains_any(col: Column, needles: list[str]) -> Column:
    """Case-insensitive substring test against a fixed list."""
    low = F.lower(col)
    test = F.lit(False)
    for needle in needles:
        test = test | low.contains(needle.lower())
    return F.coalesce(test, F.lit(False))


def sql_text(text: str) -> str:
    """A string as a SQL literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_strip(expr: str) -> str:
    return f"btrim({expr}, {sql_text(UNICODE_WHITESPACE)})"


def sql_is_blank(expr: str) -> str:
    return f"ltrim({sql_text(UNICODE_WHITESPACE)}, {expr}) = ''"


def sql_quoted(expr: str) -> str:
    """A string in quotes, the way Python shows it in messages: characters that do not
    print become escapes. Which ones these are follows the JVM's Unicode tables."""
    body = f"replace({expr}, {sql_text(chr(92))}, {sql_text(chr(92) * 2)})"
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = f"replace({body}, {sql_text(raw)}, {sql_text(shown)})"
    hidden = r"r'[\p{C}\p{Z}&&[^ ]]'"
    code = "lower(lpad(hex(ascii(c)), 8, '0'))"
    slash = sql_text(chr(92))
    short = f"if(ascii(c) < 256, concat({slash}, 'x', right({code}, 2)), concat({slash}, 'u', right({code}, 4)))"
    shown = f"if(ascii(c) < 65536, {short}, concat({slash}, 'U', {code}))"
    each = f"transform(regexp_extract_all({body}, '(?s).', 0), c -> if(c rlike {hidden}, {shown}, c))"
    body = f"if({body} rlike {hidden}, array_join({each}, ''), {body})"
    single = f"""concat("'", replace({body}, "'", {sql_text(chr(92) + "'")}), "'")"""
    double = f"""concat('"', {body}, '"')"""
    return f"""if(contains({expr}, "'") AND NOT contains({expr}, '"'), {double}, {single})"""


def sql_lookup(expr: str, table: dict[str, str]) -> str:
    """Value of a fixed table; NULL for anything not in it."""
    pairs = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items())
    return f"try_element_at(map({pairs}), {expr})"


def utc_stamp(timestamp: str | Column | None = None) -> Column:
    """ISO-8601 UTC text of a timestamp; the current time when none is given."""
    if timestamp is None:
        ts = F.current_timestamp()
    elif isinstance(timestamp, str):
        ts = F.lit(timestamp).cast("timestamp")
    else:
        ts = timestamp
    return F.concat(
        F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lit("+00:00"),
    )
