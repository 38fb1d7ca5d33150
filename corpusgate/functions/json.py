"""Strict JSON parsing into VARIANT, and type tests on the parsed values.

The tests are SQL text: a rule set is parsed in one call instead of being built
node by node from Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.errors import USER_ERROR, CorpusError
from corpusgate.functions.text import sql_lookup, sql_strip, sql_text

# NaN and the infinities are accepted, single quotes and comments are not; one
# string or number may be as long as the line. Nesting keeps the parser's limit of
# 1,000, as a VARIANT is built recursively on a thread's stack.
PARSE_OPTIONS = {
    "mode": "PERMISSIVE",
    "allowNonNumericNumbers": "true",
    "allowSingleQuotes": "false",
    "maxStringLen": "2147483647",
    "maxNumLen": "2147483647",
}

# A VARIANT holds at most 128 MiB; a line near that size is refused loudly
# instead of being called malformed.
MAX_LINE_BYTES = 120 * 1024 * 1024

END_MARK = "~~end"

# Columns that only exist inside a plan start like this.
HIDDEN = "__corpusgate_"


def _variant(text: str) -> str:
    options = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in PARSE_OPTIONS.items())
    return f"from_json({text}, 'variant', map({options}))"


def parse_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add a hidden column, ``[line, "~~end"]`` as VARIANT, see ``is_strict``.

    The parser stops after the first complete value and would accept trailing
    text. With the mark behind the line, the second element is the mark only if
    the line is one complete value. A line that itself contains the mark is
    tested first: as ``[line]`` it must have one element and as ``{"r":line}``
    it must parse, and no trailing text can satisfy both.
    """
    # Stripping walks the whole line; one in braces has nothing to strip.
    braced = f"startswith(`{column}`, '{{') AND endswith(`{column}`, '}}')"
    text = f"if({braced}, `{column}`, {sql_strip(f'`{column}`')})"
    tail = sql_text(f',"{END_MARK}"]')
    too_long = sql_text(f"a line exceeds {MAX_LINE_BYTES} bytes")
    alone = _variant(f"concat('[', {text}, ']')")
    member = _variant(f"""concat('{{"r":', {text}, '}}')""")
    return lines.withColumn(
        f"{HIDDEN}line",
        F.expr(
            f"CASE WHEN octet_length(`{column}`) > {MAX_LINE_BYTES} "
            f"THEN CAST(raise_error({too_long}) AS VARIANT) "
            f"WHEN contains(`{column}`, '{END_MARK}') AND ({member} IS NULL "
            f"OR try_variant_get({alone}, '$[1]', 'variant') IS NOT NULL) THEN NULL "
            f"ELSE {_variant(f"concat('[', {text}, {tail})")} END"
        ),
    )


def is_strict() -> str:
    """Whether the parsed line is one complete JSON value and nothing else."""
    return f"coalesce(try_variant_get({HIDDEN}line, '$[1]', 'string') = '{END_MARK}', false)"


def at(path: str = "", kind: str = "variant") -> str:
    """A value inside the parsed line; NULL only when absent or not convertible.

    JSON null is a value of its own.
    """
    return f"try_variant_get({HIDDEN}line, '$[0]{path}', '{kind}')"


def keys(path: str = "") -> str:
    """Keys of an object, NULL for anything that is not one."""
    return f"map_keys({at(path, 'map<string,variant>')})"


def require_free(df: DataFrame, names: list[str]) -> None:
    """Raise where the caller's columns clash with those that an operator adds."""
    taken = sorted(c for c in df.columns if c.lower() in names or c.lower().startswith(HIDDEN))
    if taken:
        raise CorpusError(USER_ERROR, f"columns {taken} are added by this operator", "Rename them before.")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Catalyst copies an expression into every filter it pushes below the
    projection that defines it, which would parse a line again for each use. It
    does not push a filter below a generator, so the value is generated as the
    only element of an array.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def record(path: str, names: list[str]) -> str:
    """An object as a struct of parsed values, NULL where one is absent."""
    return at(path, f"struct<{','.join(f'{name}:variant' for name in names)}>")


def kind(col: str) -> str:
    """Type of a parsed value: OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID, …"""
    return f"regexp_extract(schema_of_variant({col}), '^[A-Z]+', 0)"


def is_string(col: str) -> str:
    return f"schema_of_variant({col}) = 'STRING'"


# JSON kinds under the names that appear in messages; every other
# kind is a number with a fraction.
TYPE_NAMES = {
    "OBJECT": "dict",
    "ARRAY": "list",
    "STRING": "str",
    "BIGINT": "int",
    "BOOLEAN": "bool",
    "VOID": "NoneType",
}


def type_name(kind_name: str) -> str:
    named = sql_lookup(kind_name, TYPE_NAMES)
    return f"if({kind_name} IS NULL, NULL, coalesce({named}, 'float'))"
