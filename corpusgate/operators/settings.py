"""Run settings as JSON, one row per run: defaults, types and ranges.

The checks run in a fixed order and the first failing one is reported; they are
one projection over the parsed settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.functions import json as J
from corpusgate.functions.text import sql_lookup
from corpusgate.session import prepare

# Required run keys, accepted methods and the default method.
RUN_KEYS = ["model", "dataset", "output"]
METHODS = ["lora", "qlora"]
DEFAULT_METHOD = "qlora"

# Hyperparameter, kind, default, minimum, maximum.
HYPERPARAMETERS = [
    ("lora_r", "int", 16, 1, None),
    ("lora_alpha", "int", 16, 1, None),
    ("lora_dropout", "float", 0.0, 0.0, 1.0),
    ("learning_rate", "float", 2e-4, 0.0, None),
    ("max_seq_len", "int", 2048, 1, None),
    ("batch_size", "int", 2, 1, None),
    ("grad_accum", "int", 4, 1, None),
    ("max_steps", "int", 60, 1, None),
    ("seed", "int", 3407, 0, None),
    ("load_in_4bit", "bool", True, None, None),
]

_SQL_TYPE = {"int": "bigint", "float": "double", "bool": "boolean"}
_NOUN = {"int": "an integer", "float": "a number", "bool": "a boolean"}


def _bounds(low, high) -> str:
    return f"[{low}, {high}]" if high is not None else f">= {low}"


def _is_kind(wanted: str, value: str) -> str:
    found = f"schema_of_variant({value})"
    if wanted == "int":
        return f"{found} = 'BIGINT'"
    if wanted == "bool":
        return f"{found} = 'BOOLEAN'"
    return f"({found} IN ('BIGINT', 'DOUBLE') OR startswith({found}, 'DECIMAL'))"


def _templates() -> dict[str, str]:
    """Message per rule; {got} is the offending type or value."""
    out = {"invalid_json": "settings are not valid JSON"}
    out |= {f"{key}:required": f"missing required key '{key}'" for key in RUN_KEYS}
    out["method:one_of"] = "invalid method {got}"
    for name, kind, _, low, high in HYPERPARAMETERS:
        out[f"{name}:type"] = f"{name} must be {_NOUN[kind]}, got {{got}}"
        where = "must be" if kind == "int" else "must be in"
        out[f"{name}:range"] = f"{name} {where} {_bounds(low, high)}, got {{got}}"
    return out


RUN, HP, FAULT = (f"{J.HIDDEN}{name}" for name in ("run", "hp", "fault"))


def _fault(rule: str, kind: str = "NULL", shown: str = "NULL") -> str:
    return (
        f"named_struct('rule', '{rule}', 'kind', CAST({kind} AS STRING), "
        f"'shown', CAST({shown} AS STRING))"
    )


def _branches() -> list[tuple[str, str]]:
    """(condition, violation) in the order of the checks."""
    method = f"{RUN}.method"
    allowed = ", ".join(f"'{m}'" for m in METHODS)
    out = [(f"NOT {J.is_strict()}", _fault("invalid_json"))]
    for key in RUN_KEYS:
        out.append((f"{RUN}.{key} IS NULL", _fault(f"{key}:required")))
    out.append(
        (
            f"{method} IS NOT NULL AND NOT ({J.is_string(method)} "
            f"AND CAST({method} AS STRING) IN ({allowed}))",
            _fault("method:one_of", shown=f"to_json({method})"),
        )
    )
    for name, wanted, _, low, high in HYPERPARAMETERS:
        value = f"{HP}.{name}"
        out.append(
            (
                f"{value} IS NOT NULL AND NOT {_is_kind(wanted, value)}",
                _fault(f"{name}:type", kind=J.kind(value)),
            )
        )
        if low is not None:
            number = f"try_variant_get({value}, '$', '{_SQL_TYPE[wanted]}')"
            test = f"{number} < {low}"
            if high is not None:
                # Spark orders NaN above every number; here it passes.
                test += f" OR ({number} > {high} AND NOT isnan({number}))"
            out.append((test, _fault(f"{name}:range", shown=number)))
    return out


def _resolved() -> str:
    """The settings with absent ones filled in."""
    pairs = [f"'{key}', try_variant_get({RUN}.{key}, '$', 'string')" for key in RUN_KEYS]
    method = f"try_variant_get({RUN}.method, '$', 'string')"
    pairs.append(f"'method', coalesce({method}, '{DEFAULT_METHOD}')")
    for name, kind, default, _, _ in HYPERPARAMETERS:
        value = f"try_variant_get({HP}.{name}, '$', '{_SQL_TYPE[kind]}')"
        pairs.append(f"'{name}', coalesce({value}, CAST({default} AS {_SQL_TYPE[kind]}))")
    return f"named_struct({', '.join(pairs)})"


def check_settings(df: DataFrame, column: str = "settings") -> DataFrame:
    """Add ``rule``, ``message`` (NULL when valid) and ``resolved``.

    ``column`` holds ``{"run": {...}, "hyperparameters": {...}}`` as JSON.
    Absent hyperparameters take their defaults; a present value of the wrong
    type is never replaced by one.
    """
    prepare(df.sparkSession)
    J.require_free(df, ["rule", "message", "resolved"])
    parsed = (
        J.parse_json(df, column)
        .withColumn(RUN, F.expr(J.record(".run", RUN_KEYS + ["method"])))
        .withColumn(HP, F.expr(J.record(".hyperparameters", [h[0] for h in HYPERPARAMETERS])))
    )
    whens = " ".join(f"WHEN {test} THEN {fault}" for test, fault in _branches())
    judged = J.settled(parsed, FAULT, F.expr(f"CASE {whens} END"))
    got = f"coalesce({J.type_name(f'{FAULT}.kind')}, {FAULT}.shown, '')"
    return judged.selectExpr(
        *[f"`{c}`" for c in df.columns],
        f"{FAULT}.rule AS rule",
        f"replace({sql_lookup(f'{FAULT}.rule', _templates())}, '{{got}}', {got}) AS message",
        f"if({FAULT} IS NULL, {_resolved()}, NULL) AS resolved",
    )
