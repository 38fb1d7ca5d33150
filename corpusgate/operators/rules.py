"""The record rules of the chat and task schemas as column expressions.

``validate`` is one projection: no shuffle, no Python, the same for batch and
stream. The first failing rule of a record wins; the order of the ``when``
branches is that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.errors import USER_ERROR, CorpusError
from corpusgate.functions import json as J
from corpusgate.functions.messages import (
    CHAT_KEYS,
    HINTS,
    MESSAGES,
    ROLES,
    SCHEMAS,
    TASK_KEYS,
)
from corpusgate.functions.text import sql_is_blank, sql_lookup, sql_quoted, sql_text
from corpusgate.session import prepare

# Outcome of a blank line; never a violation.
BLANK = "blank"

CHAT_RECORD = "array<struct<role:string,content:string>>"

MESSAGES_COLUMN, FAULT = f"{J.HIDDEN}messages", f"{J.HIDDEN}fault"
ADDED = ["rule", "message", "remediation", "record"]

# Shapes of good records as Spark names them; members come in key order.
CHAT_SHAPE = "OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>>"
TASK_SHAPE = "OBJECT<expected_output: STRING, input: STRING, task: STRING>"


def _fault(
    rule: str,
    at: str = "CAST(NULL AS INT)",
    kind: str = "CAST(NULL AS STRING)",
    words: str = "CAST(NULL AS ARRAY<STRING>)",
) -> str:
    """A violation: its rule, the message index, the offending type or words."""
    return f"named_struct('rule', '{rule}', 'at', {at}, 'kind', {kind}, 'words', {words})"


def _case(branches: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    """First matching branch; this order is the order of the rules."""
    whens = " ".join(f"WHEN {test} THEN {value}" for test, value in branches)
    return f"CASE {whens} ELSE {otherwise} END"


def _top_faults(allowed: list[str]) -> list[tuple[str, str]]:
    known = ", ".join(sql_text(k) for k in allowed)
    extra = f"sort_array(array_except({J.keys()}, array({known})))"
    return [
        (sql_is_blank("value"), _fault(BLANK)),
        (f"NOT {J.is_strict()}", _fault("invalid_json")),
        (f"{J.kind(J.at())} <> 'OBJECT'", _fault("not_object", kind=J.kind(J.at()))),
        (f"size({extra}) > 0", _fault("unexpected_keys", words=extra)),
    ]


def _message_faults() -> str:
    """Violation per message, NULL for a good one."""
    roles = ", ".join(sql_text(r) for r in ROLES)
    absent = _case(
        [
            (f"{J.kind('m.self')} <> 'OBJECT'", _fault("message_not_object", "i", J.kind("m.self"))),
            ("m.role IS NULL", _fault("role_missing", "i")),
        ],
        _fault("content_missing", "i"),
    )
    name = "CAST(m.role AS STRING)"
    fault = _case(
        [
            ("m.role IS NULL OR m.content IS NULL", absent),
            (f"NOT {J.is_string('m.role')}", _fault("role_not_string", "i", J.kind("m.role"))),
            (f"{name} NOT IN ({roles})", _fault("role_invalid", "i", words=f"array({name})")),
            (f"NOT {J.is_string('m.content')}", _fault("content_not_string", "i", J.kind("m.content"))),
        ]
    )
    opened = (
        f"transform({J.at('.messages', 'array<variant>')}, m -> named_struct('self', m, "
        "'role', try_variant_get(m, '$.role', 'variant'), "
        "'content', try_variant_get(m, '$.content', 'variant')))"
    )
    return f"transform({opened}, (m, i) -> {fault})"


def _chat(parsed: DataFrame, kept: list[str]) -> DataFrame:
    staged = parsed.withColumn(MESSAGES_COLUMN, F.expr(J.at(".messages", CHAT_RECORD)))
    # The usual good record is recognised by its shape. The shape merges all
    # messages, so an absent or null member shows as NULL in the typed copy.
    roles = ", ".join(sql_text(r) for r in ROLES)
    good = (
        f"{J.is_strict()} AND schema_of_variant({J.at()}) = '{CHAT_SHAPE}' AND size({MESSAGES_COLUMN}) > 0 "
        f"AND coalesce(forall({MESSAGES_COLUMN}, m -> m.role IN ({roles}) AND m.content IS NOT NULL), false)"
    )
    messages = J.at(".messages")
    fault = _case(
        [(good, "NULL")]
        + _top_faults(CHAT_KEYS)
        + [
            (f"{messages} IS NULL", _fault("missing_messages")),
            (f"{J.kind(messages)} <> 'ARRAY'", _fault("messages_not_list", kind=J.kind(messages))),
            (f"size({J.at('.messages', 'array<variant>')}) = 0", _fault("messages_empty")),
        ],
        f"get(filter({_message_faults()}, f -> f IS NOT NULL), 0)",
    )
    record = f"named_struct('messages', {MESSAGES_COLUMN})"
    return _close(J.settled(staged, FAULT, F.expr(fault)), "chat", record, kept)


def _task(parsed: DataFrame, kept: list[str]) -> DataFrame:
    good = f"{J.is_strict()} AND schema_of_variant({J.at()}) = '{TASK_SHAPE}'"
    branches = [(good, "NULL")] + _top_faults(TASK_KEYS)
    members = []
    for key in TASK_KEYS:
        value = J.at(f".{key}")
        branches.append((f"{value} IS NULL", _fault(f"missing_key:{key}")))
        branches.append(
            (f"NOT {J.is_string(value)}", _fault(f"key_not_string:{key}", kind=J.kind(value)))
        )
        members.append(f"'{key}', {J.at(f'.{key}', 'string')}")
    record = f"named_struct({', '.join(members)})"
    return _close(J.settled(parsed, FAULT, F.expr(_case(branches))), "task", record, kept)


def _close(judged: DataFrame, schema: str, record: str, kept: list[str]) -> DataFrame:
    """Turn the violation into rule, message and hint columns."""
    base = f"split_part({FAULT}.rule, ':', 1)"
    words = f"array_join(transform({FAULT}.words, w -> {sql_quoted('w')}), ', ')"
    listed = f"if({FAULT}.rule = 'unexpected_keys', concat('[', {words}, ']'), {words})"
    got = f"coalesce({J.type_name(f'{FAULT}.kind')}, {listed}, '')"
    texts = {rule: text.replace("{schema}", schema) for rule, text in MESSAGES.items()}
    message = f"replace({sql_lookup(base, texts)}, '{{key}}', split_part({FAULT}.rule, ':', 2))"
    message = f"replace({message}, '{{at}}', coalesce(CAST({FAULT}.at AS STRING), ''))"
    message = f"replace({message}, '{{got}}', {got})"
    if "line_no" in kept:
        message = f"concat('line ', CAST(line_no AS STRING), ': ', {message})"
    return judged.selectExpr(
        *[f"`{c}`" for c in kept],
        f"{FAULT}.rule AS rule",
        f"{message} AS message",
        f"{sql_lookup(base, HINTS)} AS remediation",
        f"if({FAULT}.rule IS NULL, {record}, NULL) AS record",
    )


def require_schema(schema: str) -> str:
    if schema not in SCHEMAS:
        raise CorpusError(
            USER_ERROR,
            f"unknown schema {schema!r}; must be one of {sorted(SCHEMAS)}",
            'Pass "chat" or "task".',
        )
    return schema


def validate(
    lines: DataFrame, schema: str, column: str = "value", keep_blank: bool = False
) -> DataFrame:
    """Judge every non-blank line: adds ``rule``, ``message``, ``remediation``
    (NULL when valid) and ``record`` (NULL when not).

    Blank lines are dropped, the others keep their line numbers. ``keep_blank``
    keeps them under the rule ``blank``. All columns of ``lines`` stay; one that is
    named like an added one is an error.
    """
    require_schema(schema)
    prepare(lines.sparkSession)
    J.require_free(lines, ADDED + (["value"] if column != "value" else []))
    source = lines if column == "value" else lines.withColumnRenamed(column, "value")
    parsed, judge = J.parse_json(source), _chat if schema == "chat" else _task
    judged = judge(parsed, source.columns)
    if keep_blank:
        return judged
    return judged.filter(F.col("rule").isNull() | (F.col("rule") != BLANK))


def valid_records(validated: DataFrame) -> DataFrame:
    """The accepted rows with the record's fields as columns."""
    keep = [c for c in validated.columns if c not in ("value", *ADDED)]
    J.require_free(validated.select(*keep), validated.schema["record"].dataType.names)
    return validated.filter(F.col("rule").isNull()).select(*keep, "record.*")


def first_violation(validated: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First bad row per group: the one a fail-fast reader would report.

    Only violations reach the aggregate, and ``min_by`` merges.
    """
    at = F.struct(*order)
    first = F.min_by(F.struct(*order, "rule", "message", "remediation"), at)
    return (
        validated.filter(F.col("rule").isNotNull())
        .groupBy(*by)
        .agg(first.alias("first"))
        .select(*by, "first.*")
    )


def summarise(validated: DataFrame, by: list[str], position: str | None = None) -> DataFrame:
    """Records, valid records and (given a position column) the first bad one."""
    bad = F.col("rule").isNotNull()
    aggs = [
        F.count("*").alias("records"),
        F.count_if(~bad).alias("valid"),
        F.count_if(bad).alias("invalid"),
    ]
    if position is not None:
        aggs.append(F.min(F.when(bad, F.col(position))).alias(f"first_bad_{position}"))
    return validated.groupBy(*by).agg(*aggs)


def rule_counts(validated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of rows per rule; valid rows count under ``valid``."""
    rule = F.coalesce("rule", F.lit("valid")).alias("rule")
    return validated.groupBy(*(by or []), rule).agg(F.count("*").alias("n"))


def require_valid(validated: DataFrame, order: list[str]) -> None:
    """Raise on the first violation, or when there is no record at all.

    The gate stops at the first bad row it meets; only then is the first one in
    file order looked up.
    """
    bad = validated.filter(F.col("rule").isNotNull())
    if bad.select("rule").take(1):
        worst = bad.orderBy(*order).select("rule", "message", "remediation").first()
        raise CorpusError(USER_ERROR, worst["message"], worst["remediation"])
    if not validated.select("rule").take(1):
        raise CorpusError(
            USER_ERROR,
            "the corpus contains no records (empty or blank-only)",
            "Write at least one JSON record.",
        )
