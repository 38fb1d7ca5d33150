"""Screening of training text by rules that are data: secrets, credentials, deployment
settings and personal data, found as spans and redacted by span.

All rules of a screen become one projection of built-in functions. A rule is a pattern,
written without look-around so that other regular expression engines read it alike, and
an optional test of what the pattern found: a checksum or the entropy of its characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.errors import USER_ERROR, CorpusError
from corpusgate.functions.text import sql_text

SPANS = "array<struct<rule:string,start:int,length:int>>"


@dataclass(frozen=True)
class Rule:
    """``hint`` is plain text, in lower case, that every match holds; it spares the pattern.
    ``test`` is one of ``TESTS`` or null. ``entropy`` is the least number of bits a
    character of the match's ``[A-Za-z0-9+/=_-]`` tail must carry."""

    name: str
    pattern: str
    hint: str | None = None
    test: str | None = None
    entropy: float | None = None


# Published shapes of keys, tokens and addresses.
POLICY = [
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key-----"),
    Rule("access_key", "(AKIA|ASIA)[0-9A-Z]{16}", "ia"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36}", "gh"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "eyj"),
    Rule("bearer", "[Bb]earer [A-Za-z0-9._~+/-]{20,}=*", "bearer "),
    Rule("assigned_secret", "(password|passwd|secret|token|api_key|apikey)[\"']? ?[:=] ?[\"']?[A-Za-z0-9+/=_-]{8,}", None, None, 3.0),
    Rule("url_login", "[a-z][a-z0-9+.-]*://[^\\s/:@]+:[^\\s/@]+@", "://"),
    Rule("host_port", "(localhost|[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}):[0-9]{2,5}", ":"),
    Rule("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "@"),
    Rule("card", "[0-9][0-9 -]{11,21}[0-9]", None, "luhn"),
    Rule("iban", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", None, "mod97"),
]

# What a match must pass besides its pattern, as SQL over the match ``m``.
TESTS = {
    "luhn": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(m, '[^0-9]', ''))",
    "mod97": (
        "aggregate(regexp_extract_all(concat(substring(m, 5), left(m, 4)), '.', 0), 0L, (a, c) -> "
        "if(c <= '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"
    ),
}


def entropy(text: str) -> str:
    """Bits a character of the SQL string ``text``; 0 for an empty one."""
    chars = f"regexp_extract_all({text}, '(?s).', 0)"
    share = f"size(filter({chars}, d -> d = c)) / size({chars})"
    return f"coalesce(aggregate(array_distinct({chars}), 0D, (a, c) -> a - {share} * log2({share})), 0D)"


def _passes(rule: Rule) -> str:
    tests = []
    if rule.test is not None:
        if rule.test not in TESTS:
            raise CorpusError(USER_ERROR, f"unknown test {rule.test!r} of rule {rule.name!r}", f"Use one of {sorted(TESTS)}.")
        tests.append(TESTS[rule.test])
    if rule.entropy is not None:
        tail = "regexp_extract(m, '[A-Za-z0-9+/=_-]*$', 0)"
        tests.append(f"{entropy(tail)} >= {float(rule.entropy)}D")
    return " AND ".join(tests) or "true"


def _spans_of(rule: Rule, column: str) -> str:
    """Spans of one rule. Splitting at a pattern leaves the text between its matches, so
    the lengths of both give the places."""
    pattern = sql_text(rule.pattern)
    start = "a.at + length(get(p.between, a.i))"
    span = f"named_struct('rule', {sql_text(rule.name)}, 'start', {start}, 'length', length(m))"
    step = (
        f"named_struct('at', {start} + length(m), 'i', a.i + 1, "
        f"'out', if({_passes(rule)}, concat(a.out, array({span})), a.out))"
    )
    zero = f"named_struct('at', 0, 'i', 0, 'out', CAST(array() AS {SPANS}))"
    parts = f"named_struct('found', regexp_extract_all({column}, {pattern}, 0), 'between', split({column}, {pattern}, -1))"
    walked = f"aggregate(p.found, {zero}, (a, m) -> {step}, a -> a.out)"
    once = f"get(transform(array({parts}), p -> {walked}), 0)"  # the parts are made once
    tests = [f"{column} RLIKE {pattern}"]
    if rule.hint is not None:
        tests.insert(0, f"contains(lower({column}), {sql_text(rule.hint)})")
    return f"if({' AND '.join(tests)}, {once}, CAST(array() AS {SPANS}))"


def spans(column: str, rules: list[Rule] = POLICY) -> Column:
    """All spans of all rules in a text column, ``(rule, start, length)`` in characters from
    0, by start, then in the order of the rules. Matches of one rule do not overlap, those
    of several may. A null or empty text has none."""
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise CorpusError(USER_ERROR, "two rules have one name", "Name each rule of a screen differently.")
    if not rules:
        return F.expr(f"CAST(array() AS {SPANS})")
    quoted = f"`{column}`"
    every = f"flatten(array({', '.join(_spans_of(r, quoted) for r in rules)}))"
    order = f"array({', '.join(sql_text(n) for n in names)})"
    rank = {v: f"int(array_position({order}, {v}.rule))" for v in "xy"}
    later = f"if(x.start <> y.start, x.start - y.start, {rank['x']} - {rank['y']})"
    return F.expr(f"coalesce(array_sort({every}, (x, y) -> {later}), CAST(array() AS {SPANS}))")


def screen(rows: DataFrame, column: str = "text", rules: list[Rule] = POLICY, into: str = "spans") -> DataFrame:
    """``rows`` with their spans; one projection, no shuffle and no Python."""
    return rows.withColumn(into, spans(column, rules))


def redacted(column: str, spans_column: str = "spans") -> Column:
    """The text with each span replaced by its rule's name in brackets; of spans that
    overlap, all that they cover goes, under the name of the first."""
    text, held = f"`{column}`", f"`{spans_column}`"
    inside = "s.start < a.at"
    ends = "greatest(a.at, s.start + s.length)"
    out = f"if({inside}, a.out, concat(a.out, substring({text}, a.at + 1, s.start - a.at), '[', s.rule, ']'))"
    return F.expr(
        f"aggregate({held}, named_struct('at', 0, 'out', CAST('' AS STRING)), (a, s) -> named_struct('at', {ends}, 'out', {out}), "
        f"a -> concat(a.out, substring({text}, a.at + 1)))"
    )


def policy_counts(screened: DataFrame, by: list[str] | None = None, spans_column: str = "spans") -> DataFrame:
    """``(by, rule, rows, spans, chars)``: how many rows a rule finds something in, how
    many spans, and how many characters under them."""
    each = screened.select(*(by or []), F.explode(F.array_distinct(F.col(f"{spans_column}.rule"))).alias("rule"), spans_column)
    mine = F.filter(spans_column, lambda s: s["rule"] == F.col("rule"))
    chars = F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, s: a + s["length"])
    return (
        each.withColumn("n", F.size(mine)).withColumn("c", chars)
        .groupBy(*(by or []), "rule")
        .agg(F.count("*").alias("rows"), F.sum("n").alias("spans"), F.sum("c").alias("chars"))
    )
