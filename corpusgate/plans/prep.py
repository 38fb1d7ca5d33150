"""Queries on what goes into a training corpus: overlap with the evaluation suite, the
policy screen and the length budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.digest import hash_sum, row_hash
from corpusgate.functions.text import UNICODE_WHITESPACE
from corpusgate.operators.budget import length_budget as budget_of
from corpusgate.operators.budget import token_counter, tokenizer_file, words
from corpusgate.operators.fingerprint import exact_duplicates
from corpusgate.operators.overlap import shared_inputs, without_shared
from corpusgate.operators.screen import POLICY, policy_counts, screen
from corpusgate.plans.chat import sql_hash
from corpusgate.plans.tables import table

_SPACE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in UNICODE_WHITESPACE) + "]+"


def _clean(expr: str) -> str:
    return f"lower(regexp_replace(regexp_replace({expr}, '^{_SPACE}|{_SPACE}$', '', 'g'), '{_SPACE}', ' ', 'g'))"


def _lines(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the benchmark that also stand in a document."""
    suite, training = (_lines(spark, sf_dir, n, k) for n, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    return shared_inputs(suite, training, "line", "line").select("item_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


_LINES = """
{name}_lines AS (SELECT {key}, unnest(range(len(l))) AS line_no, unnest(l) AS line
                 FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {name}))
"""
_SUITE, _TRAINING = _LINES.format(name="benchmark", key="item_id"), _LINES.format(name="documents", key="doc_id")
_KNOWN = f"{_clean('line')} <> '' AND {_clean('line')}"

OVERLAP_SEMI = f"""
WITH {_SUITE}, {_TRAINING}
SELECT item_id, line_no, line FROM benchmark_lines
WHERE {_KNOWN} IN (SELECT {_clean('line')} FROM documents_lines WHERE line IS NOT NULL)
"""


def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, how many lines are no line of the benchmark, and their digest."""
    suite, training = (_lines(spark, sf_dir, n, k) for n, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    kept = without_shared(training, suite, "line", "line")
    return kept.groupBy("doc_id").agg(
        F.count("*").alias("n_kept"), hash_sum(row_hash([F.col("line_no"), F.col("line")])).alias("digest")
    )


OVERLAP_ANTI = f"""
WITH {_SUITE}, {_TRAINING}
SELECT doc_id, count(*) AS n_kept, sum({sql_hash('line_no::VARCHAR', 'line')})::VARCHAR AS digest
FROM documents_lines
WHERE NOT ({_KNOWN} IN (SELECT {_clean('line')} FROM benchmark_lines WHERE line IS NOT NULL))
GROUP BY doc_id
"""


def policy_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every rule in each document, as ``rule:start:length`` by place."""
    found = screen(table(spark, sf_dir, "documents"))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["length"].cast("string")))
    return found.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"), F.array_join(text, ";").alias("found"))


_SQL_TESTS = {
    "luhn": """len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN d[len(d) + 1 - i]::INT ELSE (d[len(d) + 1 - i]::INT * 2) // 10 + (d[len(d) + 1 - i]::INT * 2) % 10 END)) % 10 = 0""",
    "mod97": """list_reduce(list_concat([0], list_transform(string_split(substring(m, 5) || left(m, 4), ''), lambda c: CASE WHEN c <= '9' THEN c::INT ELSE ascii(c) - 55 END)),
        lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1""",
}
_SQL_ENTROPY = """coalesce(list_sum(list_transform(list_distinct(string_split(t, '')), lambda c:
    -(len(list_filter(string_split(t, ''), lambda x: x = c)) / len(t)) * log2(len(list_filter(string_split(t, ''), lambda x: x = c)) / len(t)))), 0)"""


def _rule_sql(number: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    tests = [_SQL_TESTS[rule.test]] if rule.test else []
    tests += [f"{_SQL_ENTROPY} >= {rule.entropy}"] if rule.entropy is not None else []
    return f"""
SELECT doc_id, {number} AS number, '{rule.name}' AS rule, start, length(m) AS n FROM (
  SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, regexp_extract(m, '[A-Za-z0-9+/=_-]*$') AS t,
    list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, found, parts, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS parts FROM documents)))
WHERE {' AND '.join(tests) or 'true'}"""


_SPANS_SQL = " UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(POLICY))

POLICY_SCREEN = f"""
WITH spans AS ({_SPANS_SQL})
SELECT d.doc_id, count(start) AS n_spans,
       coalesce(string_agg(rule || ':' || start::BIGINT || ':' || n, ';' ORDER BY start, number), '') AS found
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


def policy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, spans and characters that each rule finds in each source."""
    return policy_counts(screen(table(spark, sf_dir, "documents")), ["source"])


POLICY_BY_SOURCE = f"""
WITH spans AS ({_SPANS_SQL})
SELECT source, rule, count(DISTINCT doc_id) AS rows, count(*) AS spans, sum(n)::BIGINT AS chars
FROM spans JOIN documents USING (doc_id) GROUP BY source, rule
"""

BUDGET_WORDS = 512


def length_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per source and how many go beyond a budget of words."""
    docs = table(spark, sf_dir, "documents").withColumn("words", words(F.col("text")))
    return budget_of(docs, "words", ["source"], BUDGET_WORDS).drop("quantiles")


LENGTH_BUDGET = f"""
SELECT source, count(*) AS rows, sum(w)::BIGINT AS total, max(w)::BIGINT AS longest,
       count(*) FILTER (w > {BUDGET_WORDS}) AS over, sum(greatest(w - {BUDGET_WORDS}, 0))::BIGINT AS cut
FROM (SELECT source, len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) AS w FROM documents)
GROUP BY source
"""


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per source by a real tokenizer, how many rows go beyond the usual sequence
    length, and quantiles."""
    import public_tokenizers

    count = token_counter(tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))
    docs = table(spark, sf_dir, "documents").withColumn("tokens", count("text"))
    return budget_of(docs, "tokens", ["source"])


def exact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text and language that occur more than once."""
    return exact_duplicates(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id")


EXACT_RECORDS = """
SELECT sha256('s' || length(text) || ':' || text || 's' || length(lang) || ':' || lang) AS digest,
       count(*) AS copies, min(doc_id) AS first
FROM documents GROUP BY text, lang HAVING count(*) > 1
"""

QUERIES = {
    "exact_records": (exact_records, EXACT_RECORDS),
    "overlap_semi": (overlap_semi, OVERLAP_SEMI),
    "overlap_anti": (overlap_anti, OVERLAP_ANTI),
    "policy_screen": (policy_screen, POLICY_SCREEN),
    "policy_by_source": (policy_by_source, POLICY_BY_SOURCE),
    "length_budget": (length_budget, LENGTH_BUDGET),
    "token_budget": (token_budget, None),
}
