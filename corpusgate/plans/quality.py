"""Column checks, settings checks and fingerprints over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.operators.checks import (
    check_columns,
    healthy,
    in_range,
    int_min,
    is_type,
    one_of,
    required,
    with_defaults,
)
from corpusgate.operators.fingerprint import manifest, run_groups as groups
from corpusgate.operators.fingerprint import manifest_drift as drift
from corpusgate.operators.fingerprint import table_digest
from corpusgate.operators.settings import check_settings
from corpusgate.plans.chat import sql_hash
from corpusgate.plans.tables import table


def _sql_report(table_name: str, checks: list[tuple[str, str, str, str, str]]) -> str:
    """The check report in SQL: (id, condition, severity, message, remediation)."""
    counts = ", ".join(f"count(*) FILTER ({c[1]}) AS c{i}" for i, c in enumerate(checks))
    rows = " UNION ALL ".join(
        f"SELECT '{c[0]}' AS id, c{i} = 0 AS passed, c{i} AS bad_rows, '{c[2]}' AS severity, "
        f"'{c[3]}' AS message, CASE WHEN c{i} > 0 THEN '{c[4]}' ELSE '' END AS remediation FROM n"
        for i, c in enumerate(checks)
    )
    return f"WITH n AS (SELECT {counts} FROM {table_name}) {rows}"


def _lineitem_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return check_columns(
        items,
        [
            required("l_orderkey"),
            int_min("l_linenumber", 1),
            in_range("l_quantity", 1, None),
            in_range("l_discount", 0.0, 1.0),
            in_range("l_tax", 0.0, 0.05, severity="warning"),
            one_of("l_returnflag", ["a", "n", "r"], fold=True),
            one_of("l_linestatus", ["O"], severity="info"),
            is_type(items, "l_linenumber", "int"),
        ],
    )


def column_checks_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, ranges and closed sets over every line item."""
    return _lineitem_report(spark, sf_dir)


COLUMN_CHECKS_LINEITEM = _sql_report(
    "lineitem",
    [
        ("l_orderkey:required", "l_orderkey IS NULL", "error", "l_orderkey must be present", "Fill l_orderkey."),
        ("l_linenumber:int_min", "l_linenumber < 1", "error", "l_linenumber must be >= 1", "Set l_linenumber to an integer >= 1."),
        ("l_quantity:in_range", "l_quantity < 1", "error", "l_quantity must be at least 1", "Make l_quantity at least 1."),
        ("l_discount:in_range", "l_discount < 0 OR l_discount > 1", "error", "l_discount must be at least 0.0 and at most 1.0", "Make l_discount at least 0.0 and at most 1.0."),
        ("l_tax:in_range", "l_tax < 0 OR l_tax > 0.05", "warning", "l_tax must be at least 0.0 and at most 0.05", "Make l_tax at least 0.0 and at most 0.05."),
        ("l_returnflag:one_of", "lower(l_returnflag) NOT IN ('a', 'n', 'r')", "error", "l_returnflag must be one of a, n, r", "Use one of a, n, r."),
        ("l_linestatus:one_of", "l_linestatus <> 'O'", "info", "l_linestatus must be one of O", "Use one of O."),
        ("l_linenumber:type", "false", "error", "l_linenumber must be of type int, is int", "Cast l_linenumber to int."),
    ],
)


def health_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every line item check passed."""
    return healthy(_lineitem_report(spark, sf_dir))


HEALTH_LINEITEM = f"""
SELECT bool_and(passed) AS healthy, count(*) FILTER (NOT passed) AS failed
FROM ({COLUMN_CHECKS_LINEITEM})
"""


def column_checks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over orders, with an absent priority defaulted first."""
    orders = with_defaults(table(spark, sf_dir, "orders"), {"o_orderpriority": "5-LOW"})
    return check_columns(
        orders,
        [
            required("o_orderkey"),
            required("o_orderpriority"),
            int_min("o_custkey", 0),
            in_range("o_totalprice", 0.0, 400000.0),
            one_of("o_orderstatus", ["F", "O"]),
        ],
    )


COLUMN_CHECKS_ORDERS = _sql_report(
    "orders",
    [
        ("o_orderkey:required", "o_orderkey IS NULL", "error", "o_orderkey must be present", "Fill o_orderkey."),
        ("o_orderpriority:required", "false", "error", "o_orderpriority must be present", "Fill o_orderpriority."),
        ("o_custkey:int_min", "o_custkey < 0", "error", "o_custkey must be >= 0", "Set o_custkey to an integer >= 0."),
        ("o_totalprice:in_range", "o_totalprice < 0 OR o_totalprice > 400000", "error", "o_totalprice must be at least 0.0 and at most 400000.0", "Make o_totalprice at least 0.0 and at most 400000.0."),
        ("o_orderstatus:one_of", "o_orderstatus NOT IN ('F', 'O')", "error", "o_orderstatus must be one of F, O", "Use one of F, O."),
    ],
)


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of one run per event, checked and completed with defaults."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    run = F.to_json(
        F.struct(
            F.lit("base-8b").alias("model"),
            F.concat(F.lit("corpus-"), F.col("user_id").cast("string")).alias("dataset"),
            F.when(kind != "error", "out").alias("output"),
            F.when(kind == "signup", "full").when(kind != "purchase", "lora").alias("method"),
        )
    )
    extra = F.when(kind == "click", ',"load_in_4bit":"yes"').otherwise("")
    settings = F.concat(
        F.lit('{"run":'),
        run,
        F.lit(',"hyperparameters":{"lora_r":'),
        k,
        F.lit(',"lora_dropout":'),
        (F.col("value") / 100).cast("string"),
        extra,
        F.lit("}}"),
    )
    judged = check_settings(table(spark, sf_dir, "events").select("event_id", settings.alias("settings")))
    return judged.select(
        "event_id",
        "rule",
        "resolved.dataset",
        "resolved.method",
        "resolved.lora_r",
        "resolved.lora_alpha",
        "resolved.lora_dropout",
        "resolved.max_steps",
        "resolved.load_in_4bit",
    )


RUN_SETTINGS = """
WITH e AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events
), j AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'output:required'
    WHEN event_type = 'signup' THEN 'method:one_of' WHEN k < 1 THEN 'lora_r:range'
    WHEN value / 100 < 0 OR value / 100 > 1 THEN 'lora_dropout:range'
    WHEN event_type = 'click' THEN 'load_in_4bit:type' END AS rule FROM e
)
SELECT event_id, rule,
  CASE WHEN rule IS NULL THEN 'corpus-' || user_id END AS dataset,
  CASE WHEN rule IS NULL THEN CASE event_type WHEN 'purchase' THEN 'qlora' ELSE 'lora' END END AS method,
  CASE WHEN rule IS NULL THEN k END AS lora_r,
  CASE WHEN rule IS NULL THEN 16::BIGINT END AS lora_alpha,
  CASE WHEN rule IS NULL THEN value / 100 END AS lora_dropout,
  CASE WHEN rule IS NULL THEN 60::BIGINT END AS max_steps,
  CASE WHEN rule IS NULL THEN true END AS load_in_4bit FROM j
"""

_TURN_COLS = ["conv_id", "turn", "role", "text"]


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count and digest of the whole conversations table."""
    return table_digest(table(spark, sf_dir, "conversations"), _TURN_COLS)


TABLE_FINGERPRINT = f"""
SELECT count(*) AS n_rows,
       sum({sql_hash('conv_id::VARCHAR', 'turn::VARCHAR', 'role', 'text')})::VARCHAR AS digest
FROM conversations
"""


def shard_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest per source and language of the documents."""
    docs = table(spark, sf_dir, "documents")
    return table_digest(docs, ["doc_id", "text"], ["source", "lang"])


_DOC_HASH = sql_hash("doc_id::VARCHAR", "text")
SHARD_FINGERPRINTS = f"""
SELECT source, lang, count(*) AS n_rows, sum({_DOC_HASH})::VARCHAR AS digest
FROM documents GROUP BY source, lang
"""


def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shards change when toxic documents leave and benchmark items join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("source"), F.lit("en").alias("lang")
    )
    shard = ["source", "lang"]
    before = table_digest(docs, ["doc_id", "text"], shard)
    after = table_digest(docs.join(toxic, "doc_id", "left_anti").select(*items.columns).union(items), ["doc_id", "text"], shard)
    return drift(before, after, shard, "digest")


MANIFEST_DRIFT = f"""
WITH b AS (SELECT source, lang, sum({_DOC_HASH}) AS d FROM documents GROUP BY ALL),
a AS (SELECT source, lang, sum({_DOC_HASH}) AS d FROM (
  SELECT doc_id, text, source, lang FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT item_id, text, 'benchmark', 'en' FROM benchmark) GROUP BY ALL)
SELECT coalesce(b.source, a.source) AS source, coalesce(b.lang, a.lang) AS lang,
  CASE WHEN b.d IS NULL THEN 'added' WHEN a.d IS NULL THEN 'removed'
       WHEN a.d = b.d THEN 'same' ELSE 'changed' END AS status
FROM b FULL JOIN a ON a.source IS NOT DISTINCT FROM b.source AND a.lang IS NOT DISTINCT FROM b.lang
"""


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run record of a run trained on the conversations table."""
    record = manifest(
        table_digest(table(spark, sf_dir, "conversations"), _TURN_COLS),
        model="base-8b",
        method="qlora",
        hyperparameters=F.parse_json(F.lit('{"lora_r":16,"max_steps":60}')),
        timestamp="2024-01-01T00:00:00Z",
        sha256="digest",
        line_count="n_rows",
    )
    return record.select(
        "model",
        "method",
        F.col("dataset.sha256").alias("digest"),
        "dataset.line_count",
        F.to_json("hyperparameters").alias("hyperparameters"),
        "timestamp",
    )


CORPUS_MANIFEST = f"""
SELECT 'base-8b' AS model, 'qlora' AS method, digest, n_rows AS line_count,
       '{{"lora_r":16,"max_steps":60}}' AS hyperparameters,
       '2024-01-01T00:00:00.000000+00:00' AS timestamp FROM ({TABLE_FINGERPRINT})
"""


def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as run records, grouped by configuration and data."""
    runs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.when(F.col("value") < 10, "lora").otherwise("qlora").alias("method"),
        F.struct(F.sha2("props", 256).alias("sha256"), F.lit(1).cast("bigint").alias("line_count")).alias("dataset"),
        F.parse_json("props").alias("hyperparameters"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
    )
    return groups(runs)


RUN_GROUPS = """
SELECT event_type AS model, CASE WHEN value < 10 THEN 'lora' ELSE 'qlora' END AS method,
       sha256(props) AS sha256, replace(props, ' ', '') AS settings, count(*) AS runs,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_run,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_run
FROM events GROUP BY 1, 2, 3, 4
"""

QUERIES = {
    "column_checks_lineitem": (column_checks_lineitem, COLUMN_CHECKS_LINEITEM),
    "health_lineitem": (health_lineitem, HEALTH_LINEITEM),
    "column_checks_orders": (column_checks_orders, COLUMN_CHECKS_ORDERS),
    "run_settings": (run_settings, RUN_SETTINGS),
    "table_fingerprint": (table_fingerprint, TABLE_FINGERPRINT),
    "shard_fingerprints": (shard_fingerprints, SHARD_FINGERPRINTS),
    "manifest_drift": (manifest_drift, MANIFEST_DRIFT),
    "corpus_manifest": (corpus_manifest, CORPUS_MANIFEST),
    "run_groups": (run_groups, RUN_GROUPS),
}
