"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import corpusgate as cg
from corpusgate.plans import chat, logs, quality, tasks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_validation_is_one_projection(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("value"))
    for schema in ("chat", "task"):
        judged = cg.validate(lines, schema)
        for df in (judged, judged.filter("rule IS NULL"), judged.filter("rule IS NOT NULL").select("doc_id")):
            text = plan(df)
            assert "Exchange" not in text and "Python" not in text
        # Three parser calls belong to the exact test of lines that contain the
        # mark; a filter on the outcome must not add any.
        assert plan(judged.filter("rule IS NULL")).count("from_json(") == plan(judged).count("from_json(")


def test_unused_columns_are_not_read(spark):
    text = plan(tasks.validation_summary(spark, SF).select("source", "records"))
    assert "n_chars" in text  # feeds one kind of damage
    text = plan(chat.role_completeness(spark, SF))
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in text


def test_checks_are_one_aggregate(spark):
    text = plan(quality.column_checks_lineitem(spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "ReadSchema" in text and "l_extendedprice" not in text


def test_lookups_are_broadcast(spark):
    for query in (logs.scope_classes, logs.exit_classes):
        assert "BroadcastHashJoin" in plan(query(spark, SF))


def test_replies_take_one_scan_and_no_join(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    text = plan(cg.reply_tasks(turns))
    assert text.count("FileScan") == 1 and "Join" not in text and "Window" not in text


@pytest.mark.parametrize("query", [chat.chat_assemble_render, quality.table_fingerprint, quality.shard_fingerprints])
def test_digests_merge_before_the_shuffle(spark, query):
    text = plan(query(spark, SF))
    assert "partial_sum" in text and "Sort" not in text and "collect" not in text


def test_score_join_reuses_the_aggregate_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(tasks.score_items(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
