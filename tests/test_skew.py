"""One key holds most rows: results stay whole and group state stays bounded."""

from pyspark.sql import functions as F

import corpusgate as cg
from corpusgate.operators.fingerprint import table_digest


def hot_turns(spark, n=20_000):
    hot = spark.range(n).selectExpr("0L AS conv_id", "id AS turn")
    cold = spark.range(n // 2).selectExpr("1 + id div 4 AS conv_id", "id % 4 AS turn")
    return hot.union(cold).selectExpr(
        "*", "if(turn % 2 = 0, 'user', 'assistant') AS role", "concat('text ', conv_id, ' ', turn) AS text"
    )


def test_hot_conversation(spark):
    turns = hot_turns(spark).repartition(8)
    whole, parts = cg.assemble_chat(turns), cg.assemble_chat(turns, span=64)
    assert whole.filter("conv_id = 0").count() == 1 and parts.agg(F.max(F.size("messages"))).first()[0] <= 64
    for records in (whole, parts):
        assert records.agg(F.sum(F.size("messages"))).first()[0] == turns.count()
    assert cg.reply_tasks(turns).filter("conv_id = 0").count() == 10_000
    found = cg.members(turns, ["conv_id"], "role", ["user", "system"], []).filter("conv_id = 0").first()
    assert (found.missing, found.present) == (["system"], ["user"])


def test_hot_copies_merge_before_the_shuffle(spark):
    turn = spark.createDataFrame([(5, 0, "user", "same")], "conv_id long, turn long, role string, text string")
    copies = spark.range(50_000).selectExpr("5L AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    assert [len(r.messages) for r in cg.assemble_chat(copies).collect()] == [1]
    one = table_digest(turn, turn.columns).first()
    many = table_digest(copies, turn.columns).first()
    assert int(many.digest) == 50_000 * int(one.digest)


def test_hot_item_is_salted(spark):
    suite = spark.range(30_000).selectExpr(
        "if(id < 20000, 0L, id) AS item", "'t' AS task", "concat('in', id % 3) AS input", "'e' AS expected_output"
    )
    said = spark.range(25_000).selectExpr("if(id < 9000, 0L, id) AS item", "if(id % 2 = 0 OR id < 9000, 'e', 'f') AS prediction")
    plain, salted = (cg.score(suite, said, ["item"], salt=s) for s in (1, 16))
    assert cg.score_total(plain).first() == cg.score_total(salted).first()
    assert salted.count() == 30_000 and cg.score_total(salted).first().exact_match == 22_500
