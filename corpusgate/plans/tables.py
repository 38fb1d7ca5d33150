"""Reading the driver's tables and deriving line corpora from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.session import prepare
from corpusgate.sources.turns import assemble_chat, chat_lines

NBSP = " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_string(col: Column) -> Column:
    """A string as a JSON literal, NULL as ``null``."""
    wrapped = F.to_json(F.struct(col.alias("v")))
    return F.coalesce(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6), F.lit("null"))


def by_class(selector: Column, cases: dict[int, Column], default: Column) -> Column:
    out = None
    for number, value in cases.items():
        test = selector == number
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def damaged_chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, part, n, value)``: every conversation as a JSON line, most of
    them damaged in one of fourteen ways, chosen by the conversation's number."""
    records = assemble_chat(table(spark, sf_dir, "conversations"))
    lines = chat_lines(records.withColumn("n", F.size("messages").cast("bigint")))
    value = F.col("value")
    body = F.substring(value, F.lit(1), F.length(value) - 2)

    def appended(message: str) -> Column:
        return F.concat(body, F.lit(f",{message}]}}"))

    cases = {
        0: F.substring(value, F.lit(1), F.length(value) - 1),
        1: F.concat(F.lit('{"extra":1,'), F.substring(value, F.lit(2), F.length(value))),
        2: F.lit("{}"),
        3: F.concat(F.lit('{"messages":'), json_string(value), F.lit("}")),
        4: F.lit('{"messages":[]}'),
        5: appended('{"role":"tool","content":"x"}'),
        6: appended('{"role":"user","content":7}'),
        7: appended('{"content":"x"}'),
        8: appended('{"role":"user"}'),
        9: F.concat(value, F.lit(" x")),
        10: appended('{"role":["user"],"content":"x"}'),
        11: appended("3"),
        12: appended('{"role":"user","content":null}'),
        13: F.concat(F.lit("["), value, F.lit("]")),
        14: F.concat(F.lit(f"{NBSP} "), value, F.lit(f"\t{NBSP}")),
    }
    return lines.withColumn("value", by_class(F.col("conv_id") % 16, cases, value))


def damaged_task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source, value)``: every document as a task line, most of them
    damaged in one of eight ways, chosen by the document's number."""
    docs = table(spark, sf_dir, "documents")
    task, text, expected = (json_string(F.col(c)) for c in ("lang", "text", "source"))

    def line(*members: tuple[str, Column]) -> Column:
        pieces = []
        for i, (key, literal) in enumerate(members):
            pieces += [F.lit(("," if i else "{") + f'"{key}":'), literal]
        return F.concat(*pieces, F.lit("}"))

    whole = line(("task", task), ("input", text), ("expected_output", expected))
    message = F.concat(F.lit('[{"role":"user","content":'), text, F.lit("}]"))
    cases = {
        0: line(("task", task), ("input", text)),
        1: line(("task", F.col("n_chars").cast("string")), ("input", text), ("expected_output", expected)),
        2: line(("bonus", F.lit("true")), ("task", task), ("input", text), ("expected_output", expected)),
        3: line(("messages", message)),
        4: F.substring(whole, F.lit(1), F.length(whole) - 1),
        5: line(("task", task), ("input", F.lit("null")), ("expected_output", expected)),
        6: line(("input", text), ("expected_output", expected)),
        7: F.concat(F.lit("["), whole, F.lit("]")),
        8: F.concat(F.lit(f" {NBSP}"), whole, F.lit("\t")),
    }
    return docs.select("doc_id", "source", by_class(F.col("doc_id") % 10, cases, whole).alias("value"))
