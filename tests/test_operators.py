import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpusgate as cg
from corpusgate.functions.text import UNICODE_WHITESPACE, contains_any, is_blank, label, strip, strip_ascii
from corpusgate.operators.classify import with_scope
from corpusgate.operators.settings import HYPERPARAMETERS, check_settings
from corpusgate.sinks.files import (
    read_accepted,
    read_rejected,
    result_json,
    write_chat_lines,
    write_judged,
    write_results,
    write_text_column,
)
from test_skew import hot_turns


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").orderBy("i")


def test_strip_equals_python(spark):
    assert sorted(UNICODE_WHITESPACE) == [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = [f"{a}{mid}{a}" for a in list(UNICODE_WHITESPACE) + ["​", "﻿", "\x00"] for mid in ("", "x y", "é")]
    rows = column(spark, texts).select(
        strip(F.col("c")), is_blank(F.col("c")), strip_ascii(F.col("c"))
    ).collect()
    assert [tuple(r) for r in rows] == [
        (t.strip(), not t.strip(), t.strip("\t\n\x0b\x0c\r ")) for t in texts
    ]


def test_labels_and_substrings(spark):
    df = column(spark, [" LoRA\n", "x", None])
    assert [r[0] for r in df.select(label(F.col("c"))).collect()] == ["lora", "x", None]
    assert [r[0] for r in df.select(contains_any(F.col("c"), ["Ora"])).collect()] == [True, False, False]


def test_rendering(spark):
    task = spark.createDataFrame([("t", "i", "e")], "task string, input string, expected_output string")
    assert cg.render_task(task).first().text == "Task: t\nInput: i\nOutput: e"
    assert cg.render_task(task, "</s>").first().text == "Task: t\nInput: i\nOutput: e</s>"
    assert cg.prompts(task).first().prompt == "Task: t\nInput: i\nOutput:"
    turns = spark.createDataFrame(
        [(1, 1, "user", "hi"), (1, 0, "system", "be\nkind"), (1, 2, "assistant", "")],
        "conv_id long, turn long, role string, text string",
    )
    golden = (
        "<|im_start|>system\nbe\nkind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n"
    )
    records = cg.assemble_chat(turns)
    assert cg.render_chat(records).first().text == golden
    segments = cg.render_turns(turns).orderBy("turn").collect()
    assert "".join(r.segment for r in segments) == golden
    own = cg.ChatTemplate({"user": "U:", "assistant": "A:", "system": "S:"}, {"user": ";", "assistant": ".", "system": "!"})
    assert cg.render_chat(records, own).first().text == "S:be\nkind!U:hi;A:."
    assert [tuple(r) for r in cg.explode_messages(records).orderBy("at").collect()] == [
        (1, 0, 0, "system", "be\nkind"), (1, 0, 1, "user", "hi"), (1, 0, 2, "assistant", "")
    ]


def test_long_conversation_is_kept_whole_in_bounded_parts(spark):
    n = 5000
    turns = spark.range(n).selectExpr(
        "7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text"
    )
    copies = turns.union(turns.filter("turn < 10")).repartition(8)
    parts = cg.assemble_chat(copies, span=64)
    assert parts.agg(F.max(F.size("messages"))).first()[0] == 64
    rows = parts.orderBy("part").collect()
    assert [m.content for r in rows for m in r.messages] == [f"t{i}" for i in range(n)]
    assert cg.reply_tasks(turns).count() == n // 2


def test_reply_tasks(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "q2"),
         (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (2, 0, "assistant", "x"), (2, 1, "user", "y")],
        "conv_id long, turn long, role string, text string",
    )
    rows = cg.reply_tasks(turns).orderBy("conv_id", "turn").collect()
    assert [(r.turn, r.input, r.expected_output) for r in rows] == [(1, "q", "a"), (4, "q3", "a3")]


def test_contested_positions_give_every_pair(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 0, "user", "r"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"),
         (1, 1, "assistant", "b"), (2, 0, "user", None), (2, 1, "assistant", "c"), (None, 0, "user", "x"),
         (None, 1, "assistant", "y"), (3, None, "user", "x"), (3, None, "assistant", "y")],
        "conv_id long, turn long, role string, text string",
    )
    pairs = turns.alias("u").join(turns.alias("a"), F.expr("a.conv_id = u.conv_id AND a.turn = u.turn + 1"))
    pairs = pairs.filter("u.role = 'user' AND a.role = 'assistant'").selectExpr("u.conv_id", "u.turn", "u.text", "a.text")
    want = sorted(map(str, pairs.collect()))
    assert len(want) == 7
    for salt in (1, 3):
        rows = cg.reply_tasks(turns, salt).selectExpr("conv_id", "turn", "input AS text", "expected_output AS text")
        assert sorted(map(str, rows.collect())) == want


def scored(spark, pairs):
    suite = spark.createDataFrame(
        [(i, p[0], "in", p[1]) for i, p in enumerate(pairs)], "index int, task string, input string, expected_output string"
    )
    said = [(i, text) for i, p in enumerate(pairs) for text in p[2]]
    return cg.score(suite, spark.createDataFrame(said, "index int, prediction string"), ["index"])


def test_scoring(spark):
    result = scored(spark, [
        ("a", "x", ["x"]), ("a", "x", ["\xa0x\n"]), ("a", "x", ["X"]), ("b", "", []), ("b", "y", ["y", "y"]), ("b", "", [" "]),
    ])
    rows = result.orderBy("index").collect()
    assert [r.exact_match for r in rows] == [True, True, False, False, True, True]
    assert [r.n_predictions for r in rows] == [1, 1, 1, None, 2, 1]
    assert tuple(cg.score_total(result).first()) == (6, 4, 66.67)
    by = {r.task: (r.total, r.exact_match, r.exact_match_pct) for r in cg.score_by(result).collect()}
    assert by == {"a": (3, 2, 66.67), "b": (3, 2, 66.67), None: (6, 4, 66.67)}
    assert tuple(cg.score_total(result.filter("index > 99")).first()) == (0, 0, 0.0)


@pytest.mark.parametrize("exact,total", [(1, 32), (1, 3), (2, 3), (7, 7), (0, 5), (3, 32), (37, 41)])
def test_percent_is_rounded_as_python_does(spark, exact, total):
    df = spark.range(total).select((F.col("id") < exact).alias("exact_match"))
    assert cg.score_total(df).first().exact_match_pct == round(exact / total * 100, 2)


def test_predictor_and_echo(spark):
    suite = spark.createDataFrame(
        [(i, "t", "i", e) for i, e in enumerate(["ans", "other"])], "index int, task string, input string, expected_output string"
    )

    def load():
        return lambda prompts: prompts + " ans"

    said = cg.predict(cg.prompts(suite), load)
    assert [r.exact_match for r in cg.score_predicted(said).orderBy("index").collect()] == [False, False]
    kept = cg.score_predicted(said, skip_echo=True).orderBy("index").collect()
    assert [r.exact_match for r in kept] == [True, False]


def test_column_checks(spark):
    df = spark.createDataFrame(
        [(1, 0.5, "A", "x"), (0, 1.5, "b", None), (None, float("nan"), None, "z")],
        "n int, f double, s string, t string",
    )
    report = cg.check_columns(df, [
        cg.required("n"), cg.required("f"), cg.int_min("n", 1), cg.in_range("f", 0.0, 1.0),
        cg.in_range("f", 0.0, allow_nan=True), cg.one_of("s", ["A"]), cg.one_of("s", ["a", "b"], "warning", fold=True),
        cg.is_type(df, "n", "int"), cg.is_type(df, "n", "string"),
    ])
    rows = report.collect()
    assert [(r.id, r.bad_rows) for r in rows] == [
        ("n:required", 1), ("f:required", 0), ("n:int_min", 1), ("f:in_range", 2), ("f:in_range", 0),
        ("s:one_of", 1), ("s:one_of", 0), ("n:type", 0), ("n:type", 3),
    ]
    assert all(r.passed == (r.bad_rows == 0) == (r.remediation == "") for r in rows)
    assert rows[6].severity == "warning"
    assert tuple(cg.healthy(report).first()) == (False, 5)
    assert tuple(cg.healthy(report.filter("passed")).first()) == (True, 0)
    filled = cg.with_defaults(df, {"t": "d", "n": 9}).select("n", "t").collect()
    assert [tuple(r) for r in filled] == [(1, "x"), (0, "d"), (9, "z")]


RUN = {"model": "m", "dataset": "d", "output": "o"}
SETTINGS = [
    ({"run": RUN}, None, None),
    ({"run": {**RUN, "method": "lora"}, "hyperparameters": {"lora_r": 8, "lora_dropout": 1}}, None, None),
    ({"run": {"model": "m", "output": "o"}}, "dataset:required", "missing required key 'dataset'"),
    ({}, "model:required", "missing required key 'model'"),
    ({"run": {**RUN, "method": "LoRA"}}, "method:one_of", 'invalid method "LoRA"'),
    ({"run": {**RUN, "method": None}}, "method:one_of", "invalid method null"),
    ({"run": RUN, "hyperparameters": {"lora_r": "8"}}, "lora_r:type", "lora_r must be an integer, got str"),
    ({"run": RUN, "hyperparameters": {"lora_r": True}}, "lora_r:type", "lora_r must be an integer, got bool"),
    ({"run": RUN, "hyperparameters": {"lora_r": 8.0}}, "lora_r:type", "lora_r must be an integer, got float"),
    ({"run": RUN, "hyperparameters": {"lora_r": 0}}, "lora_r:range", "lora_r must be >= 1, got 0"),
    ({"run": RUN, "hyperparameters": {"seed": -1}}, "seed:range", "seed must be >= 0, got -1"),
    ({"run": RUN, "hyperparameters": {"seed": 0, "lora_dropout": 1.5}}, "lora_dropout:range", "lora_dropout must be in [0.0, 1.0], got 1.5"),
    ({"run": RUN, "hyperparameters": {"learning_rate": -0.5}}, "learning_rate:range", "learning_rate must be in >= 0.0, got -0.5"),
    ({"run": RUN, "hyperparameters": {"learning_rate": False}}, "learning_rate:type", "learning_rate must be a number, got bool"),
    ({"run": RUN, "hyperparameters": {"learning_rate": math.inf, "lora_dropout": math.nan}}, None, None),
    ({"run": RUN, "hyperparameters": {"load_in_4bit": 1}}, "load_in_4bit:type", "load_in_4bit must be a boolean, got int"),
    ({"run": RUN, "hyperparameters": {"lora_alpha": None}}, "lora_alpha:type", "lora_alpha must be an integer, got NoneType"),
    ({"run": RUN, "hyperparameters": {"batch_size": 0, "lora_r": "x"}}, "lora_r:type", "lora_r must be an integer, got str"),
]


def test_settings(spark):
    df = column(spark, [json.dumps(s[0]) for s in SETTINGS])
    rows = check_settings(df, "c").orderBy("i").collect()
    assert [(r.rule, r.message) for r in rows] == [s[1:] for s in SETTINGS]
    assert rows[0].resolved.asDict() == {**RUN, "method": "qlora", **{h[0]: h[2] for h in HYPERPARAMETERS}}
    assert (rows[1].resolved.method, rows[1].resolved.lora_r, rows[1].resolved.lora_dropout) == ("lora", 8, 1.0)


def test_scope(spark):
    methods = ["lora", "QLoRA ", "full", "FULL-FT", "full_ft", "fullft", "prefix", ""]
    df = column(spark, methods).withColumn("m", F.lit("base"))
    rows = cg.with_scope(df, "m", "c").orderBy("i").collect()
    assert [r.scope_class for r in rows] == ["adapter"] * 2 + ["full_tuning"] * 4 + ["unsupported"] * 2
    assert all(r.ok != r.out_of_scope and (r.warning is None) == r.ok for r in rows)
    assert [r.downgrade_to for r in rows] == [None] * 2 + ["lora"] * 6


SIZES = {
    "org/Base3-4B": 4.0, "base-27b": 27.0, "mix-57b-a14b": 57.0, "base-0.5B": 0.5, "base": None, "base-7bx": None,
    "v1.7b": None, "12.5.7b": 7.0, "base3b": None, "7b_x": None, "7b": 7.0, "3.b": None, "1.5b": 1.5, "7é-8b": 8.0,
    "10b": 10.0, "10.1b": 10.1, "8bé": None, "": None,
}


def test_model_size(spark):
    rows = cg.with_model_size(column(spark, list(SIZES)), "c").orderBy("i").collect()
    assert {r.c: r.params_b for r in rows} == SIZES
    assert {r.c for r in rows if r.large} == {"base-27b", "mix-57b-a14b", "10.1b"}


def test_exit_and_memory_classes(spark):
    rows = cg.with_exit_class(column(spark, [0, 1, 2, 137, 125, None], "int"), "c").orderBy("i").collect()
    assert [r.exit_class for r in rows] == ["ok", "user", "environment", "out_of_memory", "infrastructure", "infrastructure"]
    errors = spark.createDataFrame(
        [("OutOfMemoryError", "x"), ("torch.AcceleratorError", None), ("RuntimeError", "CUDA error: Out of Memory"),
         ("RuntimeError", "no"), (None, None)], "n string, m string")
    assert [r[0] for r in errors.select(cg.is_oom(F.col("n"), F.col("m"))).collect()] == [True, True, True, False, False]


def test_members(spark):
    from corpusgate.operators.completeness import ADAPTER_OPTIONAL, ADAPTER_REQUIRED
    listing = {
        "full": ["tokenizer.json", "adapter_model.safetensors", "adapter_config.json", "vocab.json", "README"],
        "half": ["adapter_config.json"], "none": ["README"],
    }
    df = spark.createDataFrame([(d, f) for d, fs in listing.items() for f in fs], "d string, f string")
    rows = {r.d: (r.missing, r.present) for r in cg.members(df, ["d"], "f", ADAPTER_REQUIRED, ADAPTER_OPTIONAL).collect()}
    assert rows == {
        "full": ([], ADAPTER_REQUIRED + ["tokenizer.json", "vocab.json"]),
        "half": (["adapter_model.safetensors"], ["adapter_config.json"]),
        "none": (ADAPTER_REQUIRED, []),
    }


def test_sinks(spark, tmp_path):
    lines = column(spark, ['{"messages":[{"role":"user","content":"é"}]}', "bad", "", "{}"]).withColumnRenamed("c", "value")
    write_judged(cg.validate(lines, "chat"), str(tmp_path / "judged"))
    accepted = read_accepted(spark, str(tmp_path / "judged"))
    rejected = read_rejected(spark, str(tmp_path / "judged"))
    assert [(r.i, r.record.messages[0].content) for r in accepted.collect()] == [(0, "é")]
    assert sorted((r.i, r.value, r.rule) for r in rejected.collect()) == [(1, "bad", "invalid_json"), (3, "{}", "missing_messages")]
    text = cg.render_chat(accepted.select("record.*"))
    write_text_column(text, str(tmp_path / "text"))
    assert spark.read.parquet(str(tmp_path / "text")).columns == ["text"]
    result = scored(spark, [("a", "é\"", ["x"]), ("a", "y", [])])
    write_results(result, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2
    values = result_json(result.orderBy("index"), ["expected_output", "prediction", "exact_match"])
    assert [r.value for r in values.collect()] == [
        '{"expected_output":"é\\"","prediction":"x","exact_match":false}',
        '{"expected_output":"y","prediction":null,"exact_match":false}',
    ]


def test_long_conversation_is_one_record(spark):
    turns = spark.range(300).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    row = cg.assemble_chat(turns).collect()
    assert len(row) == 1 and [m.content for m in row[0].messages] == [f"t{i}" for i in range(300)]


def test_drift_matches_null_keys(spark):
    rows = spark.createDataFrame([(None, "x"), ("a", "y")], "k string, d string")
    assert {(r.k, r.status) for r in cg.manifest_drift(rows, rows, ["k"], "d").collect()} == {(None, "same"), ("a", "same")}


def test_scope_of_a_missing_method(spark):
    rows = spark.createDataFrame([(None, None), ("m", None)], "model string, method string")
    got = with_scope(rows, "model", "method").collect()
    assert all(r.scope_class == "unsupported" and not r.ok for r in got)
    assert all(r.warning == "method '' is not supported; use lora or qlora" for r in got)
    assert sum("model 'm' with method ''" in (r.scope_message or "") for r in got) == 1


def test_bounds_are_exact_and_may_be_open(spark):
    df = spark.createDataFrame([(2**53 + 1, 1.5), (2**53, float("inf"))], "n bigint, f double")
    checks = [cg.in_range("n", maximum=2**53), cg.in_range("f", maximum=1.5), cg.in_range("f", 1.5, float("inf")), cg.in_range("f")]
    rows = cg.check_columns(df, checks).collect()
    assert [r.bad_rows for r in rows] == [1, 1, 0, 0]
    assert rows[0].message == f"n must be at most {2**53}"


def test_quotes_show_hidden_characters(spark):
    from corpusgate.functions.text import sql_quoted

    texts = ["a", "", "\x01", "\u200b", "\U000e0001x", "\x00\x7f", "\u2028 \xa0", "it's", "\\u200b", "\t\n\r", "\U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.expr(sql_quoted("t"))).collect()] == [repr(t) for t in texts]


def test_totals_are_told_from_a_null_group(spark):
    df = spark.createDataFrame([(None, True), ("a", False)], "task string, exact_match boolean")
    rows = {(r.task, r.is_total): r.total for r in cg.score_by(df).collect()}
    assert rows == {(None, False): 1, ("a", False): 1, (None, True): 2}


def test_long_numbers_are_valid_json(spark):
    chat = '{"messages":[{"role":"user","content":"x","y":%s}]}'
    lines = [chat % ("7" * 1500)]
    rows = cg.validate(spark.createDataFrame([(x,) for x in lines], "value string"), "chat").collect()
    assert all(r.rule != "invalid_json" for r in rows)


def test_callers_columns_stay(spark):
    lines = spark.createDataFrame([(1, "a", '{"task":"t","input":"i","expected_output":"e"}'), (2, "b", "x")], "_x int, `_a line` string, value string")
    judged = cg.validate(lines, "task")
    assert judged.columns[:3] == ["_x", "_a line", "value"]
    assert [(r["_x"], r["_a line"], r.rule) for r in judged.orderBy("_x").collect()] == [(1, "a", None), (2, "b", "invalid_json")]
    assert cg.valid_records(judged).columns == ["_x", "_a line", "task", "input", "expected_output"]
    assert cg.with_detected_schema(lines).columns == ["_x", "_a line", "value", "detected", "is_json"]
    settings = lines.select("_x", F.col("value").alias("settings"))
    assert check_settings(settings).columns == ["_x", "settings", "rule", "message", "resolved"]
    for name in ("rule", "Message", "remediation", "record", "__corpusgate_line"):
        with pytest.raises(cg.CorpusError, match="Rename|added"):
            cg.validate(lines.withColumn(name, F.lit(1)), "task")
    with pytest.raises(cg.CorpusError, match="added"):
        cg.valid_records(cg.validate(lines.withColumn("task", F.lit(1)), "task"))


def test_scoring_keeps_the_suites_own_columns(spark):
    suite = spark.createDataFrame([(1, "e", "own", 7), (2, "f", "own", 8)], "item int, expected_output string, prediction string, n_predictions int")
    said = spark.createDataFrame([(1, "e")], "item int, prediction string")
    for salt in (1, 4):
        got = cg.score(suite, said, ["item"], salt=salt).orderBy("item").collect()
        assert [(r.suite_prediction, r.suite_n_predictions, r.prediction, r.exact_match) for r in got] == [("own", 7, "e", True), ("own", 8, None, False)]


def test_chat_lines_are_written_turn_by_turn(spark, tmp_path):
    turns = hot_turns(spark, 30_000).repartition(8)
    odd = [(-1, 0, "user", 'q"\n\\é'), (-1, 0, "user", 'q"\n\\é'), (-1, 1, "assistant", None), (None, 3, "system", "x"), (-1, 0, "user", "a second")]
    turns = turns.unionByName(spark.createDataFrame(odd, turns.schema))
    write_chat_lines(turns, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).filter("trim(value) <> ''")
    got = [json.loads(r.value)["messages"] for r in lines.collect()]
    whole = [[m.asDict() for m in r.messages] for r in cg.assemble_chat(turns).collect()]
    key = lambda messages: json.dumps(messages, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, whole)) and max(map(len, got)) == 30_000
    assert cg.validate(cg.read_lines(spark, str(tmp_path / "out")), "chat").filter("rule IS NULL").count() == len(got) - 1
    write_chat_lines(turns.limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0
