import json
import random

import pytest
import plain_rules as plain
from pyspark.sql import functions as F

from corpusgate import CorpusError, validate, with_detected_schema
from corpusgate.operators.rules import (
    first_violation,
    require_valid,
    rule_counts,
    summarise,
    valid_records,
)

GOOD = '{"messages":[{"role":"user","content":"hi"}]}'
CHAT_CASES = [
    ("not json", "invalid_json", "invalid JSON"),
    ('{"role":"user","content":"hi"}', "unexpected_keys", "unexpected keys ['content', 'role'] in chat record"),
    ('{"messages":"not a list"}', "messages_not_list", '"messages" must be a list, got str'),
    ('{"messages":null}', "messages_not_list", '"messages" must be a list, got NoneType'),
    ('{"messages":{}}', "messages_not_list", '"messages" must be a list, got dict'),
    ('{"messages":[]}', "messages_empty", '"messages" list is empty'),
    ("{}", "missing_messages", 'missing required key "messages"'),
    ('{"messages":[{"content":"hi"}]}', "role_missing", 'messages[0] missing required key "role"'),
    ('{"messages":[{"role":"user"}]}', "content_missing", 'messages[0] missing required key "content"'),
    ('{"messages":[{"role":7}]}', "content_missing", 'messages[0] missing required key "content"'),
    ('{"messages":[{"role":"alien","content":"x"}]}', "role_invalid", "messages[0][\"role\"] 'alien' is not a valid role"),
    ('{"messages":[{"role":"User","content":"x"}]}', "role_invalid", "messages[0][\"role\"] 'User' is not a valid role"),
    ('{"messages":[{"role":"it\'s","content":"x"}]}', "role_invalid", 'messages[0]["role"] "it\'s" is not a valid role'),
    ('{"messages":[{"role":42,"content":"x"}]}', "role_not_string", 'messages[0]["role"] must be a string, got int'),
    ('{"messages":[{"role":true,"content":1}]}', "role_not_string", 'messages[0]["role"] must be a string, got bool'),
    ('{"messages":[{"role":"user","content":123}]}', "content_not_string", 'messages[0]["content"] must be a string, got int'),
    ('{"messages":[{"role":"user","content":1.5}]}', "content_not_string", 'messages[0]["content"] must be a string, got float'),
    ('{"messages":[{"role":"user","content":NaN}]}', "content_not_string", 'messages[0]["content"] must be a string, got float'),
    ('{"messages":[{"role":"user","content":["x"]}]}', "content_not_string", 'messages[0]["content"] must be a string, got list'),
    ('{"messages":[{"role":"user","content":"a"},{"role":"user","content":null}]}', "content_not_string", 'messages[1]["content"] must be a string, got NoneType'),
    ('{"messages":[3]}', "message_not_object", "messages[0] must be a JSON object, got int"),
    ('{"messages":[{"role":"user","content":"a"},[]]}', "message_not_object", "messages[1] must be a JSON object, got list"),
    ('{"messages":[3],"z":1,"b":2}', "unexpected_keys", "unexpected keys ['b', 'z'] in chat record"),
    ("null", "not_object", "expected a JSON object, got NoneType"),
    ("[1]", "not_object", "expected a JSON object, got list"),
    ('"s"', "not_object", "expected a JSON object, got str"),
    ("1.5", "not_object", "expected a JSON object, got float"),
    (GOOD + " x", "invalid_json", "invalid JSON"),
    (GOOD + "] [", "invalid_json", "invalid JSON"),
    (GOOD + "," + GOOD, "invalid_json", "invalid JSON"),
    (GOOD + ',"~~end"', "invalid_json", "invalid JSON"),
    (GOOD + ',"~~end"] x', "invalid_json", "invalid JSON"),
    (GOOD + "}", "invalid_json", "invalid JSON"),
    ("﻿" + GOOD, "invalid_json", "invalid JSON"),
    ('{"messages":[{"role":"user","content":"tab\there"}]}', "invalid_json", "invalid JSON"),
    (GOOD, None, None),
    ("\xa0 " + GOOD + " \x1c　", None, None),
    ('{"messages":[{"role":"user","content":"","extra":1}]}', None, None),
    ('{"messages":[],"messages":[{"role":"user","content":"last wins"}]}', None, None),
    ('{"messages":[{"role":"user","content":"~~end"}]}', None, None),
]
TASK = {"task": "t", "input": "i", "expected_output": "e"}
TASK_CASES = [
    (TASK, None, None),
    ({**TASK, "input": ""}, None, None),
    ({k: v for k, v in TASK.items() if k != "task"}, "missing_key:task", 'missing required key "task"'),
    ({k: v for k, v in TASK.items() if k != "input"}, "missing_key:input", 'missing required key "input"'),
    ({"task": "t", "input": "i"}, "missing_key:expected_output", 'missing required key "expected_output"'),
    ({**TASK, "task": 1}, "key_not_string:task", '"task" must be a string, got int'),
    ({"task": 1, "expected_output": "e"}, "key_not_string:task", '"task" must be a string, got int'),
    ({**TASK, "input": None}, "key_not_string:input", '"input" must be a string, got NoneType'),
    ({**TASK, "bonus": 1}, "unexpected_keys", "unexpected keys ['bonus'] in task record"),
    ({"bonus": 1}, "unexpected_keys", "unexpected keys ['bonus'] in task record"),
    ([TASK], "not_object", "expected a JSON object, got list"),
]


def judged(spark, lines, schema, numbered=False):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    if numbered:
        df = df.withColumn("line_no", F.col("i") + 1)
    return validate(df, schema)


def test_chat_rules_and_messages(spark):
    rows = judged(spark, [c[0] for c in CHAT_CASES], "chat").orderBy("i").collect()
    assert [(r.rule, r.message) for r in rows] == [c[1:] for c in CHAT_CASES]
    assert all((r.remediation is None) == (r.rule is None) == (r.record is not None) for r in rows)


def test_task_rules_and_messages(spark):
    lines = [json.dumps(c[0]) for c in TASK_CASES]
    rows = judged(spark, lines, "task").orderBy("i").collect()
    assert [(r.rule, r.message) for r in rows] == [c[1:] for c in TASK_CASES]
    assert rows[0].record.asDict() == TASK


def test_line_number_leads_the_message(spark):
    row = judged(spark, [GOOD, "", "x"], "chat", numbered=True).filter("rule IS NOT NULL").first()
    assert row.message == "line 3: invalid JSON"


def test_blank_lines_are_dropped(spark):
    assert judged(spark, ["", "  \t", "\xa0 ", GOOD], "chat").count() == 1


def test_values_survive(spark):
    content = 'é "q" \\ \n   😀 {got} {at}'
    line = json.dumps({"messages": [{"role": "system", "content": content}]})
    record = valid_records(judged(spark, [line], "chat")).first()
    assert record.messages[0].content == content


def test_placeholder_text_in_data_is_not_expanded(spark):
    line = json.dumps({"messages": [{"role": "{at}{got}", "content": "x"}]})
    assert judged(spark, [line], "chat").first().message == (
        "messages[0][\"role\"] '{at}{got}' is not a valid role"
    )


def test_long_strings_are_judged_whole(spark):
    head, tail = '{"messages":[{"role":"user","content":"', '"}]}'
    df = spark.range(2).selectExpr(
        "id AS i", f"concat('{head}', repeat('x', 21000000), '{tail}', if(id = 0, '', ' x')) AS value"
    )
    rows = validate(df, "chat").orderBy("i").select("rule", F.length(F.col("record.messages")[0]["content"])).collect()
    assert [tuple(r) for r in rows] == [(None, 21000000), ("invalid_json", None)]


def test_unknown_schema(spark):
    with pytest.raises(CorpusError) as caught:
        judged(spark, [GOOD], "dialog")
    assert caught.value.code == 1


def test_gate_reports_the_first_bad_line(spark):
    lines = [GOOD, "", GOOD, '{"messages":[]}', "x"]
    with pytest.raises(CorpusError, match='line 4: "messages" list is empty'):
        require_valid(judged(spark, lines, "chat", numbered=True), ["line_no"])
    require_valid(judged(spark, [GOOD], "chat"), ["i"])
    with pytest.raises(CorpusError, match="no records"):
        require_valid(judged(spark, ["", " "], "chat"), ["i"])


def test_summaries(spark):
    rows = judged(spark, [GOOD, "x", "", "{}", "y"], "chat")
    total = summarise(rows.withColumn("g", F.lit(1)), ["g"], "i").first()
    assert (total.records, total.valid, total.invalid, total.first_bad_i) == (4, 1, 3, 1)
    assert {r.rule: r.n for r in rule_counts(rows).collect()} == {
        "valid": 1, "invalid_json": 2, "missing_messages": 1
    }
    first = first_violation(rows.withColumn("g", F.lit(1)), ["g"], ["i"]).first()
    assert (first.i, first.rule) == (1, "invalid_json")


def random_value(rng, depth=0):
    kinds = [
        lambda: rng.choice(["", "x", "user", "assistant", "~~end", "a\"b\\", "é"]),
        lambda: rng.choice([0, -1, 1.5, 10**12, True, False, None]),
    ]
    if depth < 2:
        kinds += [
            lambda: [random_value(rng, depth + 1) for _ in range(rng.randrange(3))],
            lambda: {rng.choice(["role", "content", "x"]): random_value(rng, depth + 1) for _ in range(rng.randrange(4))},
        ]
    return rng.choice(kinds)()


def random_line(rng):
    message = lambda: rng.choice(
        [
            {"role": rng.choice(["user", "assistant", "system"]), "content": "hello"},
            {"role": random_value(rng), "content": random_value(rng)},
            random_value(rng),
        ]
    )
    task = {k: rng.choice(["s", "s", "s", random_value(rng)]) for k in TASK if rng.random() < 0.9}
    value = rng.choice(
        [
            lambda: {"messages": [message() for _ in range(rng.randrange(4))]},
            lambda: {"messages": random_value(rng)},
            lambda: task,
            lambda: {**task, **rng.choice([{}, {"messages": []}, {"more": 1}])},
            lambda: random_value(rng),
        ]
    )()
    line = json.dumps(value, ensure_ascii=rng.random() < 0.5)
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        at = rng.randrange(len(line) + 1)
        if rng.random() < 0.5:
            line = line[:at] + rng.choice('{}[],:" x1\xa0\t') + line[at:]
        else:
            line = line[:at] + line[at + 1 :]
    return line


def test_against_a_second_checker(spark):
    rng = random.Random(7)
    lines = [line for line in (random_line(rng) for _ in range(6000)) if line.strip()]
    for schema, rule in (("chat", plain.chat_rule), ("task", plain.task_rule)):
        rows = judged(spark, lines, schema).collect()
        wrong = [(r.value, r.rule, rule(r.value)) for r in rows if r.rule != rule(r.value)]
        assert len(rows) == len(lines) and wrong == []
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    wrong = [r for r in with_detected_schema(df).collect() if r.detected != plain.schema_of(r.value)]
    assert wrong == []
