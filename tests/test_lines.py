import pytest
from pyspark.sql import functions as F

from corpusgate import CorpusError, detect_corpus_schema, file_report, read_lines, read_records, read_suite
from corpusgate.sources import lines as source

CHAT = '{"messages":[{"role":"user","content":"%s"}]}'
TASK = '{"task":"t","input":"%s","expected_output":"o"}'


def write(folder, name, text):
    path = folder / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_numbers_over_many_splits(spark, tmp_path, small_splits):
    expected = {}
    for f, n in enumerate((400, 3, 151)):
        lines = [("" if (i * 7 + f) % 5 == 0 else f"line {f} {i} " + "x" * (i % 40)) for i in range(n)]
        write(tmp_path, f"part-{f}.txt", "\n".join(lines) + "\n")
        expected |= {(f, i + 1): line for i, line in enumerate(lines) if line}
    raw = source.raw_lines(spark, str(tmp_path))
    assert raw.select("file", "block").distinct().count() > 15
    number = F.regexp_extract("file", r"part-(\d)", 1).cast("int").alias("f")
    rows = source.drop_blank(read_lines(spark, str(tmp_path))).select(number, "line_no", "value").collect()
    assert {(r.f, r.line_no): r.value for r in rows} == expected and len(rows) == len(expected)

    records = read_records(spark, str(tmp_path)).select(number, "index", "line_no", "value").collect()
    assert {(r.f, r.line_no): r.value for r in records} == expected
    for f in range(3):
        mine = sorted((r.line_no, r["index"]) for r in records if r.f == f)
        assert [i for _, i in mine] == list(range(len(mine)))


def test_numbers_without_broadcast(spark, tmp_path, small_splits, monkeypatch):
    write(tmp_path, "a.txt", "\n".join(f"line {i}" for i in range(500)))
    monkeypatch.setattr(source, "BROADCAST_SPLITS", 0)
    lines = read_lines(spark, str(tmp_path))
    assert "SortMergeJoin" in lines._jdf.queryExecution().toString()
    assert {(r.line_no, r.value) for r in lines.collect()} == {(i + 1, f"line {i}") for i in range(500)}


@pytest.mark.parametrize("text", ["a\r\nb\r\n\r\nc", "a\nb\n\nc\n", "a\rb\r\rc"])
def test_line_ends(spark, tmp_path, text):
    path = write(tmp_path, "a.txt", text)
    assert {(r.line_no, r.value) for r in source.drop_blank(read_lines(spark, path)).collect()} == {
        (1, "a"), (2, "b"), (4, "c")
    }


def test_missing_path(spark, tmp_path):
    with pytest.raises(CorpusError) as caught:
        read_lines(spark, str(tmp_path / "none"))
    assert caught.value.code == 2


def test_file_report(spark, tmp_path, small_splits):
    good = [CHAT % i for i in range(300)]
    late = good[:120] + [""] + good[120:200] + ["bad"] + good[:5] + ['{"messages":[]}']
    write(tmp_path, "late.jsonl", "\n".join(late))
    write(tmp_path, "good.jsonl", "\n".join(good) + "\n")
    write(tmp_path, "blank.jsonl", "\n   \n\n")
    write(tmp_path, "empty.jsonl", "")
    rows = {r.file.rsplit("/", 1)[1]: r[1:] for r in file_report(spark, str(tmp_path), "chat").collect()}
    assert rows == {
        "late.jsonl": (208, 1, 207, 205, 2, 202, "invalid_json"),
        "good.jsonl": (300, 0, 300, 300, 0, None, None),
        "blank.jsonl": (3, 3, 0, 0, 0, None, "no_records"),
        "empty.jsonl": (0, 0, 0, 0, 0, None, "no_records"),
    }


def test_suite(spark, tmp_path, small_splits):
    path = write(tmp_path, "suite.jsonl", "\n\n" + "\n".join(TASK % i for i in range(100)))
    rows = read_suite(spark, path).orderBy("index").collect()
    assert [(r["index"], r.line_no, r.input) for r in rows] == [(i, i + 3, str(i)) for i in range(100)]
    bad = write(tmp_path, "bad.jsonl", "\n".join([TASK % 1] * 60 + ['{"task":1}', "x"]))
    with pytest.raises(CorpusError, match='line 61: "task" must be a string, got int'):
        read_suite(spark, bad)


def test_corpus_schema(spark, tmp_path):
    chat = write(tmp_path, "a.jsonl", "\n \n" + CHAT % 1 + "\n" + TASK % 1)
    task = write(tmp_path, "b.jsonl", '{"task":"only"}\n')
    bad = write(tmp_path, "c.jsonl", "oops\n" + TASK % 1)
    other = write(tmp_path, "d.jsonl", '{"input":"x"}')
    blank = write(tmp_path, "e.jsonl", "\n\n")
    assert detect_corpus_schema(spark, chat) == "chat"
    assert detect_corpus_schema(spark, task) == "task"
    assert detect_corpus_schema(spark, [blank, task]) == "task"
    for path in (bad, other, blank):
        assert detect_corpus_schema(spark, path, default="chat") == "chat"
        with pytest.raises(CorpusError) as caught:
            detect_corpus_schema(spark, path)
        assert caught.value.code == 1
    missing = str(tmp_path / "none")
    assert detect_corpus_schema(spark, missing, default="chat") == "chat"
    with pytest.raises(CorpusError) as caught:
        detect_corpus_schema(spark, missing)
    assert caught.value.code == 2


def test_corpus_schema_is_the_first_record_also_over_many_splits(spark, tmp_path, small_splits):
    records = [TASK % 1] + [CHAT % i for i in range(300)]
    late = write(tmp_path, "late.jsonl", "\n" * 3000 + "\n".join(records))
    early = write(tmp_path, "early.jsonl", "\n".join(records))
    for path in (late, early):
        assert detect_corpus_schema(spark, path) == "task"


def test_running_offsets_need_no_single_window(spark):
    rows = spark.range(997).select(F.format_string("f%05d", (F.col("id") * 619) % 997).alias("file"), (F.col("id") % 13).alias("n"), F.lit(2).alias("m"))
    got = source.running_offsets(rows, "file", ["n", "m"])
    found = sorted(map(tuple, got.select("file", "n", "n_before", "m_before").collect()))
    total = 0
    for i, (_, n, n_before, m_before) in enumerate(found):
        assert (n_before, m_before) == (total, 2 * i)
        total += n
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert source.running_offsets(rows.limit(0), "file", ["n"]).count() == 0
