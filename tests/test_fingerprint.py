import gzip
import hashlib
import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from corpusgate import corpus_digest, file_digests, manifest, manifest_drift, read_runs, run_groups, table_digest
from corpusgate.functions.digest import row_text
from corpusgate.operators.fingerprint import exact_duplicates, line_digests
from corpusgate.sinks.files import write_manifest

FILES = {
    "three.jsonl": b'{"a":1}\n{"a":2}\n{"a":3}\n',
    "no end.jsonl": b'{"a":1}\n{"a":2}\n{"a":3}',
    "blank.jsonl": b'{"a":1}\n\n  \t\r\n{"a":3}\n',
    "nbsp.jsonl": "x\n\xa0\ny\rz\n".encode(),
    "bytes.bin": b"\xff\xfe\x00\n\x80\n",
    "empty.jsonl": b"",
}


def expected(content):
    count = sum(1 for line in content.split(b"\n") if line.strip())
    return len(content), hashlib.sha256(content).hexdigest(), count


def test_file_digests(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_bytes(content)
    rows = file_digests(spark, str(tmp_path)).collect()
    found = {r.file.rsplit("/", 1)[1].replace("%20", " "): r[1:] for r in rows}
    assert found == {name: expected(content) for name, content in FILES.items()}


def test_large_files_need_only_sparks_readers(spark, tmp_path):
    contents = FILES | {
        "mark.jsonl": b"\xef\xbb\xbfa\nb", "mark end.jsonl": b"\xef\xbb\xbfa\r\n\n", "end.jsonl": b"\n",
        "many.jsonl": b"".join(b"%d\r\n" % i for i in range(5000)),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.digests.link./in", f"file://{tmp_path}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = file_digests(spark, "viewfs://digests/in").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {r.file.rsplit("/", 1)[1].replace("%20", " "): r.sha256 for r in rows}
    assert found == {name: hashlib.sha256(content).hexdigest() for name, content in contents.items()}


def test_compressed_files_are_digested_as_read(spark, tmp_path):
    content = b"".join(b'{"a":%d}\n\n' % i for i in range(3000))
    (tmp_path / "plain.jsonl").write_bytes(content)
    with gzip.open(tmp_path / "packed.jsonl.gz", "wb") as out:
        out.write(content)
    rows = {r.file.rsplit("/", 1)[1]: r for r in file_digests(spark, str(tmp_path)).collect()}
    plain, packed = rows["plain.jsonl"], rows["packed.jsonl.gz"]
    assert (packed.sha256, packed.line_count) == (plain.sha256, plain.line_count) == (hashlib.sha256(content).hexdigest(), 3000)
    assert packed.bytes == (tmp_path / "packed.jsonl.gz").stat().st_size


def test_files_are_hashed_without_moving_lines(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x\n" * 50_000)
    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: (plans.append(w._df._jdf.queryExecution().executedPlan().toString()), write(w, *a, **k))[1])
    file_digests(spark, str(tmp_path)).collect()
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Sort" not in plans[0]


def test_line_digest_is_the_same_for_every_split(spark, tmp_path):
    def digests(folder, split=None):
        options = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"} if split else {}
        for key, value in options.items():
            spark.conf.set(key, value)
        try:
            rows = line_digests(spark, str(folder)).collect()
        finally:
            for key in options:
                spark.conf.unset(key)
        return {r.file.rsplit("/", 1)[1].replace("%20", " "): r[1:] for r in rows}

    (tmp_path / "in").mkdir()
    contents = FILES | {"many.jsonl": b"".join(b"%d\n" % (i % 7) for i in range(5000))}
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    whole = digests(tmp_path / "in")
    assert whole == digests(tmp_path / "in", 200) == digests(tmp_path / "in", 4000)
    assert {n: d[:2] for n, d in whole.items()} == {n: (len(c), len(c.split(b"\n")) - (not c or c.endswith(b"\n"))) for n, c in contents.items()}
    for i, other in enumerate([b"2\n1\n", b"1\n2\n", b"1\n2", b"1\n\n2\n", b"1\n3\n"]):
        (tmp_path / f"other{i}").write_bytes(other)
    assert len({digests(tmp_path / f"other{i}")[f"other{i}"][2] for i in range(5)}) == 5


def test_corpus_digest(spark, tmp_path):
    def digest(**files):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        for name, content in files.items():
            (folder / name).write_text(content)
        return corpus_digest(file_digests(spark, str(folder)), str(folder)).first()

    base = digest(a="1\n2\n", b="3\n")
    assert (base.files, base.line_count) == (2, 3)
    assert digest(b="3\n", a="1\n2\n") == base
    assert digest(a="1\n2\n", b="4\n").digest != base.digest
    assert digest(a="1\n2\n", c="3\n").digest != base.digest


def test_corpus_digest_knows_folders(spark, tmp_path):
    def digest(run, contents):
        for name, content in contents.items():
            (tmp_path / run / name).mkdir(parents=True)
            (tmp_path / run / name / "a").write_text(content)
        root = str(tmp_path / run)
        return corpus_digest(file_digests(spark, root + "/*"), root).first().digest

    assert digest("r", {"x": "1\n", "y": "2\n"}) != digest("s", {"x": "2\n", "y": "1\n"})
    with pytest.raises(Exception, match="is not below"):
        corpus_digest(file_digests(spark, str(tmp_path / "r" / "*")), "/elsewhere").first()


def test_table_digest_ignores_the_time_zone(spark):
    df = spark.sql("SELECT timestamp_seconds(1700000000) AS t")
    found = set()
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            found.add(table_digest(df, ["t"]).first().digest)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(found) == 1


def test_run_record_and_history_agree(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text("{}\n")
    record = manifest(
        file_digests(spark, str(tmp_path / "d.jsonl")), model="m", method="lora", hyperparameters=F.parse_json(F.lit("{}"))
    )
    write_manifest(record, str(tmp_path / "run"), str(tmp_path / "history"))
    written = read_runs(spark, str(tmp_path / "run" / "*.json")).first()
    assert written.timestamp == spark.read.parquet(str(tmp_path / "history")).first().timestamp


def test_row_text_is_unambiguous(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("n", "ab"), ("ab", None), ("s1:a", "b"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    texts = [r[0] for r in df.select(row_text([F.col("x"), F.col("y")])).collect()]
    assert len(set(texts)) == len(rows)


def test_table_digest(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    base = table_digest(df, ["i", "s"]).first()
    assert table_digest(df.orderBy(F.desc("i")).repartition(3), ["i", "s"]).first() == base
    assert table_digest(df.distinct(), ["i", "s"]).first().digest != base.digest
    total = sum(
        int(hashlib.sha256(t.encode()).hexdigest()[:15], 16) for t in ("s1:1s1:a", "s1:2n", "s1:2n")
    )
    assert (base.n_rows, base.digest) == (3, str(total))
    empty = table_digest(df.filter("i > 9"), ["i", "s"]).first()
    assert (empty.n_rows, empty.digest) == (0, "0")


def test_drift(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, sha256 string")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "file string, sha256 string")
    rows = manifest_drift(before, after, ["file"], "sha256").collect()
    assert {r.file: r.status for r in rows} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}


def test_run_records(spark, tmp_path):
    data = tmp_path / "data.jsonl"
    data.write_text('{"a":1}\n{"a":2}\n')
    for run, stamp in (("r1", "2024-01-01T00:00:00"), ("r2", "2024-01-02T03:04:05.5"), ("r3", None)):
        record = manifest(
            file_digests(spark, str(data)),
            model="m",
            method="qlora",
            hyperparameters=F.parse_json(F.lit('{"lora_r": 16, "load_in_4bit": true}')),
            timestamp=stamp,
        )
        write_manifest(record, str(tmp_path / "runs" / run), str(tmp_path / "history"))
    bad = tmp_path / "runs" / "r4"
    bad.mkdir()
    (bad / "run.json").write_text("{oops")
    runs = read_runs(spark, str(tmp_path / "runs" / "*" / "*.json"))
    assert runs.filter("_corrupt_record IS NOT NULL").count() == 1
    good = runs.filter("_corrupt_record IS NULL")
    assert {r[0] for r in good.select("dataset.sha256").collect()} == {expected(data.read_bytes())[1]}
    stamps = sorted(r.timestamp for r in good.select("timestamp").collect())
    assert stamps[:2] == ["2024-01-01T00:00:00.000000+00:00", "2024-01-02T03:04:05.500000+00:00"]
    group = run_groups(good).first()
    assert (group.runs, group.first_run) == (3, stamps[0])
    assert json.loads(group.settings) == {"lora_r": 16, "load_in_4bit": True}
    assert spark.read.parquet(str(tmp_path / "history")).count() == 3


def test_exact_duplicates(spark):
    rows = [(3, "a", "x"), (1, "a", "x"), (2, "a", None), (5, "a", None), (4, "ax", ""), (6, "", "ax")]
    got = exact_duplicates(spark.createDataFrame(rows, "k int, t string, u string").repartition(3), ["t", "u"], "k")
    assert sorted((r.copies, r["first"]) for r in got.collect()) == [(2, 1), (2, 2)]
