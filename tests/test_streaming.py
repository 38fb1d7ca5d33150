import pytest
from pyspark.sql import functions as F

from corpusgate import validate
from corpusgate.errors import CorpusError
from corpusgate.streaming.intake import (
    arrival_counts,
    late_counts,
    line_stream,
    read_counts,
    read_running_counts,
    start_counts,
    start_intake,
    start_running_counts,
)

GOOD = '{"messages":[{"role":"user","content":"%s"}]}'


def drop(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_intake_equals_batch_and_repeats_safely(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    drop(inbox, "a.jsonl", [GOOD % i for i in range(20)] + ["bad", "", "{}"])

    def run(checkpoint=state):
        start_intake(line_stream(spark, str(inbox)), "chat", out, checkpoint).awaitTermination()
        rows = spark.read.parquet(out).select("verdict", "rule", "value", "record", "line_id").collect()
        return sorted(map(repr, rows))

    first = run()
    drop(inbox, "b.jsonl", [GOOD % "x", "[]"])
    second = run()
    batch = validate(spark.read.text(str(inbox)), "chat")
    assert len(first) == 22 and len(second) == 24 == batch.count()
    assert spark.read.parquet(out).filter("verdict = 'rejected'").count() == batch.filter("rule IS NOT NULL").count() == 3
    assert run() == second
    # A lost checkpoint would number its batches anew; it gets a folder of its own.
    with pytest.raises(CorpusError, match="another checkpoint"):
        run(str(tmp_path / "fresh"))
    out = str(tmp_path / "again")
    assert run(str(tmp_path / "fresh")) == second


def test_counts_cover_all_rows_of_all_batches(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    events = spark.range(600).select(
        F.when(F.col("id") % 50 != 0, at).alias("at"),
        F.when(F.col("id") % 3 == 0, "bad").otherwise(GOOD % "x").alias("value"),
    )
    inbox, out, state = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "state")
    # The last batch holds the oldest rows.
    for low in (400, 200, 0):
        events.filter((F.col("at").isNull() & F.lit(low == 400)) | at_between(low)).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        start_counts(validate(stream, "chat"), out, state, "at").awaitTermination()
    got = sorted(map(repr, read_counts(spark, out).collect()))
    want = arrival_counts(validate(events, "chat"), "at").collect()
    assert got == sorted(map(repr, want)) and sum(r.n for r in want) == 600


def at_between(low):
    seconds = F.unix_seconds("at") - 1_700_000_000
    return (seconds >= low * 60) & (seconds < (low + 200) * 60)


def test_running_and_late_counts_hold_every_row(spark, tmp_path):
    """Batches out of order: state forgets old windows, and what comes later is counted apart."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    events = spark.range(1200).select(
        F.when(F.col("id") % 50 != 0, at).alias("at"),
        F.when(F.col("id") % 3 == 0, "bad").otherwise(GOOD % "x").alias("value"),
    ).cache()
    inbox, state = str(tmp_path / "events"), tmp_path / "state"
    most, dropped = 0, 0
    for low in (200, 0, 600, 400, 1000, 800):  # the second is late for nothing yet, later ones are
        events.filter((F.col("at").isNull() & F.lit(low == 400)) | at_between(low)).coalesce(1).write.mode("append").parquet(inbox)
        judged = validate(spark.readStream.schema(events.schema).parquet(inbox), "chat")
        start_counts(judged, str(tmp_path / "all"), str(state / "all"), "at").awaitTermination()
        run = start_running_counts(judged, str(tmp_path / "run"), str(state / "run"), "at", delay="30 minutes")
        run.awaitTermination()
        for progress in run.recentProgress:
            for operator in progress["stateOperators"]:
                most, dropped = max(most, operator["numRowsTotal"]), dropped + operator["numRowsDroppedByWatermark"]
    every, running = read_counts(spark, str(tmp_path / "all")), read_running_counts(spark, str(tmp_path / "run"))
    late = late_counts(every, running)
    assert dropped > 0 and late.filter("window_start IS NOT NULL").count() > 0
    both = running.unionByName(late).groupBy("window_start", "window_end", "rule").agg(F.sum("n").alias("n"))
    want = arrival_counts(validate(events, "chat"), "at").collect()
    assert sorted(map(repr, both.collect())) == sorted(map(repr, want))
    assert late.filter("window_start IS NULL").agg(F.sum("n")).first()[0] == 24
    windows = len({r.window_start for r in want})
    assert 0 < most < 2 * windows  # not every window of every rule is held


def test_late_rows_do_not_change_forgotten_windows(spark, tmp_path):
    inbox, state = str(tmp_path / "in"), tmp_path / "state"
    for hours in (0, 10, 0, 20):
        rows = spark.createDataFrame([(1_700_000_000 + 3600 * hours, "bad")] * 5, "t long, value string")
        rows.select(F.timestamp_seconds("t").alias("at"), "value").coalesce(1).write.mode("append").parquet(inbox)
        judged = validate(spark.readStream.schema("at timestamp, value string").parquet(inbox), "chat")
        start_counts(judged, str(tmp_path / "all"), str(state / "all"), "at").awaitTermination()
        start_running_counts(judged, str(tmp_path / "run"), str(state / "run"), "at").awaitTermination()
    running = read_running_counts(spark, str(tmp_path / "run"))
    assert sorted(r.n for r in running.collect()) == [5, 5, 5]
    assert [r.n for r in late_counts(read_counts(spark, str(tmp_path / "all")), running).collect()] == [5]
