import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgate.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.scored(docs, labels).join(labels.filter("quality IS NOT NULL"), "doc_id").filter("held_out").collect()
    right = np.array([r.predicted == r.quality for r in rows])
    assert len(rows) > 700 and right.mean() >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.scored(docs, changed).filter("held_out").collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)  # held out labels are never learnt


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.2).astype(float)
    model = quality.fit(x, y, trees=12, depth=3)
    score = model.score(x)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.95 and ((score >= 0) & (score <= 1)).all()
    assert np.allclose(model.score(x[:7]), score[:7])


def test_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (9, 0), (9, 1), (77, 1)], "doc_id long, quality int")
    got = quality.scored(documents(odd_rows), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.scored(documents([]), labels).count() == 0
    assert {r.score for r in quality.scored(documents(odd_rows), labels.limit(0)).collect()} == {0.5}
