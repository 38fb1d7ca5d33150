import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgate.llm import toxicity
from corpusgate.llm.common import held_out, text_bytes

SF = "/root/testdata/sf0.1"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.learn(read(spark, "documents"), read(spark, "labels"))


def scores(model, texts):
    return model.probability(model.tops(pa.array(texts))[0])


def test_repeated_ids_do_not_widen_the_sample(spark, documents):
    ids = range(60)
    docs = documents([(i, f"text {i} {n}") for i in ids for n in range(1 if i % 7 else 30)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in ids], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, 10, 20).collect()
    assert sum(r.toxic for r in rows) == 10 and len(rows) == 30
    assert len({r.text.split()[1] for r in rows}) == 30


def test_held_out_accuracy(spark, model):
    rows = read(spark, "documents").join(read(spark, "labels"), "doc_id").filter(held_out(F.col("doc_id"))).select("text", "toxic").collect()
    found = scores(model, [r.text for r in rows]) >= 0.5
    toxic = np.array([r.toxic for r in rows]) == 1
    assert len(rows) > 700 and (found == toxic).mean() >= 0.97
    assert found[toxic].mean() >= 0.8 and found[~toxic].mean() <= 0.02


def test_hidden_insults_are_found(model):
    words = "idiot moron stupid clown loser scum trash pathetic worthless disgusting".split()
    ways = [
        str, ".".join, "-".join, " ".join, "_".join, lambda w: f"{w[:2]}1{w[2:]}", lambda w: f"{w[:-2]}..{w[-2:]}",
        *(lambda w, k=k, x=x: f"{w[:k]}{x}{w[k:]}" for k in (2, 3) for x in "xqz"), lambda w: w.upper(),
    ]
    missed = [t for way in ways for w in words if scores(model, [t := f"the of and {way(w)} in the"])[0] < 0.5]
    assert not missed
    clean = ["nothing to see in the an of the reth", "u.s.a. and n.a.t.o. meet", "x y z w v", "a b c d e", "well-known 3.5 e.g. i.e.", "", "a"]
    assert (scores(model, clean) < 0.5).all()


def test_letters_are_joined():
    texts = ["you i.d.i.o.t now", "i d i o t", "id1iot idi..ot i-d-i-o-t", "a b", "é a b c é", "end. Start a . b . c", "1 2 3 4", "....", "", "q", "x y", "z"]
    data, bounds = toxicity._joined(*text_bytes(pa.array(texts)))
    got = [data[s:e].tobytes().decode() for s, e in zip(bounds[:-1], bounds[1:])]
    assert got == ["you idiot now", "idiot", "idiot idiot idiot", "a b", "é abc é", "end. Start a . b . c", "1 2 3 4", "....", "", "q", "x y", "z"]
    assert toxicity._joined(*text_bytes(pa.array([], pa.string())))[0].size == 0


def test_kernel_sums_equal_brute_force(model):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé1."), rng.integers(1, 9))) for _ in range(50)]
    data, bounds = toxicity._marked(*text_bytes(pa.array([" ".join(words)])))
    symbols = toxicity._symbols()[data]
    _, _, _, got = toxicity.word_scores(symbols, bounds, model.weights)
    for word, value in zip(words, got):
        s = [0, *toxicity._symbols()[list(word.encode())], 0, *[0] * toxicity.REACH]
        total = 0.0
        for at in range(len(word.encode()) + 1):
            for i, j, k in toxicity.STEPS:
                if all(s[at + 1 : at + k]):  # the word end itself may come last
                    code = ((s[at] * 64 + s[at + i]) * 64 + s[at + j]) * 64 + s[at + k]
                    slot = (int(code) * 0x9E3779B1 % (1 << 32)) >> 12
                    total += model.weights[slot] * toxicity.DECAY ** (k - 3)
        assert value == pytest.approx(total / np.sqrt(len(word.encode()) + 1), abs=1e-3)


def test_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (9, 0), (9, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.scored(documents(odd_rows), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.scored(documents([]), labels).count() == 0
    none = toxicity.scored(documents([(1, "a text"), (2, None)]), labels.limit(0)).collect()
    assert [r.predicted for r in none] == [0, 0]
