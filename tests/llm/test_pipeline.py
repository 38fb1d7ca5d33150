import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import pytest
from test_documents import plain_components, plain_simhash
from tokenizers import Tokenizer

from corpusgate.llm import toxicity

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, n=10):
    w = words(text)
    return {tuple(w[i : i + min(n, len(w))]) for i in range(max(len(w) - n, 0) + 1)} if w else set()


def copies(rows):
    """One row of each text, with the largest id."""
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    return sorted((i, t) for t, i in best.items())


def near(rows):
    """One row of each component, with its smallest id."""
    prints = [plain_simhash(t) for _, t in rows]
    ids = [None if i == -1 else i for i, _ in rows]
    groups = defaultdict(list)
    for (i, t), c in zip(rows, plain_components(prints, ids, 4)):
        groups[c].append((i, t))
    return groups


def clean(rows, items):
    known = {w for t in items for w in windows(t)}
    sizes = {len(w) for w in known}
    return [(i, t) for i, t in rows if not any(tuple(words(t)[k : k + n]) in known for n in sizes for k in range(len(words(t)) - n + 1))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def make(rows, items, labels):
        folder = str(tmp_path_factory.mktemp("tables"))
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENT)
        docs.selectExpr("*", "'x' AS rid", "'k' AS key").repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        return folder

    return make


def corpus(spark):
    rng = np.random.default_rng(7)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    rows = [(i, say(rng.integers(3, 300))) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(40)] + [(300 + i, rows[i][1] + " added") for i in range(30)]
    item = say(30)
    rows += [(400 + i, f"{say(40)} {item if i % 2 else item[:40]} {say(20)}") for i in range(12)]
    rows += [(500 + i, f"{say(30)} idiot {say(9)}") for i in range(60)]
    labels = [(i, 1, int(500 <= i)) for i, _ in rows if i % 2 or i >= 500]
    return rows, [(1, item), (2, None), (3, "")], labels


def test_stages_and_run_equal_plain_python(spark, tables):
    rows, items, labels = corpus(spark)
    folder = tables(rows, items, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]

    def stage(name, given):
        path = f"{folder}/{name}-in"
        given.write.parquet(path)
        return stages[name](spark, spark.read.parquet(path), folder)

    kept = stage("toxicity", docs)
    score = {r.doc_id: r.predicted for r in toxicity.scored(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    left = [(i, t) for i, t in rows if not score[i]]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(left)
    assert sum(i >= 500 for i, _ in left) <= 6 and sum(i < 500 for i, _ in left) == len(rows) - 60
    kept = stage("exact_dedup", kept)
    left = copies(left)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == left
    kept = stage("near_dedup", kept)
    left = sorted(min(g) for g in near(left).values())
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == left
    kept = stage("decontamination", kept)
    left = clean(left, [t for _, t in items])
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == left
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in left}
    for pieces in (stage("packing", kept).collect(), pipeline.run(spark, folder).collect()):
        got = defaultdict(list)
        for p in sorted(pieces, key=lambda p: (p.doc_id, p.piece)):
            got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
        assert got == want


def test_stages_of_odd_rows(spark, tables, odd_rows):
    _, items, labels = corpus(spark)
    folder = tables(odd_rows, items, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = Counter((i, t) for i, t in odd_rows)
    for name, stage in pipeline.STAGES[:4]:
        kept = Counter((r.doc_id, r.text) for r in stage(spark, docs, folder).collect())
        assert not kept - plain
        texts = Counter(t or "" for _, t in kept.elements())
        if name == "exact_dedup":
            assert texts == Counter({t or "": 1 for _, t in odd_rows})
        if name in ("toxicity", "decontamination"):
            assert kept == plain
    assert pipeline.run(spark, folder).filter("doc_id = 5").count() >= 1


def test_empty_tables_pass_through(spark, tables):
    folder = tables([], [], [])
    assert pipeline.run(spark, folder).count() == 0
