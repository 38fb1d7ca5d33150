import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusgate.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text):
    words = WORD.findall(lowered(text))
    grams = [*words, *(" ".join(p) for p in zip(words, words[1:]))]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain(docs, target, percent=25):
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= 20)
    drawn = Counter((None if none else i, -score) for score, none, i in fit[: percent * len(fit) // 100])
    return rows, drawn


def check(spark, make, rows, target):
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id bigint, text string, doc_id string")
    got = resampling.resample(make(rows), bench).collect()
    want, drawn = plain(rows, target)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    ranks = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranks] == list(range(1, len(ranks) + 1))
    assert [r[1:] for r in ranks] == sorted(r[1:] for r in ranks)
    assert Counter((None if none else i, -score) for _, score, none, i in ranks) == drawn


def test_resampling_equals_brute_force(spark, documents, odd_rows):
    rng = np.random.default_rng(3)
    many = [(100 + i, " ".join(f"W{x}" for x in rng.zipf(1.3, rng.integers(1, 90)) % 500)) for i in range(400)]
    many += [(7777, "same words again and again " * 9)] * 50
    check(spark, documents, odd_rows + many, [" ".join(f"w{x}" for x in range(60)), None, "", "É é ab"])
    check(spark, documents, odd_rows, [])
    check(spark, documents, [], ["some target"])


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want, drawn = plain(docs, bench)
    got = resampling.op13_importance_resampling(spark, sf).collect()
    assert got[0].__fields__ == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted((r[0], *r[2:]) for r in want)
    assert Counter((r.doc_id, r.score) for r in got if r["rank"]) == drawn


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    gains = rng.integers(-30000, 30000, 10000)
    counts = rng.integers(0, 70000, (5, 10000)) * (rng.random((5, 10000)) < 0.001)
    counts[4] = 0
    at = np.repeat(np.arange(50000), counts.ravel())
    sums = resampling.Gains(gains).sums(resampling.bit_planes(at, 5, 10000), 5)
    assert sums.tolist() == (counts * gains).sum(axis=1).tolist()
    assert resampling.Gains(np.zeros(10000, int)).sums([], 2).tolist() == [0, 0]


def test_joined_crcs():
    texts = ["a", "b" * 64 + " c", "c" * 65, "d" * 300 + " " + "e" * 200 + " f", "", "é ü"]
    of, bucket, words = resampling.Features()(pa.array(texts))
    for i, text in enumerate(texts):
        n, want = plain_features(text)
        assert words[i] == n and sorted(bucket[of == i].tolist()) == sorted(want)
