import glob
import hashlib
import random
import re
import tempfile
import time
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from corpusgate.llm import exact, recompression, repeats, suffixdedup
from corpusgate.llm.suffixes import SuffixSorter, repeated_positions


def earlier_copies(texts, window):
    """Per text, in document order: removed bytes, removed runs, digest of the rest."""
    seen, out = set(), []
    for data in (t.encode() for t in texts):
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(part)
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def words_left(texts, window):
    split = [[w for w in re.split("[\x20\x09-\x0d]+", t) if w] for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def random_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["aa", "b", "the", "ü", "cd"] + [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts).split(" ")
            a = rng.randrange(len(other))
            text[rng.randrange(len(text) + 1) :] = other[a : a + rng.randrange(1, 60)]
        texts.append(" ".join(text))
    return texts + ["ab" * 200, "a" * 300, "the " * 90, "the the b " * 50]


@pytest.mark.parametrize("cap, letters", [(2, 1), (3, 2), (8, 3), (20, 2)])
def test_sorted_repeats_match_a_set(cap, letters):
    rng = random.Random(cap)
    for budget in (0, 60, 1 << 20):
        pieces = [np.array([97 + rng.randrange(letters) for _ in range(rng.randrange(70))], np.uint8) for _ in range(6)]
        seen, want, base = set(), [], 0
        for data in (p.tobytes() for p in pieces):
            for i in range(len(data) - cap + 1):
                if data[i : i + cap] in seen:
                    want.append(base + i)
                seen.add(data[i : i + cap])
            base += len(data)
        with tempfile.TemporaryDirectory() as folder:
            assert repeated_positions(iter(pieces), cap, folder, budget).tolist() == want


def test_sorting_keeps_the_files_of_one_pass(tmp_path):
    text = np.append(np.random.default_rng(1).integers(2, 9, 5000), 0).astype(np.uint16)
    order = np.concatenate([pos for pos, _ in SuffixSorter(text, 20, str(tmp_path), budget=0).blocks()])
    assert sorted(order) == list(range(5000))
    assert len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("window", [100, 30])
def test_bytes_match_brute_force(documents, window):
    texts = random_texts(window)
    docs = documents(list(enumerate(texts)))
    got = suffixdedup.without_later_copies(docs, window, gram=8 if window < 50 else 24).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == earlier_copies(texts, window)


def test_no_shard_holds_a_frequent_passage(documents, monkeypatch):
    monkeypatch.setattr(suffixdedup, "RIVALS", 40, raising=False)
    rng = random.Random(9)
    phrase = "a passage of ninety bytes that very many documents hold between words of their own, the same"
    texts = [f"{rng.choice('abc')}{rng.random()} {rng.choice('xy')}{phrase}{rng.choice('pqr')} {rng.random()}" * 2 for _ in range(150)]
    texts += random_texts(7, 30)
    met, later = [], suffixdedup._later_spans

    def spy(contexts, *rest):
        met.append(contexts.groupBy("key").count().agg({"count": "max"}).first()[0])
        return later(contexts, *rest)

    monkeypatch.setattr(suffixdedup, "_later_spans", spy)
    got = suffixdedup.without_later_copies(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == earlier_copies(texts, 100)
    assert met[0] <= 40


def test_texts_are_shuffled_twice_and_shuffles_deleted(spark, documents, monkeypatch):
    """Also where some keys have few rivals and others many."""
    monkeypatch.setattr(suffixdedup, "RIVALS", 40)
    joins, join = [], suffixdedup.with_text
    monkeypatch.setattr(suffixdedup, "with_text", lambda *a: joins.append(1) or join(*a))
    phrase = "a passage of ninety bytes that very many documents hold between words of their own, the same"
    texts = [f"{i % 3}{i * i} {i % 2}{phrase}{i % 5} {i}" * 2 for i in range(150)] + random_texts(7, 30)

    def held():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))

    docs, before = documents(list(enumerate(texts))), held()
    got = suffixdedup.without_later_copies(docs)
    left = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for _ in range(50):
        if len(held() - before) <= 8:  # of the first table, which repartition() made
            break
        time.sleep(0.2)
    assert len(held() - before) <= 8 and left == "false"
    assert [tuple(r)[2:] for r in got.orderBy("doc_id").collect()] == earlier_copies(texts, 100)
    assert len(joins) == 2


def test_classes_leave_no_shuffle_files(spark):
    shared = spark.range(1000).select(F.col("id").alias("num"), (F.col("id") % 7).alias("key"), (F.col("id") % 70).alias("ctx"), F.lit(0).alias("at"), F.lit(1).alias("n"))
    before = set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))
    got = repeats.classes(shared, "test-classes")
    for _ in range(50):
        if not (new := set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data")) - before):
            break
        time.sleep(0.2)
    assert not new and got.filter("rivals = 10").count() == 70


def test_bytes_of_odd_rows(documents, odd_rows):
    rows = sorted(odd_rows, key=lambda r: -1 if r[0] is None else r[0])
    got = suffixdedup.without_later_copies(documents(rows)).collect()
    want = Counter((i, *w) for (i, _), w in zip(rows, earlier_copies([t or "" for _, t in rows], 100)))
    assert Counter(tuple(r)[1:] for r in got) == want
    assert suffixdedup.without_later_copies(documents([])).count() == 0


@pytest.mark.parametrize("window", [35, 12])
def test_words_match_brute_force(documents, window):
    texts = random_texts(window + 1)
    got = recompression.without_repeats(documents(list(enumerate(texts))), window).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == words_left(texts, window)


def test_words_of_odd_rows(documents, odd_rows):
    got = recompression.without_repeats(documents(odd_rows)).collect()
    want = words_left([t or "" for _, t in odd_rows], 35)
    assert Counter(tuple(r)[1:] for r in got) == Counter((i, *w) for (i, _), w in zip(odd_rows, want))
    assert recompression.without_repeats(documents([])).count() == 0


def test_equal_windows_share_a_symbol():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 50, 60).astype(np.uint64)
    a, b = (np.concatenate([rng.integers(0, 50, n).astype(np.uint64), shared, rng.integers(0, 50, 9).astype(np.uint64)]) for n in (20, 33))
    powers = recompression.Powers(recompression._LINE_BASE)
    keys = []
    for values, shift in ((a, 20), (b, 33)):
        _, key, _, at, n = recompression.places(values, np.zeros(len(values), np.int64), 35, powers)
        keys.append(np.repeat(key, n)[shift : shift + 26])
    assert (keys[0] == keys[1]).all()


def test_long_inputs_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(recompression, "SEGMENT_WORDS", 50)
    values = np.random.default_rng(1).integers(0, 9, 400).astype(np.uint64)
    text = np.repeat([0, 1], [130, 270])
    powers = recompression.Powers(recompression._LINE_BASE)
    parts, whole = recompression._segmented(values, text, 20, powers), recompression.places(values, text, 20, powers)
    spread = [np.repeat(np.asarray(p[1]), np.asarray(p[4])) for p in (parts, whole)]
    assert (spread[0] == spread[1]).all()


def test_long_words_of_a_regular_pattern_do_not_meet(spark, documents):
    parity = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    other = parity.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*around[:20], word, *around[20:]])) for i, word in enumerate((parity, other))]
    assert [r.n_removed for r in recompression.without_repeats(documents(rows)).collect()] == [0, 0]


def test_hot_keys_are_split(spark, documents):
    options = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # a hot partition is split by its map tasks
        "spark.sql.files.openCostInBytes": "100000000",
    }
    rows = [(i, "one copy of many") for i in range(20_000)] + [(90_000 + i, f"text {i}") for i in range(100)]
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        groups = exact.exact_groups(documents(rows).repartition(8))
        assert groups.filter("group_size = 20000").count() == 20_000
        groups.collect()
        assert "skew=true" in groups._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in options:
            spark.conf.unset(key)
