import random
import re

import numpy as np
import oracle
import pyarrow as pa
import pytest

from corpusgate.llm import metric

SF = "/root/testdata/sf0.001"


def plain_set(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([" ".join(words)]) if len(words) < size else frozenset(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def plain(rows, percent):
    sets = [plain_set(t) for _, t in rows]
    ids = [i for i, _ in rows]
    near = [
        [j for j, b in enumerate(sets) if i != j and a and 100 * len(a & b) >= percent * len(a | b)]
        for i, a in enumerate(sets)
    ]
    out = []
    for i, a in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [ids[j] for j in seen if ids[j] is not None]
        out.append((ids[i], len(a), min(known, default=None), len(near[i])))
    return sorted(out, key=repr)


def family(rng, n, words, edits, base=0):
    """Copies of one text with words replaced, many just within or beyond the radius."""
    text = [f"v{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for k in range(n):
        copy = list(text)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(6)}"
        out.append((base + k, " ".join(copy)))
    return out


@pytest.mark.parametrize("percent, full, tile", [(90, 16, 1024), (80, 2, 8)])
def test_classes_equal_brute_force(spark, documents, odd_rows, percent, full, tile):
    rng = random.Random(percent + tile)
    rows = odd_rows + family(rng, 60, 60, 5, 1000) + family(rng, 40, 200, 9, 2000) + family(rng, 12, 12, 2, 3000)
    rows += [(4000 + i, f"Common opening of every letter, and one more word {i} " + " ".join(f"z{i}{k}" for k in range(i))) for i in range(60)]
    rows += [(5000 + i, rows[30][1].upper()) for i in range(30)]
    got = metric.jaccard_classes(documents(rows), percent, full=full, tile=tile).drop("rid").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, percent)


def test_several_rounds(spark, documents):
    rng = random.Random(4)
    rows = [r for f in range(6) for r in family(rng, 25, 50 + f, 3, 100 * f)]
    got = metric.jaccard_classes(documents(rows), full=3, pivots=2, tile=8).drop("rid").collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 90)
    assert metric.jaccard_classes(documents([])).count() == 0
    assert [tuple(r) for r in metric.jaccard_classes(documents([(1, None), (2, " ")])).drop("rid").orderBy("doc_id").collect()] == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_projections_lose_no_link():
    rng = np.random.default_rng(8)
    for percent in (90, 60):
        projections = metric.Projections(percent)
        met, missed = 0, 0
        for _ in range(4000):
            n = int(rng.integers(1, 160))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            lost = (100 - percent) / 100 * rng.random()
            b = np.unique(np.concatenate([a[rng.random(len(a)) > lost], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 12)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and both < len(a) and 100 * both >= percent * (len(a) + len(b) - both):
                met += 1
                missed += not np.intersect1d(projections.regions(a), projections.regions(b)).size
        assert met > 500 and missed == 0
    few = metric.Projections(90)
    few.divisions = lambda n: [(0, 50, 2)]  # most parts are empty
    assert np.intersect1d(few.regions(np.arange(3, dtype=np.uint64)), few.regions(np.arange(5, 9, dtype=np.uint64))).size >= 1


def test_pivot_distances():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 30))) for _ in range(80)] + [""]
    sets = metric.shingle_sets(pa.array(texts), 3)
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    index = metric.PivotIndex(sets[:10])
    got = {(i, j): d for i, j, d in zip(*(x.tolist() for x in index.near(sets, 0.6)))}
    want = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:10]):
            a_, b_ = plain_set(a), plain_set(b)
            if len(a_ ^ b_) <= 0.6 * len(a_ | b_) and a_ & b_:
                want[i, j] = len(a_ ^ b_)
    assert got == want


def test_sql(spark):
    assert oracle.difference(spark, oracle.connect(SF), metric.op11_jaccard_join, metric.OP11_SQL, SF) is None
