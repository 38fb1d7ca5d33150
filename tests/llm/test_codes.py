import hashlib
from collections import defaultdict

import numpy as np
import oracle
import pytest

from corpusgate.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, vector string, _label string"
SF = "/root/testdata/sf0.001"


def plain(rows):
    """Every round over every entry, in Python integers."""
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    width = len(first[0][1]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    for r in range(7):
        near = [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), j) for j, e in enumerate(books[p])) for p in range(8)] for _, v, _ in kept]
        if r == 6:
            break
        for p in range(8):
            for j in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), n in zip(kept, near) if n[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in n) for n in near]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    return [(i, "".join(f"{j:02x}" for _, j in n), e, by_label[label], digest) for (i, _, label), n, e in zip(kept, near, error)]


def run(spark, rows, tmp):
    spark.createDataFrame([(*r, "c", "v", "l") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp}/embeddings.parquet")
    return [tuple(r) for r in codes.op12_vector_codes(spark, str(tmp)).collect()]


def test_codes_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=16) * (0.1 + i % 3)], i % 4 or None) for i in range(600)]
    rows += [(1000, None, 1), (1001, [None] + [1.0] * 15, 1), (1002, [float("nan")] * 16, 1), (1003, [float("-inf")] * 16, None)]
    rows += [(7, rows[7][1], 3)] * 200 + [(None, [0.5] * 16, 2), (5000, [-1e-9] * 16, 2), (5001, [0.0] * 16, None)]
    assert sorted(run(spark, rows, tmp_path / "many"), key=repr) == sorted(plain(rows), key=repr)


def test_few_and_no_vectors(spark, tmp_path):
    rows = [(3, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [2.0] * 8, None)]
    assert sorted(run(spark, rows, tmp_path / "few")) == sorted(plain(rows))
    assert run(spark, [], tmp_path / "none") == []
    assert run(spark, [(1, None, 1)], tmp_path / "null") == []
    with pytest.raises(ValueError, match="one length"):
        run(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], tmp_path / "lengths")
    with pytest.raises(ValueError, match="multiple"):
        run(spark, [(1, [1.0] * 9, 1)], tmp_path / "odd")


def test_bounds_save_rescans(spark):
    _, _, scans = codes.compress(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    assert scans[0] == 500 * 8 and scans[-1] < scans[0]


def test_net_moves_are_tighter_than_drifts():
    history = np.zeros((4, 1, 2, 2), np.int64)
    history[1, 0, 0], history[2, 0, 0], history[3, 0, 0] = (10, 0), (0, 0), (3, 4)
    moves = codes.net_moves(history)
    assert moves[0, 0, 0] == pytest.approx(5) and moves[1, 0, 0] == pytest.approx(np.hypot(7, 4)) and moves[3].max() < 1e-6
    # entry 1 stood still, so only moves of entry 0 can have come closer to its members
    assert codes._others_moved(history)[0, 0].tolist() == [pytest.approx(0, abs=1e-6), pytest.approx(5)]


def test_sql(spark):
    assert oracle.difference(spark, oracle.connect(SF), codes.op12_vector_codes, codes.OP12_SQL, SF) is None
