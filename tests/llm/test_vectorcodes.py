"""Vector codes against a plain loop over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from rankvane.llm import vectorcodes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=4):
    """rows: (vec_id, vector, label) that are kept."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vs = [[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    w = len(vs[0]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in vs[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((far(cut(v, p), c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        got = [[best(v, p)[1] for p in range(4)] for v in vs]
        for p in range(4):
            for k in range(len(books[p])):
                own = [cut(v, p) for v, g in zip(vs, got) if g[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    out = [(r[0], "".join(f"{best(v, p)[1]:02x}" for p in range(4)), sum(best(v, p)[0] for p in range(4)), r[2]) for r, v in zip(rows, vs)]
    sums = {}
    for *_, e, label in out:
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((i, c, e, sums[label], digest) for i, c, e, label in out)


def result(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n, dim, spread", [(700, 8, 1.0), (300, 12, 40.0), (40, 4, 0.01)])
def test_as_a_plain_loop(spark, n, dim, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, dim)], [None, 1, 2, 3][i % 4]) for i in rng.permutation(n)]
    rows[5] = (rows[5][0], rows[6][1], rows[5][2])  # ties
    odd = [(n + 1, None, 1), (-1, [None] * dim, 1), (-2, [float("nan")] * dim, 1), (-3, [float("inf")] + [0.0] * (dim - 1), None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    assert result(V.compress_vectors(df)) == plain(rows)


def test_large_components_and_other_lengths(spark):
    rows = [(1, [1e30, -1e30, 0.0, 0.0], 1), (2, [100.0, 0.0, 0.0, 1.0], 1), (3, [1.0, 2.0, 3.0], None), (4, [], None), (5, [0.0] * 4, None)]
    got = {r.vec_id: r for r in V.compress_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[3].code is got[4].code is got[3].error is None
    assert [got[i].code for i in (1, 2, 5)] == ["00000000", "01010001", "02000000"] or got[1].error == 0
    assert V.integers(np.array([1e30, -1e30]), 4).tolist() == [V.bound_of(4), -V.bound_of(4)]


def test_many_labels_meet_by_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 4)], i % 50 if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = result(V.compress_vectors(df))
    monkeypatch.setattr(V, "FEW_LABELS", 0)
    by_shuffle = V.compress_vectors(df)
    assert "BroadcastHashJoin" not in by_shuffle._jdf.queryExecution().executedPlan().toString()
    assert result(by_shuffle) == want == plain(rows)


def test_empty(spark):
    assert V.compress_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.compress_vectors(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []


def test_nearest_takes_the_lower_of_equal_entries():
    code, error = V.nearest(np.array([[0, 5, 2**26]], np.int32), np.array([[4, 6, -4, 6]]))
    assert code.tolist() == [0, 0, 1] and error.tolist() == [16, 1, (2**26 - 6) ** 2]
