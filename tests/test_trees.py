"""Trees grown by levels against a plain recursive search over rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankvane.operators import metrics, trees

COLUMNS = ["a", "b", "c", "d"]


def data(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(4)), round(rng.random(), 2)
        y = int(rng.random() < 1 / (1 + math.exp(-(1.5 * a + (b - 1.5) * (c - 0.5) * 4))))
        rows.append((i, y, a, b, c, 0.0 if i % 5 else None))
    return rows


def percentile(xs, q):
    s, at = sorted(xs), q * (len(xs) - 1)
    return s[math.floor(at)] * (1 - at % 1) + s[math.ceil(at)] * (at % 1)


def plain_cuts(rows):
    out = []
    for k in range(2, 6):
        xs = [round(r[k] or 0.0, 6) + 0.0 for r in rows]
        out.append(sorted(set(xs)) if len(set(xs)) <= 20 else sorted({percentile(xs, q) for q in trees.SHARES}))
    return out


def plain(rows, cuts, depth, min_leaf, at=1):
    """rows: (features, target); {node: (feature, threshold, rows, value)}."""
    n, s = len(rows), sum(t for _, t in rows)
    gini = lambda s, n: 2 * (s / n) * (1 - s / n)
    best = (0, None, None)
    if depth and n >= 10 and len({t for _, t in rows}) > 1:
        for f, ts in enumerate(cuts):
            for t in ts:
                left = [y for x, y in rows if x[f] <= t]
                if min(len(left), n - len(left)) < min_leaf:
                    continue
                gain = round(gini(s, n) - (len(left) * gini(sum(left), len(left)) + (n - len(left)) * gini(s - sum(left), n - len(left))) / n, 10)
                if gain > best[0]:
                    best = (gain, f, t)
    if best[1] is None:
        return {at: (None, None, n, s / n)}
    _, f, t = best
    low, high = [r for r in rows if r[0][f] <= t], [r for r in rows if r[0][f] > t]
    return {at: (f, t, n, s / n)} | plain(low, cuts, depth - 1, min_leaf, 2 * at) | plain(high, cuts, depth - 1, min_leaf, 2 * at + 1)


def leaf(tree, x, at=1):
    while tree[at][0] is not None:
        at = 2 * at + (x[tree[at][0]] > tree[at][1])
    return tree[at][3]


def ready(spark, rows):
    df = trees.prepared(spark.createDataFrame(rows, "gameid long, y int, a double, b double, c double, d double").repartition(3), COLUMNS)
    cuts = trees.cuts_of(df, COLUMNS)
    return df, cuts, trees.binned(df, COLUMNS, cuts)


def same(nodes, want):
    got = {r.node: r for r in nodes}
    assert sorted(got) == sorted(want)
    for k, (f, t, n, v) in want.items():
        assert got[k].feature == (None if f is None else COLUMNS[f]) and got[k].threshold == t and got[k]["rows"] == n and got[k].value == pytest.approx(v, abs=1e-8)


@pytest.mark.parametrize("seed, depth, min_leaf", [(0, 4, 15), (1, 2, 40), (2, 6, 5)])
def test_a_tree_as_by_a_search(spark, seed, depth, min_leaf):
    rows = data(seed)
    df, cuts, b = ready(spark, rows)
    assert cuts == plain_cuts(rows)
    tree = trees.grow(b.select("bins", F.col("y").cast("double").alias("target"), F.lit(1).alias("w")), list(map(len, cuts)), depth, 10, min_leaf)
    x = lambda r: [round(v or 0.0, 6) + 0.0 for v in r[2:]]
    same(trees.table_of(spark, [tree], COLUMNS, cuts).collect(), plain([(x(r), r[1]) for r in rows], cuts, depth, min_leaf))


def test_boosting_as_by_a_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "STRETCH", 2)
    rows = data(3, 400)
    df, cuts, b = ready(spark, rows)
    start, made = trees.boost(b, list(map(len, cuts)), rounds=4, depth=3)
    x = [[round(v or 0.0, 6) + 0.0 for v in r[2:]] for r in rows]
    p = sum(r[1] for r in rows) / len(rows)
    assert start == pytest.approx(math.log(p / (1 - p)))
    score = [start] * len(rows)
    nodes = trees.table_of(spark, made, COLUMNS, cuts)
    for k in range(4):
        kept = [i for i, r in enumerate(rows) if (r[0] * 7919 + k * 104_729) % 1_000_003 % 1000 < 800]
        target = [r[1] - 1 / (1 + math.exp(-s)) for r, s in zip(rows, score)]
        tree = plain([(x[i], target[i]) for i in kept], cuts, 3, 15)
        same(nodes.filter(F.col("tree") == k).collect(), tree)
        score = [s + 0.1 * leaf(tree, v) for s, v in zip(score, x)]
    trees.save(nodes, f"{tmp_path}/model")
    again = trees.scored(df, trees.load(spark, f"{tmp_path}/model"))
    got = {r.gameid: r.p for r in again.select("gameid", trees.boosted_probability("value", start).alias("p")).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx([1 / (1 + math.exp(-s)) for s in score], abs=1e-8)
    auc = metrics.roc_auc(again.select("y", trees.boosted_probability("value", start).alias("p"))).first()["auc"]
    assert auc > 0.7


def test_a_forest_tells_the_classes_apart(spark):
    rows = data(4, 500)
    df, cuts, b = ready(spark, rows)
    made = trees.forest(b, list(map(len, cuts)), trees=6, depth=5)
    nodes = trees.table_of(spark, made, COLUMNS, cuts)
    roots = [t[1] for t in made]
    assert len({r.rows for r in roots}) > 1 and all(400 < r.rows < 600 for r in roots)
    mean = trees.scored(df, nodes).select("y", (F.aggregate("value", F.lit(0.0), lambda a, v: a + v) / 6).alias("p"))
    assert metrics.roc_auc(mean).first()["auc"] > 0.75
    assert sum(r.share for r in trees.split_shares(nodes).collect()) == pytest.approx(1)


def test_odd_tables(spark):
    one = [(i, 1, float(i), 0.0, 0.0, None) for i in range(40)]
    df, cuts, b = ready(spark, one)
    start, made = trees.boost(b, list(map(len, cuts)), rounds=2)
    assert start == math.inf and made == []
    tree = trees.grow(b.select("bins", F.lit(1.0).alias("target"), F.lit(1).alias("w")), list(map(len, cuts)))
    assert list(tree) == [1] and tree[1].value == 1.0 and tree[1].rows == 40
    empty = b.limit(0)
    assert trees.boost(empty, [1, 1, 1, 1], rounds=2) == (0.0, [])


def test_few_values(spark):
    df = spark.createDataFrame([(1.0, 0.0, float(i), None) for i in range(30)] + [(1.0 + 2**-52, -1e308, 0.0, None), (3.0, 1e308, 0.0, float("nan"))], "a double, b double, c double, d double")
    assert metrics.few_values(df, COLUMNS, 20, bins=8) == {"a": [1.0, 1.0 + 2**-52, 3.0], "b": [-1e308, 0.0, 1e308], "c": None, "d": []}
