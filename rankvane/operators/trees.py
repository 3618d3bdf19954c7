"""Decision trees grown level by level, boosted trees and forests, with models as tables.

Features are replaced once by the number of their bin among fixed cuts.  A level of a tree
is then one aggregation by (node, feature, bin), whose size depends on the tree and the
features alone; rows never move, as their node follows from their bins.  Sums of targets
are sums of integers, so a tree doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import matrix_value
from ..sources.store import cut
from . import metrics

#: candidate cuts of a feature with many values: percentiles from the 5th to the 95th
CUTS = 20
SHARES = [(5 + 90 * i / (CUTS - 1)) / 100 for i in range(CUTS)]
#: targets are added up in units of this part of one
UNIT = 1 << 30
#: digits of a gain that count; of equal gains the first feature and the least cut win
DIGITS = 10
#: rounds of boosting between checkpoints
STRETCH = 10


@dataclass
class Node:
    node: int  # 1 is the root; 2k and 2k + 1 are below k
    rows: float
    value: float
    feature: int | None = None
    bin: int | None = None


Tree = dict[int, Node]


def cuts_of(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """For each column its candidate cuts, ascending: all its values if they are no more
    than 20, else 20 percentiles without repeats."""
    few = metrics.few_values(df, columns, CUTS)
    many = [c for c in columns if few[c] is None]
    found = metrics.exact_percentiles_of(df, many, SHARES) if many else {}
    return [sorted(set(few[c] if few[c] is not None else found[c])) for c in columns]


def prepared(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """df with its features as a model reads them: unknown values 0, rounded."""
    return df.withColumns({c: F.round(matrix_value(F.col(c)), digits) + F.lit(0.0) for c in columns})


def binned(df: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """df with bins: for each feature how many of its cuts are smaller."""
    ladders = F.lit([[float(x) for x in c] for c in cuts]) if all(cuts) else None
    if ladders is None:
        raise ValueError("a feature without known values has no cuts")
    values = F.array(*(F.col(c).cast("double") for c in columns))
    below = lambda x, i: F.size(F.filter(F.element_at(ladders, i + 1), lambda t: t < x))
    return df.withColumn("bins", F.transform(values, below))


def walk(tree: Tree, leaf, goes_left, at: int = 1) -> Column:
    """An expression that follows a row from the root to what `leaf` makes of its node."""
    node = tree[at]
    if node.feature is None:
        return leaf(node)
    return F.when(goes_left(node), walk(tree, leaf, goes_left, 2 * at)).otherwise(walk(tree, leaf, goes_left, 2 * at + 1))


def by_bins(node: Node) -> Column:
    return F.col("bins")[node.feature] <= node.bin


def _impurity(total: Column, rows: Column) -> Column:
    share = total / rows
    return 2 * share * (1 - share)


def level_splits(rows: DataFrame, tree: Tree, open_: list[int], cuts: list[int], min_leaf: int, allowed: dict[int, list[int]] | None = None) -> DataFrame:
    """(node, rows, value, one: whether its targets are all equal, best: struct of gain,
    feature, bin and both sides' rows and values) for the open nodes of a tree."""
    node = walk(tree, lambda n: F.lit(n.node if n.node in open_ else 0), by_bins)
    target = F.floor(F.col("target") * UNIT + 0.5)
    long_ = rows.select(node.alias("node"), "w", target.alias("t"), F.posexplode("bins").alias("f", "bin")).filter("node > 0 AND w > 0")
    sums = long_.groupBy("node", "f", "bin").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("t")).alias("s"), F.min("t").alias("low"), F.max("t").alias("high"))
    order = Window.partitionBy("node", "f").orderBy("bin")
    whole = Window.partitionBy("node", "f")
    left = sums.select(
        "node", "f", "bin",
        F.sum("n").over(order).alias("nl"), (F.sum("s").over(order) / UNIT).alias("sl"),
        F.sum("n").over(whole).alias("n"), (F.sum("s").over(whole) / UNIT).alias("s"),
        (F.min("low").over(whole) == F.max("high").over(whole)).alias("one"),
    )
    n, s, nl, sl = (F.col(c) for c in ("n", "s", "nl", "sl"))
    nr, sr = n - nl, s - sl
    gain = _impurity(s, n) - (nl * _impurity(sl, nl) + nr * _impurity(sr, nr)) / n
    fits = (nl >= min_leaf) & (nr >= min_leaf) & (F.col("bin") < F.element_at(F.lit(cuts), F.col("f") + 1))
    if allowed is not None:
        fits &= F.array_contains(F.element_at(F.create_map(*(x for k, fs in allowed.items() for x in (F.lit(k), F.lit(fs)))), F.col("node")), F.col("f"))
    gain = F.round(F.when(fits & (nr > 0), gain), DIGITS)
    best = F.struct(gain.alias("gain"), F.col("f").alias("feature"), "bin", nl.alias("left_rows"), (sl / nl).alias("left_value"), nr.alias("right_rows"), F.when(nr > 0, sr / nr).alias("right_value"))
    rank = F.struct(F.coalesce(gain, F.lit(-1.0)), -F.col("f"), -F.col("bin"))
    return left.groupBy("node").agg(F.max("n").alias("rows"), F.max(s / n).alias("value"), F.max("one").alias("one"), F.max_by(best, rank).alias("best"))


def grow(rows: DataFrame, cuts: list[int], depth: int = 4, min_split: int = 10, min_leaf: int = 15, features: int | None = None, seed: int = 0) -> Tree:
    """A tree on `rows` (bins, target, w: a whole weight; 0 leaves the row out) by greatest
    loss of impurity 2m(1 - m), m the mean target; a leaf's value is its mean.

    A node stays a leaf at the depth, under `min_split` rows, with equal targets, or if no
    split with `min_leaf` rows on both sides gains.  `features` of all are tried in each
    node, drawn by the seed.  What comes to the driver is one row for each open node.
    """
    tree: Tree = {1: Node(1, 0, 0.5)}
    open_ = [1]
    for level in range(depth + 1):
        allowed = None
        if features is not None:
            allowed = {k: sorted(random.Random(f"{seed}:{k}").sample(range(len(cuts)), min(features, len(cuts)))) for k in open_}
        found = {r.node: r for r in level_splits(rows, tree, open_, cuts, min_leaf, allowed).collect()} if open_ else {}
        following = []
        for k, r in found.items():
            tree[k].rows, tree[k].value = r.rows, r.value
            b = r.best
            if level == depth or r.rows < min_split or r.one or b.gain is None or b.gain <= 0:
                continue
            tree[k].feature, tree[k].bin = b.feature, b.bin
            tree[2 * k] = Node(2 * k, b.left_rows, b.left_value)
            tree[2 * k + 1] = Node(2 * k + 1, b.right_rows, b.right_value)
            following += [2 * k, 2 * k + 1]
        open_ = sorted(following) if level + 1 < depth else []
        if not open_:
            break
    return tree


def _draw(id_: Column, salt: int) -> Column:
    """A number from 0 to 999 that follows from the row's id and a salt."""
    return F.pmod(id_.cast("long") * 7919 + F.lit(salt * 104_729), F.lit(1_000_003)) % 1000


def boost(rows: DataFrame, cuts: list[int], rounds: int = 100, rate: float = 0.1, subsample: float = 0.8, id_: str = "gameid", **options) -> tuple[float, list[Tree]]:
    """(log-odds of the label y, trees): each tree is grown on what the sum so far gets
    wrong, y - p, over a share of the rows drawn by their ids, and adds its leaves' means
    times the rate.  One class alone has no trees."""
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or ones in (0, n):
        return (0.0 if not n else math.copysign(math.inf, ones - 0.5)), []
    start = math.log(ones / n / (1 - ones / n + 1e-15))
    state, trees = rows.select(id_, "y", "bins").withColumn("__f", F.lit(start)), []
    for k in range(rounds):
        p = 1 / (1 + F.exp(-F.col("__f")))
        weight = F.when(_draw(F.col(id_), k) < int(subsample * 1000), 1).otherwise(0)
        tree = grow(state.select("bins", (F.col("y") - p).alias("target"), weight.alias("w")), cuts, **options)
        trees.append(tree)
        state = state.withColumn("__f", F.col("__f") + rate * walk(tree, lambda x: F.lit(float(x.value)), by_bins))
        if k % STRETCH == STRETCH - 1 and k + 1 < rounds:
            state = cut(state)
    return start, trees


def forest(rows: DataFrame, cuts: list[int], trees: int = 60, depth: int = 8, min_leaf: int = 5, id_: str = "gameid") -> list[Tree]:
    """Trees on rows that are drawn with replacement (each counts as often as a Poisson
    number of mean 1 says that follows from its id), the root of all features in each node."""
    levels, total, term = [], 0.0, math.exp(-1)
    for k in range(1, 8):
        total, term = total + term, term / k
        levels.append(int(1000 * total))
    few = max(1, math.isqrt(len(cuts)))
    out = []
    for k in range(trees):
        draw = _draw(F.col(id_), 1000 + k)
        weight = sum((F.when(draw >= x, 1).otherwise(0) for x in levels[1:]), F.when(draw >= levels[0], 1).otherwise(0))
        out.append(grow(rows.select("bins", F.col("y").cast("double").alias("target"), weight.alias("w")), cuts, depth=depth, min_leaf=min_leaf, features=few, seed=k))
    return out


# ---- models as tables

NODES = "tree int, node int, feature string, threshold double, rows double, value double"


def table_of(spark: SparkSession, trees: list[Tree], columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """One row for each node: rows go to 2 * node if feature <= threshold, else to
    2 * node + 1; a leaf has neither."""
    rows = [
        (k, n.node, None if n.feature is None else columns[n.feature], None if n.feature is None else float(cuts[n.feature][n.bin]), float(n.rows), float(n.value))
        for k, tree in enumerate(trees)
        for n in tree.values()
    ]
    return spark.createDataFrame(rows, NODES)


def save(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def scored(df: DataFrame, nodes: DataFrame, name: str = "value") -> DataFrame:
    """df with the array `name`: the leaf value of each tree of a table_of(), in order."""
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.collect():  # as many rows as the model has nodes
        trees.setdefault(r.tree, {})[r.node] = r
    left = lambda r: F.col(f"`{r.feature}`") <= r.threshold
    return df.withColumn(name, F.array(*(walk(trees[k], lambda r: F.lit(r.value), left) for k in sorted(trees))))


def boosted_probability(values: str, start: float, rate: float = 0.1) -> Column:
    total = F.aggregate(values, F.lit(float(start)), lambda a, x: a + rate * x)
    return 1 / (1 + F.exp(-total))


def split_shares(nodes: DataFrame) -> DataFrame:
    """(feature, share): how many of a model's splits are on each feature that has any."""
    splits = nodes.filter("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("n"))
    return splits.select("feature", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))  # as many rows as features
