"""Ranking and calibration metrics of predictions (columns y in 0/1 and p)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def roc_auc(df: DataFrame, by: list[str] | None = None, bins: int = 1000) -> DataFrame:
    """auc by the Mann-Whitney statistic with mean ranks for ties; 0.5 with one class.

    Scores are counted by value, values are ranked inside bins of the score, and
    only the bins' totals are summed in one place, so no task orders all rows.
    """
    by = by or []
    values = df.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    values = values.withColumn("bin", F.floor(F.col("p") * bins))
    totals = values.groupBy(*by, "bin").agg(F.sum("neg").alias("bin_neg"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "bin", F.coalesce(F.sum("bin_neg").over(order), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*by, "bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(before, [*by, "bin"])
    won = F.sum(F.col("pos") * (F.col("before") + F.col("below") + 0.5 * F.col("neg")))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, won / pairs).otherwise(0.5).alias("auc"))


def brier() -> Column:
    return F.avg(F.pow(F.col("y") - F.col("p"), 2))


def log_loss(edge: float = 1e-15) -> Column:
    p = F.least(F.greatest("p", F.lit(edge)), F.lit(1 - edge))
    return -F.avg(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))


def accuracy() -> Column:
    return F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))


def scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auc, brier, logloss, acc and n."""
    by = by or []
    rest = df.groupBy(*by).agg(brier().alias("brier"), log_loss().alias("logloss"), accuracy().alias("acc"), F.count("*").alias("n"))
    auc = roc_auc(df, by)
    return rest.join(auc, by) if by else rest.crossJoin(auc)  # one row each


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """mid, frac, n of each bin that has rows; the last one is closed on the right."""
    k = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    return df.groupBy(k.alias("k")).agg(F.avg("y").alias("frac"), F.count("*").alias("n")).select(((F.col("k") + 0.5) / bins).alias("mid"), "frac", "n")


def roc_points(df: DataFrame, steps: int = 200) -> DataFrame:
    """threshold, tpr, fpr at evenly spread thresholds, from counts by step of the score."""
    at = F.floor(F.col("p") * (steps - 1))
    # a score reaches all thresholds i / (steps - 1) up to its own
    at = F.when((at + 1) / (steps - 1) <= F.col("p"), at + 1).when(at / (steps - 1) > F.col("p"), at - 1).otherwise(at)
    by = df.groupBy(at.alias("i")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    all_ = df.sparkSession.range(steps).select(F.col("id").alias("i")).join(by, "i", "left").na.fill(0)
    down = Window.orderBy(F.desc("i"))  # as many rows as steps
    whole = Window.partitionBy(F.lit(0))
    up = lambda c: F.sum(c).over(down) / F.nullif(F.sum(c).over(whole), F.lit(0))
    return all_.select((F.col("i") / (steps - 1)).alias("threshold"), up("pos").alias("tpr"), up("neg").alias("fpr"))


def confidence_accuracy(df: DataFrame, least: int = 10) -> DataFrame:
    """Accuracy by confidence 2|p - 0.5| in nine bins of more than `least` rows; 1.0 falls out."""
    conf = F.greatest("p", 1 - F.col("p"))
    rows = df.select(conf.alias("c"), ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int").alias("ok"))
    k = F.floor((F.col("c") - 0.5) / 0.5 * 9)
    by = rows.filter("c < 1").groupBy(k.alias("bin")).agg(F.avg("ok").alias("acc"), F.count("*").alias("n"))
    return by.filter(F.col("n") > least)


def histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """y, bin, density of the scores by outcome."""
    k = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    by = df.groupBy("y", k.alias("bin")).agg(F.count("*").alias("n"))
    return by.select("y", "bin", (F.col("n") * bins / F.sum("n").over(Window.partitionBy("y"))).alias("density"))


def tier_scores(df: DataFrame, least: int = 50) -> DataFrame:
    return scores(df, ["tier"]).filter(F.col("n") > least).select("tier", "auc", "brier", "n")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds rn (1..) in a total order and n: numbers inside days plus the days' totals."""
    day = df.withColumn("__day", F.to_date("date"))
    days = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as days
    before = day.groupBy("__day").count().select("__day", F.coalesce(F.sum("count").over(days), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__day").orderBy(*order)
    out = day.join(before, "__day").withColumn("rn", F.col("__before") + F.row_number().over(inside))
    n = df.agg(F.count("*").alias("n"))
    return out.drop("__day", "__before").withColumn("n", n.scalar())


def temporal_split(df: DataFrame, order: list[str], train: float = 0.75, hold: float = 0.85) -> DataFrame:
    """Adds part: train, val and test by position in time, cut at int(n * share)."""
    out = numbered(df, order)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * hold)
    return out.withColumn("part", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "val").otherwise("test"))


def event_holdout(df: DataFrame, event: Column, order: list[str]) -> DataFrame:
    """part: train for all rows before the event's first row, test for the event's rows; others go."""
    out = numbered(df, order).withColumn("__event", event)
    first = out.filter("__event").agg(F.min("rn").alias("first"))
    first_rn = first.scalar()
    part = F.when(F.col("rn") < first_rn, "train").when(F.col("__event"), "test")
    return out.withColumn("part", part).filter("part is not null").drop("__event")


def moments(df: DataFrame, columns: list[str], train: Column) -> tuple[dict[str, float], dict[str, float]]:
    """Training mean and population deviation (1 if tiny) of each column."""
    return moments_of(df.filter(train).select(packed(columns)), columns)


def packed(columns: list[str]) -> Column:
    """The columns as one array xs of doubles."""
    return F.array(*(F.col(c).cast("double") for c in columns)).alias("xs")


def moments_of(rows: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """moments() of the array xs in all rows.

    One pass in batches: number, mean and squared deviations of the known values.  A task
    makes three numbers a column, which are merged in one task.
    """
    width = len(columns)
    empty = np.zeros((3, width))

    def of_batch(b) -> np.ndarray:
        values = b.column(0).flatten()
        x = values.to_numpy(zero_copy_only=False).reshape(-1, width)
        known = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
        n = known.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(n > 0, np.where(known, x, 0.0).sum(axis=0) / n, 0.0)
            return np.array([n, mean, np.where(known, (x - mean) ** 2, 0.0).sum(axis=0)])

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            apart = b[1] - a[1]
            both = np.array([n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * (b[0] / n))])
        return np.where(a[0] == 0, b, np.where(b[0] == 0, a, both))

    def add(batches):
        total = empty
        for b in batches:
            if b.num_rows:
                total = merged(total, of_batch(b))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["state"])

    def add_all(batches):
        total = empty
        for b in batches:
            for state in b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 3, width):
                total = merged(total, state)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["state"])

    found = rows.mapInArrow(add, "state array<double>").repartition(1).mapInArrow(add_all, "state array<double>").first()  # one row
    n, mean, squares = np.array(found.state).reshape(3, width).tolist()
    spread = [math.sqrt(q / k) if k else 0.0 for k, q in zip(n, squares)]
    return dict(zip(columns, mean)), {c: s if s >= 1e-8 else 1.0 for c, s in zip(columns, spread)}


def scaled(df: DataFrame, means: dict[str, float], spreads: dict[str, float]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / spreads[c] for c, m in means.items()})


def standardized(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less their training mean over their training population deviation."""
    return scaled(df, *moments(df, columns, train))


def exact_percentiles(df: DataFrame, column: str, shares: list[float], bins: int = 1024) -> list[float | None]:
    """The percentiles of a column's known values, see exact_percentiles_of()."""
    return exact_percentiles_of(df, [column], shares, bins)[column]


def exact_percentiles_of(df: DataFrame, columns: list[str], shares: list[float], bins: int = 1024) -> dict[str, list[float | None]]:
    """The percentiles of each column's known values, interpolated between neighbouring ranks.

    Exact selection by narrowing: each round counts the values of the open ranges in equal
    bins, and goes on with the bins that hold a wanted rank, until their least and greatest
    value are one.  A task holds a row for each open bin; no value but those comes back.
    Nulls and NaN are left out; without values all are None.
    """
    values = _columns(df, columns)
    ranges, places, known = [], {}, {}  # ranges: column, least and greatest value, the rank of the first, ranks in it
    for f, (n, low, high) in _extent(values).items():
        places[f] = [share * (n - 1) for share in shares]
        ranges.append((f, low, high, 0, sorted({math.floor(p) for p in places[f]} | {math.ceil(p) for p in places[f]})))
    while ranges:
        known |= {(f, rank): low for f, low, high, _, ranks in ranges if low == high for rank in ranks}
        ranges = [r for r in ranges if r[1] < r[2]]
        found = _counted(values, [r[:3] for r in ranges], bins)
        narrowed = []
        for (f, _, _, first, ranks), rows in zip(ranges, found):
            for n, low, high in rows:
                inside = [i for i in ranks if first <= i < first + n]
                if inside:
                    narrowed.append((f, low, high, first, inside))
                first += n
        ranges = narrowed
    at = lambda f, p: known[f, math.floor(p)] * (1 - p % 1) + known[f, math.ceil(p)] * (p % 1)
    return {c: [at(f, p) for p in places[f]] if f in places else [None] * len(shares) for f, c in enumerate(columns)}


def few_values(df: DataFrame, columns: list[str], limit: int, bins: int = 1024) -> dict[str, list[float] | None]:
    """For each column all its known values, ascending, or None if they are more than `limit`.

    Ranges with several values are cut into bins until each has one, or there are too many.
    """
    values = _columns(df, columns)
    parts = {f: [(low, high)] for f, (_, low, high) in _extent(values).items()}
    while open_ := [(f, low, high) for f, own in parts.items() if len(own) <= limit for low, high in own if low < high]:
        found = dict(zip(open_, _counted(values, open_, bins)))
        for f in {f for f, _, _ in open_}:
            parts[f] = [y for low, high in parts[f] for y in ([(a, b) for _, a, b in found[f, low, high]] if low < high else [(low, high)])][: limit + 1]
    return {c: [low for low, _ in parts.get(f, [])] if len(parts.get(f, [])) <= limit else None for f, c in enumerate(columns)}


def _columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """xs: the values of the columns in each row, written once."""
    return cut(df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("xs")))


def _extent(rows: DataFrame) -> dict[int, tuple[int, float, float]]:
    values = rows.select(F.posexplode("xs").alias("f", "x")).filter("x IS NOT NULL AND NOT isnan(x)")
    return {r.f: (r.n, r.low, r.high) for r in values.groupBy("f").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}


def _counted(rows: DataFrame, ranges: list[tuple[int, float, float]], bins: int) -> list[list[tuple[int, float, float]]]:
    """For each range (column, least and greatest value) its bins in order: number of
    values, least and greatest.  Ranges of a column have no value in common, so a value's
    range is found by bisection; a task holds three numbers for each bin of a range."""
    if not ranges:
        return []
    given: dict[int, np.ndarray] = {}
    for f in {f for f, _, _ in ranges}:
        # halves of the largest doubles have a finite difference
        own = sorted((low, high, 0.5 if math.isinf(high - low) else 1.0, k) for k, (g, low, high) in enumerate(ranges) if g == f)
        given[f] = np.array(own).T
    size = len(ranges) * bins

    def count(batches):
        n, least, most = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            xs = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for f, (lows, highs, scales, ks) in given.items():
                x = xs[:, f]
                at = np.searchsorted(lows, x, side="right") - 1
                inside = (at >= 0) & (x <= highs[at])  # no null, no NaN
                x, at = x[inside], at[inside]
                s = scales[at]
                with np.errstate(invalid="ignore"):
                    place = np.floor((x * s - lows[at] * s) / (highs[at] * s - lows[at] * s) * bins)
                place = np.clip(np.nan_to_num(place), 0, bins - 1).astype(np.int64) + ks[at].astype(np.int64) * bins
                np.add.at(n, place, 1)
                np.minimum.at(least, place, x)
                np.maximum.at(most, place, x)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (used // bins, used % bins, n[used], least[used], most[used])], names=["k", "bin", "n", "least", "most"])

    by = rows.mapInArrow(count, "k long, bin long, n long, least double, most double").groupBy("k", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    out: list[list] = [[] for _ in ranges]
    for r in by.orderBy("k", "bin").collect():  # `bins` rows for each open range at most
        out[r.k].append((r.n, r.least, r.most))
    return out
