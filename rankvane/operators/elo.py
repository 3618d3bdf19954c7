"""Elo ratings: the one feature that is a recurrence over all games in order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut

START, K, SCALE, CARRY = 1500.0, 32.0, 400.0, 0.75
#: games of a pool that its own task sorts, and those that a task sorts of a larger pool
POOL_GAMES = 1_000_000


def with_pools(games: DataFrame, team_a: str = "team_a", team_b: str = "team_b") -> DataFrame:
    """Adds pool: the smallest team of each set of teams that are linked by games.

    Works on the distinct pairs of teams, in rounds of least labels and jumps that are
    each checkpointed; ratings of different pools never meet.
    """
    pairs = games.select(F.col(team_a).alias("a"), F.col(team_b).alias("b")).distinct()
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("team")).agg(F.min("b").alias("pool")).select("team", F.least("team", "pool").alias("pool"))
    while True:
        near = both.join(label, both["b"] == label["team"]).groupBy("a").agg(F.min("pool").alias("near"))
        low = label.join(near, label["team"] == near["a"]).select("team", "pool", F.least("pool", "near").alias("low"))
        jump = label.select(F.col("team").alias("low"), F.col("pool").alias("next"))
        new = cut(low.join(jump, "low").select("team", F.least("low", "next").alias("new"), "pool"))
        label = new.select("team", F.col("new").alias("pool"))
        if new.filter("new != pool").isEmpty():
            return games.join(label.withColumnRenamed("team", team_a), team_a)


def elo(games: DataFrame, tier: str = "tier") -> DataFrame:
    """gameid, elo_a, elo_b (before the game), elo_diff, elo_expected.

    `games` has gameid, date, team_a, team_b, result and the league tier (1..3),
    which scales K.  When the year changes in order, all ratings seen so far move
    a quarter of the way back to the start.  Year changes are found on the whole
    order first, so pools can be folded apart; a pool streams through its task in
    order and only its teams' ratings are held.  A pool of more than POOL_GAMES games
    is sorted by other tasks in ranges of time, which its task reads one after another.
    """
    # written once: years, pairs and the fold are made of it, whatever the games are made of
    games = cut(games.select("gameid", "date", F.year("date").alias("year"), "team_a", "team_b", F.col("result").cast("int").alias("result"), F.col(tier).cast("int").alias("tier")))
    # a season for each year that has games anywhere
    years = games.select("year").distinct()
    seasons = years.select("year", F.dense_rank().over(Window.orderBy("year")).alias("season"))
    tasks = max(int(games.sparkSession.conf.get("spark.sql.shuffle.partitions")), games.rdd.getNumPartitions())
    pooled = with_pools(games).join(seasons, "year").select("gameid", "date", "pool", "season", "team_a", "team_b", "result", "tier")
    large = []
    if games.count() > POOL_GAMES:
        pooled = cut(pooled)
        large = pooled.groupBy("pool").count().filter(F.col("count") > POOL_GAMES).collect()  # a row for each POOL_GAMES games at most
    small = pooled.filter(~F.col("pool").isin([r.pool for r in large])) if large else pooled
    ordered = [small.repartition(tasks, "pool").sortWithinPartitions("pool", "date", "gameid")]
    for r in large:
        ranges = math.ceil(4 * r["count"] / POOL_GAMES)
        own = pooled.filter(F.col("pool") == r.pool).repartitionByRange(ranges, "date", "gameid").sortWithinPartitions("date", "gameid")
        ordered.append(cut(own).coalesce(1))  # the ranges in order

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings: dict = {}
        pool, season, last = None, None, None
        for batch in batches:
            if batch.num_rows:
                # a task has pools one after another: only games of the same one are in order
                pools = np.concatenate([[pool if pool is not None else batch.column(1)[0].as_py()], batch.column(1).to_numpy()])
                times = batch.column(7).cast(pa.int64()).to_numpy()
                times = np.concatenate([[times[0] if last is None else last], times])
                if ((pools[1:] == pools[:-1]) & (times[1:] < times[:-1])).any():
                    raise RuntimeError(f"games of pool {pool} are not in order of time")
                last = times[-1]
            before_a, before_b, shares = [], [], []
            for own, turn, team_a, team_b, result, strength in zip(*(c.to_pylist() for c in batch.columns[1:7])):
                if own != pool:
                    pool, season, ratings = own, turn, {}
                while season < turn:  # one step back for each year that has games anywhere
                    ratings = {t: START + CARRY * (r - START) for t, r in ratings.items()}
                    season += 1
                a, b = ratings.get(team_a, START), ratings.get(team_b, START)
                expected = 1 / (1 + 10 ** ((b - a) / SCALE))
                k = K * (0.5 + 0.5 * strength / 3)
                before_a.append(a)
                before_b.append(b)
                shares.append(expected)
                ratings[team_a] = a + k * (result - expected)
                ratings[team_b] = b + k * ((1 - result) - (1 - expected))
            a, b = pa.array(before_a, pa.float64()), pa.array(before_b, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), a, b, pc.subtract(a, b), pa.array(shares, pa.float64())], names=["gameid", "elo_a", "elo_b", "elo_diff", "elo_expected"])

    columns = ("gameid", "pool", "season", "team_a", "team_b", "result", "tier", "date")
    made = "gameid long, elo_a double, elo_b double, elo_diff double, elo_expected double"
    return reduce(DataFrame.union, (o.select(*columns).mapInArrow(fold, made) for o in ordered))
