"""Operators that must stay linear where one key holds all rows, against plain loops."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankvane.operators import elo, intervals, metrics
from rankvane.operators import windows as W

DAY = dt.date(2020, 1, 1)


def successors(joins, open_):
    out = []
    for team, person, rank, start in open_:
        later = [d for t, p, r, d in joins if t == team and p != person and r >= rank and d > start]
        out.append((team, person, rank, start, min(later, default=dt.date(2100, 1, 1))))
    return sorted(out)


@pytest.mark.parametrize("seed, people", [(0, 2), (1, 3), (2, 12)])
def test_successors_as_all_pairs(spark, seed, people):
    rng = random.Random(seed)
    joins = [(f"t{rng.randrange(3)}", f"p{rng.randrange(people)}", rng.randint(1, 3), DAY + dt.timedelta(rng.randrange(60))) for _ in range(150)]
    open_ = sorted({(f"t{rng.randrange(3)}", f"p{rng.randrange(people)}", rng.randint(1, 3), DAY + dt.timedelta(rng.randrange(-2, 62))) for _ in range(80)})
    events = spark.createDataFrame([(*j, "Join") for j in joins], "team string, person string, rank int, day date, direction string")
    given = spark.createDataFrame([(*o, dt.date(2100, 1, 1)) for o in open_] + [("t0", "x", 1, DAY, DAY)], "team string, person string, rank int, start date, end date")
    got = sorted((r.team, r.person, r["rank"], r.start, r.end) for r in intervals.close_open(given, events).collect())
    assert got == sorted([*successors(joins, open_), ("t0", "x", 1, DAY, DAY)])


def test_successors_of_one_team_with_100000_events(spark):
    days = spark.range(100_000).select(
        F.lit("t").alias("team"), F.concat(F.lit("p"), F.col("id") % 7).alias("person"), (F.col("id") % 2 + 1).cast("int").alias("rank"),
        F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("day"), F.lit("Join").alias("direction"),
    )
    given = days.select("team", "person", "rank", F.col("day").alias("start"), F.lit("2100-01-01").cast("date").alias("end"))
    began = time.time()
    out = intervals.close_open(given, days)
    assert "Join" not in str(out._jdf.queryExecution().executedPlan()).replace("direction", "").replace("= Join", "").replace("(Join", "").split("Scan")[0]
    assert out.filter("end < '2100-01-01'").count() > 99_990 and out.count() == 100_000
    assert time.time() - began < 60


def test_first_in_band_as_all_pairs(spark):
    rng = random.Random(3)
    at = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 120))
    facts = [(rng.choice("ab"), i, at()) for i in range(120)]
    probes = [(rng.choice("abc"), 1000 + i, at()) for i in range(120)]
    f = spark.createDataFrame(facts, "k string, id long, time timestamp")
    p = spark.createDataFrame(probes, "k string, probe long, at timestamp")
    got = {r.probe: r.id for r in W.first_in_band(p, f, ["k"], "at", "time", ["id"], 5 * 86_400, 6 * 86_400).collect()}
    want = {}
    for k, probe, t in probes:
        inside = [(s, i) for q, i, s in facts if q == k and -5 <= (s - t).total_seconds() // 86_400 <= 5]
        want[probe] = min(inside)[1] if inside else None
    assert got == want and None in got.values() and len(set(got.values())) > 10


def test_a_band_that_holds_all_games_of_a_pair(spark):
    games = spark.range(100_000).select(F.lit(1).alias("k"), "id", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 20).alias("time"))
    began = time.time()
    out = W.first_in_band(games.select("k", F.col("id").alias("probe"), F.col("time").alias("at")), games, ["k"], "at", "time", ["id"], 30 * 86_400, 31 * 86_400)
    wrong = out.filter(F.col("id") != F.greatest(F.lit(0), F.col("probe") - 30 * 86_400 // 20)).count()
    assert wrong == 0 and out.count() == 100_000 and time.time() - began < 60


def series(rows):
    out = {}
    for g, k, t, num, won, picks in rows:
        past = sorted((t2, g2, n2, w2) for g2, k2, t2, n2, w2, _ in rows if k2 == k and (t2, g2) < (t, g) and n2 is not None and num is not None and n2 < num)
        made = [c for g2, k2, t2, _, _, ps in rows if k2 == k and (t2, g2) < (t, g) for c in ps or []]
        a = sum(w for *_, w in past)
        n = len(past)
        out[g] = (n, 2 * a - n, int(n > 0 and 2 * a == n), 0 if not n else 1 if past[-1][3] == 1 else -1, int(len(made) > 5 and not set(made) & set(picks or [])))
    return out


def test_series_state_and_picks_as_lists(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice("ab"), dt.datetime(2020, 1, 1 + rng.randrange(20)), rng.choice([None, 0, 1, 2, 3, 5, 9, 100]), rng.randrange(2), rng.choice([None, [], [f"c{rng.randrange(60)}" for _ in range(3)]])) for g in range(160)]
    df = spark.createDataFrame(rows, "gameid long, k string, date timestamp, game_num int, result int, picks array<string>")
    state = {r.gameid: (r.series_games_played, r.series_score_diff, r.is_elimination, r.series_momentum_a) for r in W.series_state(df, ["k"]).collect()}
    flag = {r.gameid: r.is_fearless for r in W.fearless(df, ["k"]).collect()}
    assert {g: (*state[g], flag[g]) for g in state} == series(rows) and len(state) == len(flag) == len(rows)
    assert 0 < sum(flag.values()) < len(rows)


def test_a_series_of_50000_games(spark):
    df = spark.range(50_000).select(
        F.col("id").alias("gameid"), F.lit("s").alias("k"), F.timestamp_seconds(F.col("id")).alias("date"), (F.col("id") + 1).cast("int").alias("game_num"),
        (F.col("id") % 2).cast("int").alias("result"), F.array(F.concat(F.lit("c"), F.col("id"))).alias("picks"),
    )
    state = W.series_state(df, ["k"])
    assert "collect_list" not in state._jdf.queryExecution().toString()
    assert state.filter("series_games_played <> gameid OR is_elimination <> cast(gameid > 0 AND gameid % 2 = 0 AS int)").count() == 0
    assert W.fearless(df, ["k"]).filter("is_fearless = 1").count() == 50_000 - 6


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "tiny", "one"])
def test_percentiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(0, 1, 5000),
        "ties": rng.integers(0, 4, 3000).astype(float),
        "wide": np.concatenate([rng.normal(0, 1, 500), [1.7e308, -1.7e308, 1e300, 5e-324, 0.0]]),
        "tiny": np.array([5e-324, 1e-323, 1.5e-323, 0.0]),
        "one": np.array([3.5]),
    }[kind]
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = metrics.exact_percentiles(df, "x", shares, bins=16)
    s = np.sort(x)
    at = [q * (len(s) - 1) for q in shares]
    assert got == [s[int(np.floor(p))] * (1 - p % 1) + s[int(np.ceil(p))] * (p % 1) for p in at]


def test_percentiles_without_values(spark):
    assert metrics.exact_percentiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_the_side_win_rate_holds_no_lists(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice("ab"), dt.datetime(2020, 1, 1 + rng.randrange(20)), rng.choice(["A", "N", "R", None] if g % 3 else ["A"]), rng.randrange(2)) for g in range(400)]
    df = spark.createDataFrame(rows, "gameid long, team string, date timestamp, side string, result int")
    made = W.with_side_win_rate(df, ["team"])
    assert "collect_list" not in made._jdf.queryExecution().toString()
    both = made.withColumn("listed", W.side_win_rate(["team"]))
    assert both.filter("NOT side_wr <=> listed").count() == 0 and both.filter("side_wr NOT IN (0, 0.5, 1)").count() > 200


def test_a_large_pool_is_sorted_in_ranges(spark, monkeypatch):
    rng = random.Random(12)
    start = dt.datetime(2019, 11, 1)
    rows = [(i, start + dt.timedelta(days=rng.randrange(200)), *rng.sample(range(8), 2), rng.randrange(2), rng.randrange(1, 4)) for i in range(900)]
    rows += [(1000 + i, start + dt.timedelta(days=i), 20, 21, i % 2, 1) for i in range(20)]
    games = spark.createDataFrame(rows, "gameid long, date timestamp, team_a long, team_b long, result int, tier int")
    whole = sorted(map(tuple, elo.elo(games).collect()))
    monkeypatch.setattr(elo, "POOL_GAMES", 100)
    got = elo.elo(games)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" in plan and plan.count("Sort [") == 1  # the small pool's task sorts, the large one's reads sorted ranges
    assert sorted(map(tuple, got.collect())) == whole and len(whole) == 920


def test_ranges_are_counted_without_a_row_for_each_range_and_value(spark):
    # a value was compared with all open ranges of its column, joined to it
    df = spark.range(1000).select(F.array(F.col("id").cast("double"), F.lit(None).cast("double")).alias("xs"))
    ranges, joins, plain = [(0, 10.0 * i, 10.0 * i + 4) for i in range(50)], [], type(df).join
    try:
        type(df).join = lambda *a, **k: joins.append(1) or plain(*a, **k)
        got = metrics._counted(df, [*ranges, (1, 0.0, 1.0)], 4)
    finally:
        type(df).join = plain
    assert not joins and got[-1] == []
    assert got[:50] == [[(1, x, x) for x in (low, low + 1, low + 2)] + [(2, low + 3, low + 4)] for _, low, _ in ranges]
