"""A game's features depend on earlier games only."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rankvane.operators import elo, meta
from rankvane.operators import windows as W


def schedule(seed=7, flip=(), games=120):
    rng = random.Random(seed)
    out = []
    for i in range(games):
        a, b = rng.sample(range(4), 2)
        picks = [[f"c{c}" for c in rng.sample(range(15), 5)] for _ in range(2)]
        bans = [[f"c{c}" for c in rng.sample(range(15), 5)] for _ in range(2)]
        won = rng.randint(0, 1) ^ (i in flip)
        date = datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=6 * i)
        patch = f"16.{1 + i // 30:02d}"
        for slot, team, opp, res, p, own, his in (("a", a, b, won, picks[0], bans[0], bans[1]), ("b", b, a, 1 - won, picks[1], bans[1], bans[0])):
            out.append((i, date, patch, slot, team, opp, res, 1 + i % 3, "Blue" if slot == "a" else "Red", float(rng.randint(1, 30)) if False else float(10 + res * 5), p, own, his))
    return out


SCHEMA = "gameid long, date timestamp, patch string, slot string, team long, opp long, result int, game_num int, side string, kills double, champs array<string>, bans array<string>, opp_bans array<string>"


def features(spark, rows):
    t = spark.createDataFrame(rows, SCHEMA)
    made = {
        "wr": W.win_rate(["team"], 10),
        "wwr": W.weighted_win_rate(["team"]),
        "side": W.side_win_rate(["team"]),
        "h2h": W.win_rate(["team", "opp"], 10),
        "mean": W.rolling_mean("kills", ["team"], 10),
        "streak": W.hot_streak("result", ["team"]),
        "comfort": meta.team_comfort(),
        "target": meta.ban_target(),
        "pool": W.distinct_recent("champs", ["team"]),
    }
    base = t.select("gameid", "team", *(c.alias(n) for n, c in made.items()))
    games = t.groupBy("gameid").agg(F.min("date").alias("date"), F.max(F.when(F.col("slot") == "a", F.col("team"))).alias("team_a"), F.max(F.when(F.col("slot") == "b", F.col("team"))).alias("team_b"),
        F.max(F.when(F.col("slot") == "a", F.col("result"))).alias("result")).withColumn("tier", F.lit(3))
    out = base.join(elo.elo(games).select("gameid", "elo_diff"), "gameid")
    out = out.join(meta.team_patch(t), ["gameid", "team"]).join(meta.side_champion_rates(t), ["gameid", "team"])
    return out.join(meta.meta_conformity(t), ["gameid", "team"]).orderBy("gameid", "team").toPandas().round(9)


@pytest.fixture(scope="module")
def plain(spark):
    return features(spark, schedule())


def same(a, b):
    return a.fillna(-1).reset_index(drop=True).equals(b.fillna(-1).reset_index(drop=True))


@pytest.mark.parametrize("game", [5, 40, 119])
def test_own_result_does_not_matter(spark, plain, game):
    flipped = features(spark, schedule(flip={game}))
    assert same(plain[plain.gameid == game], flipped[flipped.gameid == game])


def test_future_results_do_not_matter_and_past_ones_do(spark, plain):
    ahead = features(spark, schedule(flip=set(range(60, 120))))
    assert same(plain[plain.gameid <= 60], ahead[ahead.gameid <= 60])
    past = features(spark, schedule(flip=set(range(60))))
    a, b = plain[plain.gameid >= 60].fillna(-1), past[past.gameid >= 60].fillna(-1)
    assert (a.values != b.values).any(axis=1).sum() > 30


def test_first_game_has_no_history(plain):
    first = plain[plain.gameid == 0]
    assert (first.team_patch_games == 0).all() and first.patch_wr_delta.isna().all() and first.avg_champ_wr.isna().all()
    assert (first.wr == 0.5).all() and first["mean"].isna().all()


def test_frames_never_reach_the_current_row():
    with pytest.raises(ValueError):
        W.prior(["team"], 5, skip=-1)
