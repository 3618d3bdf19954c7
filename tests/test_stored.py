"""The feature tables' frames: made in batches whatever their bounds, stored by columns, met without an aggregation."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankvane.operators import meta, recent
from rankvane.operators import windows as W
from rankvane.plans import versions
from rankvane.sources.store import FeatureStore

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frames_meet_without_an_aggregation_and_leave_no_more_than_themselves(spark):
    with FeatureStore(spark, "gameid") as store:
        out = versions.joined(*versions.stored_frames(spark, SF, store), 4)
        assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert len(os.listdir(store.folder)) == len(store.names)  # nothing that was kept on the way


def test_a_registered_table_is_read_from_the_stored_frames(spark):
    plan = versions.REGISTRY["features_v1"](spark, SF)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "round(" not in plan


def test_values_are_rounded_as_sql_rounds_them():
    x = np.array([0.0895625, -0.0179375, 2.5e-6, -2.5e-6, 1e300, np.inf, np.nan, 0.1234565])
    import duckdb

    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in x.tolist()]
    assert np.array_equal(versions._rounded(x, 6), np.array(want), equal_nan=True)


def test_rows_of_a_key_become_one_row(spark, small_batches):
    rows = [(k, 10 * k + i, [float(k), float(i), None]) for k in range(40) for i in range(1 + k % 3)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "gameid long, team long, xs array<double>")
    with FeatureStore(spark, "gameid") as store:
        got = {r.gameid: (r.team, r.xs) for r in store.put_lists(df, "xs").collect()}
    assert len(got) == 40
    for k, (team, xs) in got.items():
        assert sorted(team) == [10 * k + i for i in range(1 + k % 3)]
        assert xs == [v for t in team for v in (float(k), float(t - 10 * k), None)]


def test_players_as_windows(spark, small_batches):
    rng = random.Random(5)
    maybe = lambda x, share=0.15: None if rng.random() < share else x
    rows = [(g, 1, rng.choice(["a", "a", "a", "b", "c", f"z{g}"]), "top", dt.datetime(2020, 1, 1 + g // 40), f"c{rng.randrange(9)}", maybe(float(rng.randrange(9))), maybe(float(rng.randrange(3))), maybe(float(rng.randrange(9))), maybe(rng.random()), maybe(rng.randrange(2))) for g in range(800)]
    df = spark.createDataFrame(rows, "gameid long, team long, player string, position string, date timestamp, champ string, kills double, deaths double, assists double, dpm double, result int")
    m = {c: W.rolling_mean(c, ["player"], 10) for c in ("kills", "deaths", "assists")}
    on = ["player", "champ"]
    want = W.first_uses(df, "champ", ["player"]).select(
        "gameid", W.kda(m["kills"], m["deaths"], m["assists"]).alias("kda"), W.hot_streak("result", ["player"]).alias("streak"), W.trajectory("dpm", ["player"]).alias("trajectory"),
        F.coalesce(F.avg("result").over(W.prior(on)), F.lit(0.5)).alias("comfort"), W.game_count(on).alias("on_champ"), F.col("pool_size").alias("pool"), W.game_count(["player"]).alias("experience"),
    ).toPandas()
    got = recent.player_history(df, 2).toPandas()[want.columns]
    got, want = (x.sort_values("gameid").astype(float).reset_index(drop=True) for x in (got, want))
    assert len(got) == 800 and (got.isna() == want.isna()).all().all() and (got - want).abs().max().max() < 1e-9


def test_known_champions_as_running_totals(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(g, dt.datetime(2020, 1, 1 + g // 30, g % 24), s, 2 * g + i, (g + i) % 2, [f"c{rng.randrange(8)}" for _ in range(rng.randrange(1, 4))]) for g in range(120) for i, s in enumerate("ab")]
    df = spark.createDataFrame(rows, "gameid long, date timestamp, slot string, team long, result int, champs array<string>")
    rates = df.select("gameid", "team", F.explode("champs").alias("champ")).join(meta.champion_rates(df), ["gameid", "champ"])
    want = {(r.gameid, r.team): (r.p, r.w) for r in rates.groupBy("gameid", "team").agg(F.avg("pick_rate").alias("p"), F.avg("champ_wr").alias("w")).collect()}
    monkeypatch.setattr(meta, "CELLS", 25)  # two games at a time
    seen, conform = {}, {}
    for g, _, _, team, _, champs in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        conform.setdefault(g, []).append((team, champs))
    best = {}
    for g in sorted(conform, key=lambda g: (rows[2 * g][1], g)):
        top = set(sorted(seen, key=lambda c: (-seen[c][0], seen[c][1]))[:3])
        for team, champs in conform[g]:
            best[g, team] = sum(c in top for c in champs) / len(champs) if top else None
        for c in (c for _, champs in conform[g] for c in champs):
            seen.setdefault(c, [0, len(seen)])[0] += 1
    got = meta.known_champions(df, 3).collect()
    same = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-9)
    assert len(got) == 240
    for r in got:
        key = (r.gameid, r.team)
        assert same(r.avg_pick_rate, want[key][0]) and same(r.avg_champ_wr, want[key][1]) and same(r.meta_conformity, best[key])
