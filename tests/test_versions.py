"""The version tables, attaching by name, models, simulation, sources and the command line."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankvane.operators import elo, metrics, simulation
from rankvane.operators import models as ML
from rankvane.plans import features, versions
from rankvane.sources import adapter as A
from rankvane.sources import logs

SF = "/root/testdata/sf0.001"


def test_sides_are_attached_by_name(spark):
    games = spark.createDataFrame([(1, "x", "y"), (2, "y", "x"), (3, "x", "z")], "gameid long, team_a string, team_b string")
    teams = spark.createDataFrame([(1, "y", 2.0), (1, "x", 1.0), (2, "x", 3.0), (2, "y", 4.0), (3, "x", 5.0)], "gameid long, team string, v double")
    got = {r["gameid"]: (r["v_a"], r["v_b"]) for r in features.attach(games, teams, ["v"]).collect()}
    assert got == {1: (1.0, 2.0), 2: (4.0, 3.0), 3: (5.0, None)}


def test_the_versions_sizes():
    assert {v: len(c) for v, c in versions.VERSIONS.items()} == {1: 59, 2: 79, 3: 106, 4: 130}
    assert set(versions.VERSIONS[3]) < set(versions.VERSIONS[4])


def test_last_version_looks_at_earlier_games_only(spark, tmp_path):
    """Orders from a day on are changed: no feature of an earlier game moves, but for those that are known to look ahead."""
    ahead = {c for c in versions.VERSIONS[4] if c.startswith(("coach_tenure", "region_", "carry_", "team_a_home", "team_b_home", "is_home", "is_trav", "travel"))}
    columns = [c for c in versions.VERSIONS[4] if c not in ahead]
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    cut_at = datetime.datetime(1997, 1, 1)
    late = read("orders").filter(F.col("o_orderdate") >= cut_at).select(F.col("o_orderkey").alias("l_orderkey")).withColumn("late", F.lit(True))
    lines = read("lineitem").join(late, "l_orderkey", "left")
    turned = lines.withColumns({
        "l_extendedprice": F.when(F.col("late"), 200000 - F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")),
        "l_quantity": F.when(F.col("late"), 51 - F.col("l_quantity")).otherwise(F.col("l_quantity")),
    }).drop("late")
    turned.write.parquet(str(tmp_path / "lineitem.parquet"))
    read("orders").write.parquet(str(tmp_path / "orders.parquet"))
    table = lambda sf: versions.features(spark, sf).filter(F.col("date") < cut_at).select("gameid", *(F.round(F.col(c).cast("double"), 9).alias(c) for c in columns))
    a, b = table(SF).toPandas(), table(str(tmp_path)).toPandas()
    a, b = (x.sort_values("gameid").fillna(-99).reset_index(drop=True) for x in (a, b))
    assert len(a) > 300 and a.equals(b)


def test_one_scan_and_one_shuffle_of_the_lines(spark):
    for table in (A.games(spark, SF), A.team_games(spark, SF, True, True), A.player_games(spark, SF)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2  # lines and orders
        assert plan.count("Exchange hashpartitioning(l_orderkey") + plan.count("Exchange hashpartitioning(gameid") <= 2


def rows(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))).astype(int)
    data = [(int(i), datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=int(i)), *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "gameid long, date timestamp, u double, v double, w double, result int"), x, y


def test_logistic_regression_as_newtons_method(spark):
    df, x, y = rows(spark)
    model = ML.logistic().fit(ML.matrix(df, ["u", "v", "w"]))
    w = np.zeros(4)
    wide, ridge = np.c_[x, np.ones(len(x))], np.diag([0.01, 0.01, 0.01, 0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-wide @ w))
        w -= np.linalg.solve((wide.T * (p * (1 - p))) @ wide / len(y) + ridge, wide.T @ (p - y) / len(y) + ridge @ w)
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=2e-3)


def test_all_models_beat_chance(spark):
    df, _, _ = rows(spark, 900)
    split = metrics.temporal_split(df.withColumns({"elo_expected": F.lit(0.5)}), ["date", "gameid"])
    m = ML.matrix(split, ["u", "v", "w"]).cache()
    train, test = m.filter("part = 'train'"), m.filter("part = 'test'")
    got = {r["model"]: r["auc"] for r in ML.compared(train, test, {"lr": ML.logistic(), "gbdt": ML.boosted(maxIter=10), "rf": ML.forest(numTrees=10), "tree": ML.tree(), "mlp": ML.perceptron(3)}).collect()}
    assert len(got) == 5 and min(got.values()) > 0.7
    both = ML.compare_versions(df.withColumn("elo_expected", F.lit(0.5)), {"V1": ["u"], "V2": ["u", "v", "w"]}, trees=5).collect()
    assert {(r["version"], r["model"]) for r in both} == {("-", "rating"), ("V1", "lr"), ("V1", "gbdt"), ("V1", "sgd"), ("V2", "lr"), ("V2", "gbdt"), ("V2", "sgd")}
    top = [r for r in both if r["best"]]
    assert len(top) == 1 and top[0]["auc"] == max(r["auc"] for r in both) and top[0]["version"] == "V2"


def test_versions_of_other_games_are_refused(spark):
    df, _, _ = rows(spark, 20)
    ML.aligned({"V1": df, "V2": df.select("gameid")})
    with pytest.raises(ValueError):
        ML.aligned({"V1": df, "V2": df.filter("gameid > 3")})


def test_a_model_comes_back_as_it_was_saved(spark, tmp_path):
    df, _, _ = rows(spark, 300)
    m = ML.matrix(df, ["u", "v"])
    model = ML.logistic().fit(m)
    ML.save(model, str(tmp_path), ["u", "v"], {"u": 0.5, "v": 0.0}, {"u": 2.0, "v": 1.0})
    back, names, means, spreads = ML.load(str(tmp_path))
    assert (names, means, spreads) == (["u", "v"], {"u": 0.5, "v": 0.0}, {"u": 2.0, "v": 1.0})
    assert back.coefficients == model.coefficients


def test_fixtures_are_found_turned_and_judged(spark):
    day = datetime.datetime(2026, 3, 1)
    games = spark.createDataFrame(
        [(1, day - datetime.timedelta(days=40), "A", "B", 9.0), (2, day + datetime.timedelta(hours=30), "B", "A", -2.0), (3, day + datetime.timedelta(hours=40), "A", "B", 5.0)], "gameid long, date timestamp, team_a string, team_b string, elo_diff double"
    )
    series = simulation.fixtures(spark, [("final", day, "A", "B", 3, 1), ("semi", day, "A", "C", 0, 3)])
    got = {r["stage"]: (r["gameid"], r["elo_diff"]) for r in simulation.found_games(series, games, ["elo_diff"]).collect()}
    assert got == {"final": (2, 2.0), "semi": (None, None)}  # the swapped game is the first in the band
    data = [(float(x), int(x > 0)) for x in range(-20, 21) if x]
    model = ML.logistic().fit(ML.matrix(spark.createDataFrame(data, "elo_diff double, result int"), ["elo_diff"]))
    done = {r["stage"]: r for r in simulation.simulate(series, games, model, ["elo_diff"]).collect()}
    assert done["final"]["p"] > 0.5 and done["final"]["right"] and done["semi"]["p"] == 0.5 and not done["semi"]["right"]


def test_pools_and_ratings_as_a_plain_loop(spark):
    rng = random.Random(2)
    rows_ = []
    for i in range(300):
        group = rng.choice([0, 10, 20])
        a, b = rng.sample(range(group, group + 5), 2)
        rows_.append((i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=3 * i), a, b, rng.randint(0, 1), rng.randint(1, 3)))
    games = spark.createDataFrame(rows_, "gameid long, date timestamp, team_a long, team_b long, result int, tier int")
    assert {(r["team_a"] // 10 * 10, r["pool"]) for r in elo.with_pools(games).collect()} == {(0, 0), (10, 10), (20, 20)}
    ratings, year, want = {}, 2024, {}
    for i, date, a, b, result, tier in rows_:
        if date.year != year:
            ratings, year = {t: 1500 + 0.75 * (r - 1500) for t, r in ratings.items()}, date.year
        x, y = ratings.get(a, 1500.0), ratings.get(b, 1500.0)
        e = 1 / (1 + 10 ** ((y - x) / 400))
        want[i] = x - y
        k = 32 * (0.5 + 0.5 * tier / 3)
        ratings[a], ratings[b] = x + k * (result - e), y + k * (e - result)
    got = {r["gameid"]: r["elo_diff"] for r in elo.elo(games).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)




def fetch(offset, limit):
    return [f'{{"row": {k}}}' for k in range(offset, min(offset + limit, 25))]


def test_pages_become_rows(spark):
    spark.dataSource.register(logs.PagedSource)
    df = spark.read.format("paged").options(module="tests.test_versions", function="fetch", pages="3", page_rows="10").load()
    assert sorted(r["json"] for r in df.collect()) == sorted(fetch(0, 25))


def test_a_failed_page_is_asked_for_again(monkeypatch):
    import sys

    tries = []

    def flaky(offset, limit):
        tries.append(offset)
        if len(tries) < 3:
            raise OSError("busy")
        return ["{}"]

    monkeypatch.setattr(sys.modules[__name__], "fetch", flaky)
    reader = logs.PagedReader({"module": __name__, "function": "fetch", "wait": "0.01"})
    assert list(reader.read(reader.partitions()[0])) == [(0, "{}")] and len(tries) == 3


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    logs.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema("k int, s string").json(str(tmp_path / "j")).collect())) == [(1, "a"), (2, None)]


def test_stored_frames_meet_without_an_exchange(spark):
    import os

    from rankvane.plans import versions
    from rankvane.sources.store import FeatureStore

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with FeatureStore(spark, "gameid") as store:
            out = versions.joined(*versions.stored_frames(spark, "/root/testdata/sf0.001", store), 4)
            assert len(store.names) == 13 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == spark.table(store.names[0]).count() > 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not os.path.exists(store.folder) and not any(t.name in store.names for t in spark.catalog.listTables())
