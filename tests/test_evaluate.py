"""The command line end to end, and versions with tables of their own."""

import pytest
from pyspark.sql import functions as F

from rankvane import evaluate
from rankvane.operators import models as ML

SF = "/root/testdata/sf0.001"


def test_only_games_of_all_tables_count(spark):
    a = spark.range(40).select(F.col("id").alias("gameid"), F.timestamp_seconds("id").alias("date"), (F.col("id") % 2).cast("int").alias("result"), (F.col("id") % 2 + 0.0).alias("u"), F.lit(0.5).alias("elo_expected"))
    b = a.filter("gameid % 5 > 0").select("gameid", "date", "result", "elo_expected", (F.col("u") * 2).alias("v")).union(a.limit(1).select(F.lit(99).alias("gameid"), "date", "result", "elo_expected", "u"))
    both = ML.common_games({"V1": a, "V2": b})
    ids = [sorted(r.gameid for r in t.collect()) for t in both.values()]
    assert ids[0] == ids[1] == [k for k in range(40) if k % 5]
    got = ML.compare_versions({"V1": a, "V2": b}, {"V1": ["u"], "V2": ["v"]}, trees=2).collect()
    assert {r["n"] for r in got} == {5} and {r["version"] for r in got} == {"-", "V1", "V2"}
    alone = ML.compare_versions({"V1": a}, {"V1": ["u"]}, trees=2).collect()
    assert {r["n"] for r in alone} == {6}


def test_shares_are_those_of_the_trees(spark):
    df = spark.range(400).select(F.col("id").alias("gameid"), (F.col("id") % 4 > 1).cast("int").alias("result"), (F.col("id") % 4).cast("double").alias("u"), F.rand(3).alias("v"))
    model = ML.boosted(maxIter=4).fit(ML.matrix(df, ["u", "v"]))
    share = ML.split_importance(model, ["u", "v"])
    inner = sum((t.numNodes - 1) // 2 for t in model.trees)
    assert sum(share.values()) == pytest.approx(1) and share["u"] * inner == pytest.approx(round(share["u"] * inner)) and share["u"] > 0


def test_main(spark, tmp_path):
    out, saved = str(tmp_path / "out"), str(tmp_path / "model")
    evaluate.main(["--data-dir", SF, "--out-dir", out, "--versions", "V1", "V2", "--trees", "2", "--model-dir", saved])
    found = spark.read.option("header", True).csv(f"{out}/model_comparison").collect()
    assert {(r.version, r.model) for r in found} == {("-", "rating")} | {(v, m) for v in ("V1", "V2") for m in ("lr", "gbdt", "sgd")}
    assert len({r.n for r in found}) == 1
    assert sorted(map(str, spark.read.json(f"{out}/model_comparison_json").columns)) == sorted(map(str, spark.read.option("header", True).csv(f"{out}/model_comparison").columns))
    assert spark.read.option("header", True).csv(f"{out}/feature_importance").count() == 30
    _, names, means, spreads = ML.load(saved)
    assert names == evaluate.NAMES["V2"] and set(means) == set(spreads) == set(names)
    evaluate.main(["--data-dir", SF, "--out-dir", out, "--holdout", "2-HIGH", "1997", "--versions", "V1", "--trees", "2"])
    scored = spark.read.option("header", True).csv(f"{out}/predictions_2-HIGH_1997").collect()
    assert scored and all(r.league == "2-HIGH" and 0 <= float(r.p_team_a_lr) <= 1 and 0 <= float(r.p_team_a_gbdt) <= 1 for r in scored)
