"""Games are gathered once for what is made of them, by tasks that don't grow with the tables."""

from pyspark.sql import functions as F

from rankvane.operators import meta
from rankvane.plans import evalqueries, features, matchqueries
from rankvane.sources import adapter

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_that_gather_lines_grow_with_the_file(spark, monkeypatch):
    few = adapter.line_parts(spark, SF)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(adapter, "PART_BYTES", 10_000)
    assert adapter.line_parts(spark, SF) > few
    for df, key in ((adapter.games(spark, SF), "gameid"), (features.core(spark, SF), "team"), (matchqueries.player_aggregates(spark, SF), "player")):
        assert f"hashpartitioning({key}" in plan(df) and f", {adapter.line_parts(spark, SF)})" in plan(df)


def test_games_and_ratings_are_made_once(spark):
    assert "FileScan" not in plan(matchqueries.elo_ratings(spark, SF))
    made = evalqueries.predictions(spark, SF)
    assert "MapInArrow" not in plan(made) and "FileScan" not in plan(made)
    assert plan(evalqueries.composite_strength(spark, SF)).count("FileScan") == 0


def test_picks_are_written_where_they_are_read_twice_only(spark):
    sides = adapter.team_games(spark, SF, True)
    assert "Generate explode" in plan(meta.picks_of(sides)) and meta.champion_rates(sides).select(F.count("*")).first()[0] > 0
