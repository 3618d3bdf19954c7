"""The one pass along a team's games gives what the windows give, and holds the last games only."""

import datetime as dt
import random

from rankvane.operators import meta, recent
from rankvane.operators import windows as W
from rankvane.plans import versions
from rankvane.sources.store import cut


def sides(spark, games=900):
    rng = random.Random(11)
    maybe = lambda x, share=0.1: None if rng.random() < share else x
    champs = lambda: [f"c{rng.randrange(12)}" for _ in range(rng.randrange(4))]
    rows = [
        (g, rng.choice([1, 1, 1, 2, 3, 4 + g]), dt.datetime(2020, 1, 1 + g // 40), rng.choice(["A", "N", None]), rng.randrange(2), rng.randint(1, 3), champs(), champs(), sorted(set(champs())), maybe(rng.random() * 1e5), maybe(float(rng.randrange(50))))
        for g in range(games)
    ]
    return spark.createDataFrame(rows, "gameid long, team long, date timestamp, side string, result int, game_num int, champs array<string>, opp_bans array<string>, roster array<string>, u double, v double")


def test_one_pass_as_windows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = cut(sides(spark).repartition(3))
        got = recent.team_history(df, {10: ("u", "v"), 20: ("v",)}).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = {"n_games": W.game_count(["team"])} | {f"wr_{n}": W.win_rate(["team"], n) for n in (5, 10, 20)} | {"wr_all": W.win_rate(["team"])}
    made |= {"champ_div": W.distinct_recent("champs", ["team"]), "wwr": W.weighted_win_rate(["team"])} | W.roster_change(["team"]) | {"side_wr": W.side_win_rate(["team"])}
    made |= {"team_champ_comfort": meta.team_comfort(), "ban_target": meta.ban_target()}
    made |= {f"avg{n}_{s}": W.rolling_mean(s, ["team"], n) for n, s in ((10, "u"), (10, "v"), (20, "v"))}
    want = df.select("gameid", "team", *(c.alias(n) for n, c in made.items())).drop("subs_out").toPandas()
    assert set(got.columns) == set(want.columns)
    got, want = (x[sorted(want.columns)].sort_values("gameid").astype(float).fillna(-1).reset_index(drop=True) for x in (got, want))
    assert len(got) == 900 and (got - want).abs().max().max() < 1e-9


def test_the_team_frame_holds_no_lists(spark):
    A = versions.A
    made = versions._by_team(cut(A.team_games(spark, "/root/testdata/sf0.001", True, True)))
    plan = made._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan
