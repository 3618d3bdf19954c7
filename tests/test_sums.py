"""Weighted win rates are added up one by one, as SQL does: a compensated sum rounds apart in the sixth digit."""

from rankvane.operators import recent
from rankvane.operators import windows as W

GAMES = [(1, 3), (0, 2), (1, 2), (1, 2), (0, 3), (1, 2), (1, 2), (0, 1), (1, 2), (1, 2), (1, 2), (0, 3), (1, 2), (0, 2)]


def test_weighted_win_rates_are_the_windows_to_the_last_bit(spark):
    kind = "gameid long, team long, date timestamp, side string, result int, game_num int, champs array<string>, opp_bans array<string>, roster array<string>, u double"
    rows = [(i, 1, None, "A", r, n, ["c"], ["c"], ["p"], 0.0) for i, (r, n) in enumerate(GAMES)]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    got = {r.gameid: r.wwr for r in recent.team_history(df, {10: ("u",)}).collect()}
    want = {r.gameid: r.wwr for r in df.select("gameid", W.weighted_win_rate(["team"]).alias("wwr")).collect()}
    assert got == want
