"""The core feature table: two sides' point-in-time features, joined and subtracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import windows as W
from ..sources import adapter as A

STATS = ("kills", "deaths", "gold", "dragons", "towers", "golddiffat15")
CORE = [
    "wr_diff_5", "wr_diff_10", "wr_diff_20", "wr_diff_all", "wr_a_10", "wr_b_10", "n_games_diff", "side_known_diff", "h2h_a", "game_number", "is_playoffs",
    *(f"avg10_{s}_diff" for s in STATS), *(f"avg20_{s}_diff" for s in ("kills", "deaths", "dragons", "towers")), "kda_ratio_diff", "dragon_control_diff", "tower_control_diff",
]


def side_features(team_games: DataFrame) -> DataFrame:
    """One row a side; every window has the same partitioning and order, so one sort serves all."""
    made = {f"wr_{n}": W.win_rate(["team"], n) for n in (5, 10, 20)} | {"wr_all": W.win_rate(["team"])}
    made |= {"n_games": W.game_count(["team"]), "side_known": F.count("golddiffat15").over(W.prior(["team"], 30))}
    made |= {f"avg10_{s}": W.rolling_mean(s, ["team"], 10) for s in (*STATS, "opp_dragons", "opp_towers")}
    made |= {f"avg20_{s}": W.rolling_mean(s, ["team"], 20) for s in ("kills", "deaths", "dragons", "towers")}
    t = team_games.select("gameid", "date", "slot", "team", "opp", "result", "game_num", "playoffs", *(c.alias(n) for n, c in made.items()))
    t = t.withColumn("h2h", W.win_rate(["team", "opp"], 10))
    return t.withColumns({
        "kda_ratio": W.kda(F.col("avg10_kills"), F.col("avg10_deaths")),
        "dragon_control": S.control_share(F.col("avg10_dragons"), F.col("avg10_opp_dragons")),
        "tower_control": S.control_share(F.col("avg10_towers"), F.col("avg10_opp_towers")),
    })


def pair(sides: DataFrame) -> DataFrame:
    """One row a game: differences of a's and b's features; both sides meet in one shuffle by game."""
    keys = ("gameid", "date", "slot", "opp", "game_num", "playoffs")
    values = [c for c in sides.columns if c not in keys]
    pick = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c))).alias(f"{c}_{slot}")
    g = sides.groupBy("gameid").agg(F.min("date").alias("date"), F.max("game_num").alias("game_number"), F.max("playoffs").alias("is_playoffs"), *(pick(s, c) for c in values for s in "ab"))
    diff = lambda c: F.col(f"{c}_a") - F.col(f"{c}_b")
    named = {f"wr_diff_{n}": diff(f"wr_{n}") for n in (5, 10, 20, "all")}
    named |= {f"{c}_diff": diff(c) for c in values if c.startswith("avg") and "opp_" not in c}
    named |= {f"{c}_diff": diff(c) for c in ("kda_ratio", "dragon_control", "tower_control", "n_games", "side_known")}
    named |= {"wr_a_10": F.col("wr_10_a"), "wr_b_10": F.col("wr_10_b"), "h2h_a": F.col("h2h_a")}
    return g.select("gameid", "date", "team_a", "team_b", F.col("result_a").alias("result"), "n_games_a", "n_games_b", "game_number", "is_playoffs", *(c.alias(n) for n, c in named.items()))


def attach(games: DataFrame, per_team: DataFrame, columns: list[str]) -> DataFrame:
    """games with {column}_a and {column}_b: the values of per_team (gameid, team, columns) of the
    game's team_a and team_b, found by the team's name; null for a team that has no row."""
    row = F.struct(*columns)
    of = per_team.groupBy("gameid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("team").alias("k"), row.alias("v")))).alias("__teams"))  # the teams of one game
    out = games.join(of, "gameid", "left")
    out = out.withColumns({f"__{s}": F.try_element_at("__teams", F.col(f"team_{s}")) for s in "ab"})
    return out.select(*games.columns, *(F.col(f"__{s}")[c].alias(f"{c}_{s}") for c in columns for s in "ab"))


def core(spark, sf) -> DataFrame:
    return of_games(A.games(spark, sf), A.line_parts(spark, sf))


def of_games(games: DataFrame, parts: int) -> DataFrame:
    """The core features of games, whose sides are dealt by team to `parts` tasks."""
    return pair(side_features(A.sides_of(games).repartition(parts, "team")))


def _over(keys: str, n) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY date, gameid ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _side_sql() -> str:
    cols = [f"coalesce(avg(result) {_over('team', n)}, 0.5) AS wr_{name}" for n, name in ((5, 5), (10, 10), (20, 20), (30, "all"))]
    cols += [f"count(*) {_over('team', 'UNBOUNDED')} AS n_games", f"count(golddiffat15) {_over('team', 30)} AS side_known", f"coalesce(avg(result) {_over('team, opp', 10)}, 0.5) AS h2h"]
    cols += [f"avg({s}) {_over('team', 10)} AS avg10_{s}" for s in (*STATS, "opp_dragons", "opp_towers")]
    cols += [f"avg({s}) {_over('team', 20)} AS avg20_{s}" for s in ("kills", "deaths", "dragons", "towers")]
    share = lambda a: f"CASE WHEN avg10_{a} IS NOT NULL AND avg10_opp_{a} IS NOT NULL THEN avg10_{a} / greatest(avg10_{a} + avg10_opp_{a}, 0.5) END"
    return f"""
, w AS (SELECT gameid, date, slot, team, game_num, playoffs, {", ".join(cols)} FROM team_rows),
siderow AS (SELECT *, CASE WHEN avg10_deaths IS NOT NULL THEN avg10_kills / greatest(CASE WHEN avg10_deaths = 0 THEN 1.0 ELSE avg10_deaths END, 0.5) END AS kda_ratio,
  {share("dragons")} AS dragon_control, {share("towers")} AS tower_control FROM w)
"""


def _pair_sql() -> str:
    diffs = [f"a.wr_{n} - b.wr_{n} AS wr_diff_{n}" for n in (5, 10, 20, "all")]
    names = [*(f"avg10_{s}" for s in STATS), *(f"avg20_{s}" for s in ("kills", "deaths", "dragons", "towers")), "kda_ratio", "dragon_control", "tower_control", "n_games", "side_known"]
    diffs += [f"a.{c} - b.{c} AS {c}_diff" for c in names]
    return f""", pairrow AS (SELECT a.gameid, a.n_games AS n_games_a, b.n_games AS n_games_b, a.wr_10 AS wr_a_10, b.wr_10 AS wr_b_10, a.h2h AS h2h_a,
  a.game_num AS game_number, a.playoffs AS is_playoffs, {", ".join(diffs)} FROM siderow a JOIN siderow b ON a.gameid = b.gameid AND a.slot = 'a' AND b.slot = 'b')
"""


SIDE_SQL, PAIR_SQL = _side_sql(), _pair_sql()
