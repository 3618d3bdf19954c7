"""Registered queries over the match tables: windows, ratings, patches, dimensions, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dims, elo, intervals, meta, recent
from ..operators import windows as W
from ..sources import adapter as A
from ..sources.store import cut

REGISTRY: dict = {}
SQL: dict[str, str] = {}

TIER_SQL = "CASE league WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END"
PRIOR = "OVER (PARTITION BY {k} ORDER BY date, gameid ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def over(keys: str, n="UNBOUNDED") -> str:
    return PRIOR.format(k=keys, n=n)


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = (A.BASE_SQL if base else "") + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long, for comparison with SQL."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(F.round(c, digits).alias(name) if kind == "double" else c.cast("long").alias(name) if kind in ("int", "bigint", "smallint") else c)
    return df.select(*out)


def tier(df: DataFrame) -> DataFrame:
    return df.withColumn("tier", F.when(F.col("league") == "1-URGENT", 3).when(F.col("league") == "2-HIGH", 2).otherwise(1))


# ---- pairing and joins

@query("SELECT gameid, date, league, team_a, team_b, result::BIGINT AS result, patch FROM games")
def pair_games(spark, sf):
    return rounded(A.games(spark, sf).select("gameid", "date", "league", "team_a", "team_b", "result", "patch"))


@query("SELECT gameid, count(*)::BIGINT AS sides, sum(result)::BIGINT AS wins FROM team_rows GROUP BY gameid HAVING count(*) = 2")
def exact_two_sides(spark, sf):
    by = A.team_games(spark, sf).groupBy("gameid").agg(F.count("*").alias("sides"), F.sum("result").alias("wins"))
    return by.filter("sides = 2")


@query("SELECT gameid, team, array_to_string(roster, ',') AS roster, array_to_string(champs, ',') AS champs, len(bans)::BIGINT AS n_bans FROM team_games")
def roster_join(spark, sf):
    t = A.team_games(spark, sf, True)
    return rounded(t.select("gameid", "team", F.concat_ws(",", "roster").alias("roster"), F.concat_ws(",", "champs").alias("champs"), F.size("bans").alias("n_bans")))


@query(f"""
SELECT gameid, team, round(avg(kills) {over('team', 10)}, 6) AS avg10_kills, round(avg(deaths) {over('team', 10)}, 6) AS avg10_deaths,
  round(avg(gold) {over('team', 10)}, 6) AS avg10_gold, round(avg(golddiffat15) {over('team', 10)}, 6) AS avg10_golddiffat15,
  round(avg(kills) {over('team', 20)}, 6) AS avg20_kills, round(avg(golddiffat15) {over('team', 20)}, 6) AS avg20_golddiffat15 FROM team_rows""")
def rolling_mean_10_20(spark, sf):
    t = A.team_games(spark, sf)
    made = {f"avg{n}_{c}": W.rolling_mean(c, ["team"], n) for n, cs in ((10, ("kills", "deaths", "gold", "golddiffat15")), (20, ("kills", "golddiffat15"))) for c in cs}
    return rounded(t.select("gameid", "team", *(c.alias(n) for n, c in made.items())))


@query(f"""
SELECT gameid, team, round(coalesce(avg(result) {over('team', 5)}, 0.5), 6) AS wr_5, round(coalesce(avg(result) {over('team', 10)}, 0.5), 6) AS wr_10,
  round(coalesce(avg(result) {over('team', 20)}, 0.5), 6) AS wr_20, round(coalesce(avg(result) {over('team', 30)}, 0.5), 6) AS wr_all,
  count(*) {over('team')} AS n_games FROM team_rows""")
def win_rates(spark, sf):
    t = A.team_games(spark, sf)
    made = {"wr_5": 5, "wr_10": 10, "wr_20": 20, "wr_all": None}
    return rounded(t.select("gameid", "team", *(W.win_rate(["team"], n).alias(c) for c, n in made.items()), W.game_count(["team"]).alias("n_games")))


def _weighted(pairing: str) -> str:
    return f"""
, w AS (SELECT gameid, team, list(result) {over('team', 10)} AS r,
  list(CASE game_num WHEN 1 THEN 1.0 WHEN 2 THEN 1.3 ELSE 1.5 END::DOUBLE) {over('team', 10)} AS g FROM team_rows)
SELECT gameid, team, round(CASE WHEN r IS NULL THEN 0.5 ELSE list_sum(list_transform(range(1, len(r) + 1), lambda i: {pairing} * g[i])) / list_sum(g) END, 6) AS wwr FROM w"""


@query(_weighted("r[len(r) + 1 - i]"))
def weighted_wr(spark, sf):
    return rounded(A.team_games(spark, sf).select("gameid", "team", W.weighted_win_rate(["team"]).alias("wwr")))


@query(_weighted("r[i]"))
def weighted_wr_clean(spark, sf):
    return rounded(A.team_games(spark, sf).select("gameid", "team", W.weighted_win_rate(["team"], aligned=True).alias("wwr")))


@query(f"""
, p AS (SELECT gameid, team, side, list({{'s': side, 'r': result}}) {over('team', 60)} AS past FROM team_rows),
q AS (SELECT gameid, team, list_filter(coalesce(past, []), lambda x: x.s = side) AS own FROM p)
SELECT gameid, team, round(CASE WHEN len(own) = 0 THEN 0.5 ELSE list_avg(list_transform(own[greatest(len(own) - 29, 1):], lambda x: x.r)) END, 6) AS side_wr FROM q""")
def side_wr(spark, sf):
    return rounded(W.with_side_win_rate(A.team_games(spark, sf).select("gameid", "date", "team", "side", "result"), ["team"]).select("gameid", "team", "side_wr"))


@query(f"SELECT gameid, team, opp, round(coalesce(avg(result) {over('team, opp', 10)}, 0.5), 6) AS h2h_wr FROM team_rows")
def h2h_wr(spark, sf):
    return rounded(A.team_games(spark, sf).select("gameid", "team", "opp", W.win_rate(["team", "opp"], 10).alias("h2h_wr")))


@query(f"SELECT gameid, team, len(list_distinct(flatten(coalesce(list(champs) {over('team', 20)}, []))))::BIGINT AS champ_diversity FROM team_games")
def champ_diversity(spark, sf):
    return rounded(A.team_games(spark, sf, True).select("gameid", "team", W.distinct_recent("champs", ["team"]).alias("champ_diversity")))


@query("""
, l AS (SELECT gameid, team, roster, lag(roster) OVER (PARTITION BY team ORDER BY date, gameid) AS prev FROM team_games),
k AS (SELECT *, coalesce(len(prev), 0) > 0 AND len(roster) > 0 AS known FROM l)
SELECT gameid, team, round(CASE WHEN known THEN len(list_intersect(roster, prev)) / greatest(len(roster), 1) ELSE 0.5 END, 6) AS roster_overlap,
  CASE WHEN known THEN len(list_filter(roster, lambda x: NOT list_contains(prev, x))) ELSE 0 END::BIGINT AS subs_in,
  CASE WHEN known THEN len(list_filter(prev, lambda x: NOT list_contains(roster, x))) ELSE 0 END::BIGINT AS subs_out FROM k""")
def roster_overlap_subs(spark, sf):
    t = A.team_games(spark, sf, True)
    return rounded(t.select("gameid", "team", *(c.alias(n) for n, c in W.roster_change(["team"]).items())))


KDA_SQL = "(k + a) / greatest(CASE WHEN d = 0 THEN 1.0 ELSE d END, 0.5)"


@query(f"""
, m AS (SELECT gameid, player, avg(kills) {over('player', 10)} AS k, avg(deaths) {over('player', 10)} AS d, avg(assists) {over('player', 10)} AS a FROM player_games)
SELECT gameid, player, round(CASE WHEN d IS NOT NULL THEN {KDA_SQL} END, 6) AS kda FROM m""")
def player_kda(spark, sf):
    m = {c: W.rolling_mean(c, ["player"], 10) for c in ("kills", "deaths", "assists")}
    p = A.player_games(spark, sf).select("gameid", "player", *(c.alias(n) for n, c in m.items()))
    return rounded(p.select("gameid", "player", W.kda(F.col("kills"), F.col("deaths"), F.col("assists")).alias("kda")))


@query(f"SELECT gameid, player, round(CASE WHEN count(result) {over('player', 15)} >= 3 THEN avg(result) {over('player', 3)} - avg(result) {over('player', 15)} ELSE 0.0 END, 6) AS streak FROM player_games")
def hot_streak(spark, sf):
    return rounded(A.player_games(spark, sf).select("gameid", "player", W.hot_streak("result", ["player"]).alias("streak")))


@query(f"""
, t AS (SELECT gameid, player, count(dpm) {over('player', 30)} AS n, avg(dpm) {over('player', 5)} AS now,
  avg(dpm) OVER (PARTITION BY player ORDER BY date, gameid ROWS BETWEEN 20 PRECEDING AND 6 PRECEDING) AS past FROM player_games)
SELECT gameid, player, round(CASE WHEN n >= 7 AND now IS NOT NULL AND abs(past) >= 1e-6 THEN (now - past) / (abs(past) + 1e-6) ELSE 0.0 END, 6) AS trajectory FROM t""")
def trajectory(spark, sf):
    return rounded(A.player_games(spark, sf).select("gameid", "player", W.trajectory("dpm", ["player"]).alias("trajectory")))


@query(f"SELECT gameid, player, champ, round(coalesce(avg(result) {over('player, champ')}, 0.5), 6) AS comfort, count(*) {over('player, champ')} AS games FROM player_games")
def champ_comfort(spark, sf):
    keys = ["player", "champ"]
    p = A.player_games(spark, sf)
    return rounded(p.select("gameid", "player", "champ", F.coalesce(F.avg("result").over(W.prior(keys)), F.lit(0.5)).alias("comfort"), W.game_count(keys).alias("games")))


@query(f"SELECT gameid, player, count(DISTINCT champ) {over('player')} AS pool_size, count(*) {over('player')} AS experience FROM player_games")
def pool_experience(spark, sf):
    p = W.first_uses(A.player_games(spark, sf), "champ", ["player"])
    return rounded(p.select("gameid", "player", "pool_size", W.game_count(["player"]).alias("experience")))


PLAYERS_SQL = f"""
, pfirst AS (SELECT *, row_number() OVER (PARTITION BY player, champ ORDER BY date, gameid) = 1 AS fresh FROM player_games),
pstate AS (
  SELECT gameid, team, position, avg(kills) {over('player', 10)} AS k, avg(deaths) {over('player', 10)} AS d, avg(assists) {over('player', 10)} AS a,
    CASE WHEN count(result) {over('player', 15)} >= 3 THEN avg(result) {over('player', 3)} - avg(result) {over('player', 15)} ELSE 0.0 END AS streak,
    count(dpm) {over('player', 30)} AS n30, avg(dpm) {over('player', 5)} AS now, avg(dpm) OVER (PARTITION BY player ORDER BY date, gameid ROWS BETWEEN 20 PRECEDING AND 6 PRECEDING) AS past,
    coalesce(avg(result) {over('player, champ')}, 0.5) AS comfort, count(*) {over('player, champ')} AS on_champ,
    coalesce(sum(fresh::INT) {over('player')}, 0) AS pool, count(*) {over('player')} AS experience FROM pfirst
), pvalues AS (
  SELECT *, CASE WHEN d IS NOT NULL THEN {KDA_SQL} END AS kda, CASE WHEN n30 >= 7 AND now IS NOT NULL AND abs(past) >= 1e-6 THEN (now - past) / (abs(past) + 1e-6) ELSE 0.0 END AS trajectory,
    list_position(['top', 'jng', 'mid', 'bot', 'sup'], position) AS place FROM pstate
), pside AS (
  SELECT gameid, team, avg(kda) AS avg_player_kda, avg(streak) AS avg_player_streak, avg(trajectory) AS avg_player_trajectory, avg(comfort) AS avg_champ_comfort, avg(on_champ) AS avg_champ_games,
    avg(pool) AS avg_player_pool, avg(experience) AS player_experience, CASE WHEN first(kda ORDER BY place) IS NOT NULL THEN max(kda) END AS star_player_kda,
    CASE WHEN first(kda ORDER BY place) IS NOT NULL THEN min(kda) END AS weakest_player_kda FROM pvalues GROUP BY gameid, team
)
"""
PLAYER_FEATURES = ("avg_player_kda", "avg_player_streak", "avg_player_trajectory", "avg_champ_comfort", "avg_champ_games", "avg_player_pool", "star_player_kda", "weakest_player_kda", "player_experience")


@query(PLAYERS_SQL + "SELECT gameid, team, " + ", ".join(f"round({c}, 6) AS {c}" for c in PLAYER_FEATURES) + " FROM pside")
def player_aggregates(spark, sf):
    return rounded(recent.player_sides(A.player_games(spark, sf), A.LANES, A.line_parts(spark, sf)).select("gameid", "team", *PLAYER_FEATURES))


SERIES = "least(team_a, team_b) || '/' || greatest(team_a, team_b) || '/' || regexp_replace(game_name, '_[^_]*$', '')"


@query(f"""
, s AS (SELECT gameid, game_num, result, list({{'g': game_num, 'r': result}}) OVER (PARTITION BY {SERIES} ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM games),
t AS (SELECT gameid, list_filter(coalesce(p, []), lambda x: x.g < game_num) AS p FROM s),
u AS (SELECT gameid, len(p) AS n, coalesce(list_sum(list_transform(p, lambda x: x.r)), 0) AS a, p[len(p)].r AS last FROM t)
SELECT gameid, n::BIGINT AS series_games_played, (2 * a - n)::BIGINT AS series_score_diff, (n > 0 AND 2 * a = n)::BIGINT AS is_elimination,
  CASE WHEN n = 0 THEN 0 WHEN last = 1 THEN 1 ELSE -1 END::BIGINT AS series_momentum_a FROM u""")
def series_state(spark, sf):
    g = A.games(spark, sf).withColumns(W.series_key(F.col("game_name"), F.col("team_a"), F.col("team_b")))
    return rounded(W.series_state(g, ["series", "team_1", "team_2"]))


@query("""
, s AS (SELECT gameid, date, least(team_a, team_b) AS t1, greatest(team_a, team_b) AS t2 FROM games),
n AS (SELECT *, CASE WHEN coalesce(epoch(date) - epoch(lag(date) OVER (PARTITION BY t1, t2 ORDER BY date, gameid)) > 43200, true) THEN 1 ELSE 0 END AS new FROM s)
SELECT gameid, sum(new) OVER (PARTITION BY t1, t2 ORDER BY date, gameid)::BIGINT AS series_no FROM n""")
def series_sessionized(spark, sf):
    g = A.games(spark, sf).withColumns(W.series_key(F.col("game_name"), F.col("team_a"), F.col("team_b")))
    return rounded(W.sessions(g, ["team_1", "team_2"]).select("gameid", "series_no"))


@query(f"""
, p AS (SELECT g.gameid, g.date, {SERIES} AS series, d.champs || e.champs AS picks FROM games g JOIN drafts d ON d.gameid = g.gameid AND d.slot = 'a' JOIN drafts e ON e.gameid = g.gameid AND e.slot = 'b'),
q AS (SELECT *, flatten(coalesce(list(picks) OVER (PARTITION BY series ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS past FROM p)
SELECT gameid, (len(past) > 5 AND len(list_intersect(past, picks)) = 0)::BIGINT AS is_fearless FROM q""")
def fearless(spark, sf):
    g = A.with_picks(A.wide_games(spark, sf)).withColumns(W.series_key(F.col("game_name"), F.col("team_a"), F.col("team_b")))
    return rounded(W.fearless(g, ["series", "team_1", "team_2"]))


# ---- ratings

ELO_SQL = f"""
, teams AS (SELECT DISTINCT team_a AS t FROM games UNION SELECT DISTINCT team_b FROM games),
nums AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM teams),
seq AS (SELECT g.gameid, row_number() OVER (ORDER BY g.date, g.gameid) AS i, x.k AS ka, y.k AS kb, g.result, {TIER_SQL} AS tier,
  year <> lag(year, 1, year) OVER (ORDER BY g.date, g.gameid) AS turn FROM games g JOIN nums x ON x.t = g.team_a JOIN nums y ON y.t = g.team_b),
fold AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS gameid, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, list_transform(range(1, (SELECT count(*) FROM nums) + 1), lambda z: 1500.0::DOUBLE) AS r
  UNION ALL
  SELECT i, gameid, a, b, list_transform(r, lambda v, z: CASE z WHEN ka THEN v + k * (result - ea) WHEN kb THEN v + k * ((1 - result) - (1 - ea)) ELSE v END) FROM (
    SELECT *, 1 / (1 + pow(10, (b - a) / 400)) AS ea, 32.0 * (0.5 + 0.5 * tier / 3) AS k FROM (
      SELECT s.i, s.gameid, s.ka, s.kb, s.result, s.tier, d.r, d.r[s.ka] AS a, d.r[s.kb] AS b FROM (
        SELECT f.i, s.turn, CASE WHEN s.turn THEN list_transform(f.r, lambda v: 1500 + 0.75 * (v - 1500)) ELSE f.r END AS r FROM fold f JOIN seq s ON s.i = f.i + 1
      ) d JOIN seq s ON s.i = d.i + 1
    )
  )
)
"""


@query(ELO_SQL + "SELECT gameid, round(a, 6) AS elo_a, round(b, 6) AS elo_b, round(a - b, 6) AS elo_diff, round(1 / (1 + pow(10, (b - a) / 400)), 6) AS elo_expected FROM fold WHERE i > 0")
def elo_ratings(spark, sf):
    return rounded(elo.elo(tier(A.games(spark, sf))))


def with_elo(spark, sf, games: DataFrame | None = None) -> DataFrame:
    """The games (A.games(), if not given) and their ratings; the games are gathered once."""
    g = tier(cut(A.games(spark, sf).select("gameid", "date", "league", "team_a", "team_b", "result", "game_name")) if games is None else games)
    return g.join(elo.elo(g), "gameid")


# ---- patches and champions

@query("""
, c AS (SELECT gameid, patch, date, row_number() OVER (PARTITION BY patch ORDER BY date, gameid) - 1 AS n, min(date) OVER (PARTITION BY patch) AS first FROM games)
SELECT gameid, n::BIGINT AS patch_games, round(ln(1 + n), 6) AS patch_maturity, (n < 50)::BIGINT AS is_new_patch,
  CASE WHEN n > 0 THEN greatest(floor((epoch(date) - epoch(first)) / 86400), 0) END::DOUBLE AS patch_age_days FROM c""")
def patch_maturity_age(spark, sf):
    return rounded(meta.patch_age(A.games(spark, sf)).withColumn("patch_age_days", F.col("patch_age_days").cast("double")))


@query(f"SELECT gameid, team, count(*) {over('team, patch')} AS team_patch_games, round(avg(result) {over('team, patch')} - avg(result) {over('team', 10)}, 6) AS patch_wr_delta FROM team_rows")
def patch_wr_delta(spark, sf):
    return rounded(meta.team_patch(A.team_games(spark, sf)))


RATES_SQL = """
, picks AS (SELECT gameid, date, team, result, unnest(champs) AS champ FROM team_games),
per AS (SELECT gameid, date, champ, count(*) AS n, sum(result) AS won FROM picks GROUP BY ALL),
byc AS (SELECT gameid, champ, coalesce(sum(n) OVER w, 0) AS picks, coalesce(sum(won) OVER w, 0) AS wins FROM per WINDOW w AS (PARTITION BY champ ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tot AS (SELECT gameid, coalesce(sum(n) OVER (ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM (SELECT gameid, date, count(*) AS n FROM picks GROUP BY ALL)),
rates AS (SELECT b.gameid, champ, CASE WHEN total > 0 THEN picks / total END AS pick_rate, CASE WHEN picks > 0 THEN wins / picks END AS champ_wr FROM byc b JOIN tot USING (gameid))
"""


@query(RATES_SQL + "SELECT gameid, champ, round(pick_rate, 6) AS pick_rate, round(champ_wr, 6) AS champ_wr FROM rates")
def champ_pick_win_rate(spark, sf):
    return rounded(meta.champion_rates(A.team_games(spark, sf, True)))


@query(RATES_SQL + "SELECT p.gameid, team, round(avg(pick_rate), 6) AS avg_pick_rate, round(avg(champ_wr), 6) AS avg_champ_wr FROM picks p JOIN rates r ON p.gameid = r.gameid AND p.champ = r.champ GROUP BY ALL")
def side_champ_rates(spark, sf):
    return rounded(meta.side_champion_rates(A.team_games(spark, sf, True)))


@query(f"""
, l AS (SELECT gameid, team, champs, opp_bans, list(champs) {over('team', 30)} AS past FROM team_games)
SELECT gameid, team, round(CASE WHEN len(past) > 0 AND len(champs) > 0 THEN list_sum(list_transform(champs, lambda c: len(list_filter(past, lambda g: list_contains(g, c))))) / len(champs) END, 6) AS comfort FROM l""")
def team_comfort(spark, sf):
    return rounded(A.team_games(spark, sf, True).select("gameid", "team", meta.team_comfort().alias("comfort")))


@query(f"""
, l AS (SELECT gameid, team, opp_bans, flatten(coalesce(list(champs) {over('team', 30)}, [])) AS recent FROM team_games)
SELECT gameid, team, len(list_filter(opp_bans, lambda b: list_contains(recent, b)))::BIGINT AS ban_target FROM l""")
def ban_target(spark, sf):
    return rounded(A.team_games(spark, sf, True).select("gameid", "team", meta.ban_target().alias("ban_target")))


@query("""
, picked AS (SELECT gameid, date, slot, team, champs, unnest(champs) AS champ, unnest(range(len(champs))) AS pos FROM team_games),
seen AS (SELECT champ, row_number() OVER (ORDER BY f) AS seen_no FROM (SELECT champ, min((date, gameid, slot, pos)) AS f FROM picked GROUP BY champ)),
g AS (SELECT DISTINCT gameid, date FROM picked),
grid AS (SELECT g.gameid, g.date, s.champ, s.seen_no, count(a.champ) AS n FROM g CROSS JOIN seen s LEFT JOIN picked a ON a.gameid = g.gameid AND a.champ = s.champ GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY champ ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM grid),
top AS (SELECT gameid, champ FROM (SELECT gameid, champ, c, row_number() OVER (PARTITION BY gameid ORDER BY c DESC, seen_no) AS k FROM cum WHERE c > 0) WHERE k <= 20),
anyone AS (SELECT DISTINCT gameid FROM top)
SELECT a.gameid, a.team, round(CASE WHEN max(s.gameid) IS NOT NULL THEN count(t.champ) / count(*) END, 6) AS meta_conformity
FROM picked a LEFT JOIN top t ON a.gameid = t.gameid AND a.champ = t.champ LEFT JOIN anyone s ON s.gameid = a.gameid GROUP BY a.gameid, a.team""")
def meta_conformity_top20(spark, sf):
    t = A.team_games(spark, sf, True).filter(F.size("champs") > 0)
    return rounded(meta.meta_conformity(t))


# ---- dimensions

@query("""
, n AS (SELECT team, league, count(*) AS n, min((date, gameid)) AS f FROM team_rows GROUP BY ALL)
SELECT team, league AS home_league FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, f) AS k FROM n) WHERE k = 1""")
def home_region_argmax(spark, sf):
    return dims.primary_league(A.team_games(spark, sf))


COACH_SQL = """
, coaches AS (SELECT DISTINCT team, year, 'k' || ((team * 7 + year) // 2 % 11) AS coach FROM team_rows WHERE (team + year) % 4 <> 0)
"""


def coaches(spark, sf, sides: DataFrame | None = None) -> DataFrame:
    t = (A.team_games(spark, sf) if sides is None else sides).filter("(team + year) % 4 <> 0").select("team", "year").distinct()
    return t.withColumn("coach", F.concat(F.lit("k"), (F.floor((F.col("team") * 7 + F.col("year")) / 2) % 11).cast("string")))


@query(COACH_SQL + "SELECT t.gameid, t.team, c.coach, p.coach AS coach_before FROM team_rows t LEFT JOIN coaches c ON c.team = t.team AND c.year = t.year LEFT JOIN coaches p ON p.team = t.team AND p.year = t.year - 1")
def coach_year_join(spark, sf):
    c = coaches(spark, sf)
    t = A.team_games(spark, sf).select("gameid", "team", "year")
    before = c.select("team", (F.col("year") + 1).alias("year"), F.col("coach").alias("coach_before"))
    return t.join(c, ["team", "year"], "left").join(before, ["team", "year"], "left").select("gameid", "team", "coach", "coach_before")


@query(COACH_SQL + "SELECT c.team, c.year::BIGINT AS year, c.coach, (coalesce(c.coach = p.coach, false))::BIGINT AS same_coach FROM coaches c LEFT JOIN coaches p ON p.team = c.team AND p.year = c.year - 1")
def prev_year_same_coach(spark, sf):
    return rounded(dims.same_coach(coaches(spark, sf)))


@query(COACH_SQL + """
, r AS (SELECT t.gameid, t.team, t.date, t.result, c.coach FROM team_rows t JOIN coaches c ON c.team = t.team AND c.year = t.year),
h AS (SELECT *, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY coach, team ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
o AS (SELECT coach, team, list(result ORDER BY date, gameid) AS past FROM r GROUP BY ALL)
SELECT gameid, h.team, h.coach, n AS coach_experience, round(list_avg(past[greatest(n - 29, 1):n]), 6) AS coach_wr FROM h JOIN o ON o.coach = h.coach AND o.team = h.team""")
def coach_win_rate(spark, sf):
    rows = A.team_games(spark, sf).join(coaches(spark, sf), ["team", "year"]).select("gameid", "team", "coach", "date", "result")
    return rounded(dims.coach_history(rows).select("gameid", "team", "coach", "coach_experience", "coach_wr"))


@query(COACH_SQL + """
, s AS (SELECT c.team, c.year, c.coach FROM coaches c JOIN coaches p ON p.team = c.team AND p.year = c.year - 1 AND p.coach = c.coach)
SELECT t.team, s.coach, count(*) AS coach_tenure FROM team_rows t JOIN s ON s.team = t.team AND s.year = t.year GROUP BY ALL""")
def coach_tenure(spark, sf):
    again = dims.same_coach(coaches(spark, sf)).filter("same_coach = 1").select("team", "year", "coach")
    return A.team_games(spark, sf).join(again, ["team", "year"]).groupBy("team", "coach").agg(F.count("*").alias("coach_tenure"))


@query(COACH_SQL + "SELECT count(*) AS team_games, sum((c.coach IS NOT NULL)::INT)::BIGINT AS covered, round(avg((c.coach IS NOT NULL)::INT), 6) AS share FROM team_rows t LEFT JOIN coaches c ON c.team = t.team AND c.year = t.year")
def coach_coverage(spark, sf):
    t = A.team_games(spark, sf).join(coaches(spark, sf), ["team", "year"], "left")
    known = F.col("coach").isNotNull().cast("int")
    return rounded(t.agg(F.count("*").alias("team_games"), F.sum(known).alias("covered"), F.avg(known).alias("share")))


@query(COACH_SQL + "SELECT DISTINCT t.team, t.year::BIGINT AS year FROM team_rows t ANTI JOIN coaches c ON c.team = t.team AND c.year = t.year")
def anti_uncovered(spark, sf):
    return rounded(A.team_games(spark, sf).select("team", "year").distinct().join(coaches(spark, sf), ["team", "year"], "left_anti"))


# leagues stand for regions here, one of them for the international one
REGION_SQL = "CASE {} WHEN '1-URGENT' THEN 'KR' WHEN '2-HIGH' THEN 'CN' WHEN '3-MEDIUM' THEN 'EU' WHEN '4-NOT SPECIFIED' THEN 'INT' ELSE 'NA' END"
HOME_SQL = """
, n AS (SELECT team, league, count(*) AS n, min((date, gameid)) AS f FROM team_rows GROUP BY ALL),
home AS (SELECT team, {} AS home FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, f) AS k FROM n) WHERE k = 1)
""".format(REGION_SQL.format("league"))


def region(c):
    return F.when(c == "1-URGENT", "KR").when(c == "2-HIGH", "CN").when(c == "3-MEDIUM", "EU").when(c == "4-NOT SPECIFIED", "INT").otherwise("NA")


def with_regions(spark, sf, wide: DataFrame | None = None) -> DataFrame:
    wide = A.wide_games(spark, sf) if wide is None else wide
    home = dims.primary_league(A.sides_of(wide)).select("team", region(F.col("home_league")).alias("home"))
    g = wide.drop("xs").withColumn("event", region(F.col("league")))
    for s in "ab":
        g = g.join(home.select(F.col("team").alias(f"team_{s}"), F.col("home").alias(f"region_{s}")), f"team_{s}", "left")
        g = g.withColumn(f"region_{s}", F.coalesce(f"region_{s}", "event", F.lit("INT")))
    return g


@query(HOME_SQL + f"""
, t AS (SELECT gameid, {REGION_SQL.format('league')} AS event, a.home AS ha, b.home AS hb FROM games g JOIN home a ON a.team = team_a JOIN home b ON b.team = team_b)
SELECT gameid, (ha = event)::BIGINT AS is_home_a, (hb = event)::BIGINT AS is_home_b, (event = 'INT' AND ha <> 'INT')::BIGINT AS is_traveling_a,
  (event = 'INT' AND hb <> 'INT')::BIGINT AS is_traveling_b, ((event = 'INT' AND ha <> 'INT')::INT - (event = 'INT' AND hb <> 'INT')::INT)::BIGINT AS travel_diff,
  CASE ha WHEN 'KR' THEN 0 WHEN 'CN' THEN 1 WHEN 'EU' THEN 2 WHEN 'NA' THEN 3 ELSE 9 END::BIGINT AS team_a_home FROM t""")
def travel_flags(spark, sf):
    g = with_regions(spark, sf)
    g = g.withColumns(dims.travel(F.col("region_a"), F.col("event"), "a") | dims.travel(F.col("region_b"), F.col("event"), "b"))
    return rounded(g.select("gameid", "is_home_a", "is_home_b", "is_traveling_a", "is_traveling_b", (F.col("is_traveling_a") - F.col("is_traveling_b")).alias("travel_diff"), S.region_number(F.col("region_a")).alias("team_a_home")))


PROFILE_SQL = f"""
, prof AS (SELECT {REGION_SQL.format('league')} AS region, position, avg(coalesce(dpm * 100, 0)) AS gold, avg(coalesce(kills, 0)) AS dmg FROM player_games GROUP BY ALL),
carry AS (SELECT region, arg_max(k, (gold, -k)) AS carry FROM (SELECT *, list_position(['top', 'jng', 'mid', 'bot', 'sup'], position) AS k FROM prof) GROUP BY region)
"""


def profile(spark, sf, players: DataFrame | None = None) -> DataFrame:
    p = (A.player_games(spark, sf) if players is None else players).select(region(F.col("league")).alias("region"), "position", (F.col("dpm") * 100).alias("gold"), F.col("kills").alias("dmg"))
    return dims.region_profile(p)


@query(PROFILE_SQL + "SELECT p.region, position, round(gold, 4) AS gold, round(dmg, 4) AS dmg, carry::BIGINT AS carry FROM prof p JOIN carry c ON p.region = c.region")
def region_profiles(spark, sf):
    p = profile(spark, sf)
    return rounded(p.join(dims.carry_position(p), "region").select("region", "position", "gold", "dmg", "carry"), 4)


def _diff_sql() -> str:
    parts = []
    for p in ("top", "bot", "mid"):
        for k in ("gold", "dmg"):
            parts.append(f"(SELECT {k} FROM prof WHERE region = ha AND position = '{p}') - (SELECT {k} FROM prof WHERE region = hb AND position = '{p}') AS region_{p}_{k}_diff")
    return ", ".join(parts)


@query(HOME_SQL + PROFILE_SQL + f"""
, t AS (SELECT DISTINCT a.home AS ha, b.home AS hb FROM games g JOIN home a ON a.team = team_a JOIN home b ON b.team = team_b),
d AS (SELECT ha, hb, {_diff_sql()}, (SELECT carry FROM carry WHERE region = ha) AS ca, (SELECT carry FROM carry WHERE region = hb) AS cb FROM t)
SELECT ha AS region_a, hb AS region_b, round(region_top_gold_diff, 4) AS region_top_gold_diff, round(region_mid_dmg_diff, 4) AS region_mid_dmg_diff, (coalesce(ca = cb, false))::BIGINT AS carry_position_match,
  round(sqrt(region_top_gold_diff ** 2 + region_top_dmg_diff ** 2 + region_bot_gold_diff ** 2 + region_bot_dmg_diff ** 2 + region_mid_gold_diff ** 2 + region_mid_dmg_diff ** 2), 4) AS region_playstyle_distance FROM d""")
def playstyle_distance(spark, sf):
    p = profile(spark, sf)
    pairs = with_regions(spark, sf).select("region_a", "region_b").distinct()
    out = dims.playstyle_differences(pairs, p, dims.carry_position(p))
    return rounded(out.select("region_a", "region_b", "region_top_gold_diff", "region_mid_dmg_diff", "carry_position_match", "region_playstyle_distance"), 4)


# ---- intervals from the events table

EVENTS_SQL = """
WITH ev AS (
  SELECT event_id, 't' || (user_id % 7) AS team, 'u' || user_id AS person, ts::DATE AS day, CASE event_type WHEN 'signup' THEN 'Join' ELSE 'Leave' END AS direction,
    CASE WHEN event_id % 5 = 0 THEN 'Analyst' WHEN event_id % 3 = 0 THEN 'Analyst,Head Coach' ELSE 'Coach' END AS roles FROM events WHERE event_type IN ('signup', 'error')
), changes AS (
  SELECT * EXCLUDE (roles), roles, CASE WHEN roles LIKE '%Head Coach%' THEN 2 WHEN roles = 'Coach' THEN 1 ELSE 0 END AS rank FROM ev
), ordered AS (
  SELECT *, row_number() OVER w AS k, coalesce(sum((direction = 'Leave')::INT) OVER (PARTITION BY team, person ORDER BY day, direction <> 'Leave', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM changes WHERE rank > 0 WINDOW w AS (PARTITION BY team, person ORDER BY day, direction <> 'Leave', event_id)
), spans AS (
  SELECT team, person, max(rank) AS rank, coalesce(min(day) FILTER (direction = 'Join'), CASE WHEN max((k = 1 AND direction = 'Leave')::INT) = 1 THEN DATE '2018-01-01' END) AS start,
    coalesce(max(day) FILTER (direction = 'Leave'), DATE '2100-01-01') AS "end" FROM ordered GROUP BY team, person, island
), tenures AS (SELECT * FROM spans WHERE start IS NOT NULL), closed AS (
  SELECT t.team, t.person, t.rank, t.start, CASE WHEN t."end" < DATE '2100-01-01' THEN t."end" ELSE coalesce((SELECT min(j.day) FROM changes j
    WHERE j.direction = 'Join' AND j.rank > 0 AND j.team = t.team AND j.person <> t.person AND j.rank >= t.rank AND j.day > t.start), t."end") END AS "end" FROM tenures t
)
"""


def staff_changes(spark, sf) -> DataFrame:
    e = A.read(spark, sf, "events").filter(F.col("event_type").isin("signup", "error"))
    roles = F.when(F.col("event_id") % 5 == 0, "Analyst").when(F.col("event_id") % 3 == 0, "Analyst,Head Coach").otherwise("Coach")
    return e.select(
        "event_id",
        F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("team"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("person"),
        F.to_date("ts").alias("day"),
        F.when(F.col("event_type") == "signup", "Join").otherwise("Leave").alias("direction"),
        S.role_rank(roles).alias("rank"),
    )


def _text_dates(df: DataFrame) -> DataFrame:
    return rounded(df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end") if c in df.columns}))


@query(EVENTS_SQL + """SELECT team, person, rank::BIGINT AS rank, strftime(start, '%Y-%m-%d') AS start, strftime("end", '%Y-%m-%d') AS "end" FROM tenures""", base=False)
def tenures(spark, sf):
    return _text_dates(intervals.tenures(staff_changes(spark, sf)))


@query(EVENTS_SQL + """SELECT team, person, rank::BIGINT AS rank, strftime(start, '%Y-%m-%d') AS start, strftime("end", '%Y-%m-%d') AS "end" FROM closed""", base=False)
def successor_close(spark, sf):
    e = staff_changes(spark, sf)
    return _text_dates(intervals.close_open(intervals.tenures(e), e))


@query(EVENTS_SQL + """
, y AS (SELECT unnest(range(2018, 2031)) AS year),
o AS (SELECT team, year, person, rank, start, date_diff('day', greatest(start, make_date(year, 1, 1)), least("end", make_date(year, 12, 31))) AS days FROM closed, y)
SELECT team, year::BIGINT AS year, person, rank::BIGINT AS rank, days::BIGINT AS days FROM (SELECT *, row_number() OVER (PARTITION BY team, year ORDER BY rank DESC, days DESC, start, person) AS k FROM o WHERE days > 0) WHERE k = 1""", base=False)
def interval_year_overlap(spark, sf):
    e = staff_changes(spark, sf)
    return rounded(intervals.by_year(intervals.close_open(intervals.tenures(e), e), 2018, 2030))


@query("""
, p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, round(c.value, 6) AS last_click FROM p ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts > c.ts""".replace(", p AS", "WITH p AS", 1), base=False)
def asof_last_click(spark, sf):
    e = A.read(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_click"))
    return rounded(W.last_value_before(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["last_click"]).select("event_id", "user_id", "last_click"))
