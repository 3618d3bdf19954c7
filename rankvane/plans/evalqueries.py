"""Registered queries: scans, sets, formulas, feature tables, metrics, models, serving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import elo
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import serving, simulation
from ..operators import windows as W
from ..sources import adapter as A
from ..sources.store import cut, files_of
from . import features, versions
from .matchqueries import ELO_SQL, TIER_SQL, over, rounded, tier, with_elo

REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    def add(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = (A.BASE_SQL if base else "") + sql
        return f

    return add


# ---- scans, projections, filters

@query("""
SELECT year(o_orderdate)::BIGINT AS year, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""", base=False)
def scan_union_years(spark, sf):
    # files of other years are other paths of the same read
    u = A.read(spark, sf, "orders").select("o_totalprice", F.year("o_orderdate").alias("year"))
    return rounded(u.groupBy("year").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'", base=False)
def role_filter(spark, sf):
    o = A.read(spark, sf, "orders")
    return o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "P")).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F'", base=False)
def completeness_filter(spark, sf):
    return rounded(A.read(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice"), 2)


@query("""
SELECT gameid, coalesce(nullif(game_num, 3), 1)::BIGINT AS game, (side_a = 'R')::BIGINT AS is_blue_a, coalesce(try_cast(side_a AS INT), -1)::BIGINT AS as_int,
  replace(league, ' ', '_') AS league_name, epoch(date)::BIGINT AS date_numeric FROM games""")
def typed_defaults(spark, sf):
    g = A.games(spark, sf)
    return rounded(g.select(
        "gameid",
        F.coalesce(F.nullif("game_num", F.lit(3)), F.lit(1)).alias("game"),
        F.when(F.col("side_a") == "R", 1).otherwise(0).alias("is_blue_a"),
        F.coalesce(F.expr("try_cast(side_a AS int)"), F.lit(-1)).alias("as_int"),
        F.replace("league", F.lit(" "), F.lit("_")).alias("league_name"),
        F.unix_timestamp("date").alias("date_numeric"),
    ))


@query("SELECT gameid, team, round(greatest(least(coalesce(golddiffat15, 0), 20000), -20000), 6) AS clipped, round(coalesce(golddiffat15, 0), 6) AS filled FROM team_rows")
def matrix_prep_clip(spark, sf):
    t = A.team_games(spark, sf)
    return rounded(t.select("gameid", "team", S.clamp(F.coalesce("golddiffat15", F.lit(0.0)), -20000, 20000).alias("clipped"), S.matrix_value(F.col("golddiffat15")).alias("filled")))


@query("""
SELECT count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, round(avg(kills), 6) AS mean_kills, round(stddev_samp(kills), 6) AS std_kills,
  count(DISTINCT league) AS leagues, count(golddiffat15) AS known FROM team_rows""")
def profile_summary(spark, sf):
    t = A.team_games(spark, sf)
    return rounded(t.agg(
        F.count("*").alias("n"), F.date_format(F.min("date"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"),
        F.avg("kills").alias("mean_kills"), F.stddev_samp("kills").alias("std_kills"), F.count_distinct("league").alias("leagues"), F.count("golddiffat15").alias("known"),
    ))


@query("SELECT gameid, league FROM games WHERE league LIKE '%HIGH%' AND year(date) = 1995 AND date < TIMESTAMP '1995-07-01'")
def event_predicate(spark, sf):
    g = A.games(spark, sf)
    return g.filter(F.col("league").contains("HIGH") & (F.year("date") == 1995) & (F.col("date") < F.lit("1995-07-01").cast("timestamp"))).select("gameid", "league")


# ---- sets, sorts, top-k

@query("SELECT gameid FROM games WHERE year = 1995 INTERSECT SELECT gameid FROM games WHERE league = '1-URGENT' INTERSECT SELECT gameid FROM games WHERE result = 1")
def intersect_versions(spark, sf):
    g = A.games(spark, sf).select("gameid", "year", "league", "result")
    parts = [g.filter(c).select("gameid") for c in ("year = 1995", "league = '1-URGENT'", "result = 1")]
    return reduce(DataFrame.intersect, parts)


@query("SELECT team, year::BIGINT AS year, count(*) AS n FROM (SELECT team_a AS team, year FROM games UNION ALL SELECT team_b, year FROM games) GROUP BY ALL")
def union_sides(spark, sf):
    g = A.games(spark, sf)
    both = g.select(F.col("team_a").alias("team"), "year").unionAll(g.select(F.col("team_b").alias("team"), "year"))
    return rounded(both.groupBy("team", "year").agg(F.count("*").alias("n")))


@query("SELECT g.gameid, g.league FROM games g WHERE g.gameid IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def semi_common_games(spark, sf):
    ids = A.read(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("gameid"))
    return A.games(spark, sf).join(ids, "gameid", "left_semi").select("gameid", "league")


@query("""SELECT team, n FROM (SELECT team_a AS team, count(*) AS n FROM games GROUP BY 1) ORDER BY n DESC, team LIMIT 20""")
def topk_importance(spark, sf):
    return A.games(spark, sf).groupBy(F.col("team_a").alias("team")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "team").limit(20)


@query("SELECT team, arg_max(gameid, (date, gameid)) AS last_game, round(arg_max(gold, (date, gameid)), 6) AS last_gold FROM team_rows GROUP BY team")
def latest_per_team(spark, sf):
    t = A.team_games(spark, sf)
    key = F.struct("date", "gameid")
    return rounded(t.groupBy("team").agg(F.max_by("gameid", key).alias("last_game"), F.max_by("gold", key).alias("last_gold")))


@query("""
, f AS (SELECT gameid AS probe, team_a AS x, team_b AS y, date FROM games),
c AS (SELECT f.probe, g.gameid, row_number() OVER (PARTITION BY f.probe ORDER BY g.date, g.gameid) AS k FROM f JOIN games g ON ((g.team_a = f.x AND g.team_b = f.y) OR (g.team_a = f.y AND g.team_b = f.x))
  AND abs(floor((epoch(g.date) - epoch(f.date)) / 86400)) <= 30)
SELECT probe, gameid AS found FROM c WHERE k = 1""")
def band_join_first(spark, sf):
    # the pair in a fixed order makes "either orientation" an equality
    g = A.games(spark, sf).select("gameid", "date", F.least("team_a", "team_b").alias("t1"), F.greatest("team_a", "team_b").alias("t2"))
    probes = g.select(F.col("gameid").alias("probe"), F.col("date").alias("at"), "t1", "t2")
    day = 86_400
    found = W.first_in_band(probes, g, ["t1", "t2"], "at", "date", ["gameid"], 30 * day, 31 * day)
    return found.filter("gameid IS NOT NULL").select("probe", F.col("gameid").alias("found"))


@query("""
, n AS (SELECT gameid, date, row_number() OVER (ORDER BY date, gameid) AS rn, count(*) OVER () AS n FROM games)
SELECT gameid, rn, CASE WHEN rn <= floor(n * 0.75) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS part FROM n""")
def temporal_split(spark, sf):
    return M.temporal_split(A.games(spark, sf).select("gameid", "date"), ["date", "gameid"]).select("gameid", "rn", "part")


@query("""
, n AS (SELECT gameid, date, league = '2-HIGH' AND year = 1997 AS ev, row_number() OVER (ORDER BY date, gameid) AS rn FROM games),
f AS (SELECT min(rn) AS f FROM n WHERE ev)
SELECT gameid, CASE WHEN rn < f THEN 'train' ELSE 'test' END AS part FROM n, f WHERE rn < f OR ev""")
def event_holdout(spark, sf):
    g = A.games(spark, sf).select("gameid", "date", "league", "year")
    return M.event_holdout(g, (F.col("league") == "2-HIGH") & (F.col("year") == 1997), ["date", "gameid"]).select("gameid", "part")


# ---- scalar rules

@query(f"""
SELECT DISTINCT league, {TIER_SQL}::BIGINT AS tier, game_num::BIGINT AS game_num, CASE WHEN game_num = 1 THEN 1 WHEN game_num <= 3 THEN 3 ELSE 5 END::BIGINT AS bo_format,
  CASE WHEN game_num = 1 THEN 1.0 WHEN game_num = 2 THEN 1.3 ELSE 1.5 END::DOUBLE AS weight FROM games""")
def league_and_format(spark, sf):
    g = tier(A.games(spark, sf))
    return rounded(g.select("league", "tier", "game_num", S.best_of(F.col("game_num")).alias("bo_format"), S.game_weight(F.col("game_num")).alias("weight")).distinct())


# ---- formulas

@query(f"""
, m AS (SELECT gameid, team, avg(dragons) {over('team', 10)} AS d, avg(opp_dragons) {over('team', 10)} AS od, avg(towers) {over('team', 10)} AS t, avg(opp_towers) {over('team', 10)} AS ot,
  avg(kills) {over('team', 10)} AS k, avg(deaths) {over('team', 10)} AS x FROM team_rows)
SELECT gameid, team, round(CASE WHEN d IS NOT NULL AND od IS NOT NULL THEN d / greatest(d + od, 0.5) END, 6) AS dragon_control, round(CASE WHEN t IS NOT NULL AND ot IS NOT NULL THEN t / greatest(t + ot, 0.5) END, 6) AS tower_control,
  round(CASE WHEN x IS NOT NULL THEN k / greatest(CASE WHEN x = 0 THEN 1.0 ELSE x END, 0.5) END, 6) AS kda_ratio FROM m""")
def derived_control_diffs(spark, sf):
    m = {c: W.rolling_mean(c, ["team"], 10) for c in ("dragons", "opp_dragons", "towers", "opp_towers", "kills", "deaths")}
    t = A.team_games(spark, sf).select("gameid", "team", *(c.alias(f"m_{n}") for n, c in m.items()))
    return rounded(t.select(
        "gameid", "team",
        S.control_share(F.col("m_dragons"), F.col("m_opp_dragons")).alias("dragon_control"),
        S.control_share(F.col("m_towers"), F.col("m_opp_towers")).alias("tower_control"),
        W.kda(F.col("m_kills"), F.col("m_deaths")).alias("kda_ratio"),
    ))


@query(features.SIDE_SQL + features.PAIR_SQL + "SELECT gameid, " + ", ".join(f"round({c}, 6) AS {c}" for c in features.CORE) + " FROM pairrow")
def features_core(spark, sf):
    return rounded(features.core(spark, sf).select("gameid", *features.CORE))


@query(ELO_SQL + features.SIDE_SQL + features.PAIR_SQL + "SELECT p.gameid, round(0.3 * (f.a - f.b) / 200 + 0.25 * wr_diff_10 * 2 + 0.2 * coalesce(kda_ratio_diff, 0) + 0.15 * coalesce(dragon_control_diff, 0) * 2 + 0.1 * coalesce(avg10_golddiffat15_diff, 0) / 1000, 6) AS composite FROM pairrow p JOIN fold f ON f.gameid = p.gameid AND f.i > 0")
def composite_strength(spark, sf):
    g = cut(A.games(spark, sf))
    f = features.of_games(g, A.line_parts(spark, sf)).join(elo.elo(tier(g)).select("gameid", "elo_diff"), "gameid")
    parts = ("elo_diff", "wr_diff_10", "kda_ratio_diff", "dragon_control_diff", "avg10_golddiffat15_diff")
    return rounded(f.select("gameid", versions.composite(*map(F.col, parts)).alias("composite")))


@query(features.SIDE_SQL + features.PAIR_SQL + "SELECT gameid, n_games_a, n_games_b FROM pairrow WHERE n_games_a >= 5 AND n_games_b >= 5")
def both_experienced(spark, sf):
    return features.core(spark, sf).filter("n_games_a >= 5 AND n_games_b >= 5").select("gameid", "n_games_a", "n_games_b")


@query(features.SIDE_SQL + features.PAIR_SQL + "SELECT gameid, round(-wr_diff_10, 6) AS wr_diff_10, n_games_a AS n_games_b, n_games_b AS n_games_a FROM pairrow")
def side_flip_clean(spark, sf):
    f = features.core(spark, sf).select("gameid", "wr_diff_10", "n_games_a", "n_games_b")
    flip = serving.flipped(["wr_diff_10", "n_games_a", "n_games_b"], clean=True)
    return rounded(f.select("gameid", *(c.alias(n) for n, c in flip.items())))


# ---- metrics of the rating baseline

PRED_SQL = ELO_SQL + f""", pred AS (SELECT f.gameid, g.result AS y, 1 / (1 + pow(10, (b - a) / 400)) AS p, {TIER_SQL} AS tier FROM fold f JOIN games g ON g.gameid = f.gameid WHERE f.i > 0)
"""
AUC_SQL = """sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0"""


def predictions(spark, sf) -> DataFrame:
    """Written once: the metrics read it several times, and a read would fold all games anew."""
    return cut(with_elo(spark, sf).select("gameid", "tier", F.col("result").alias("y"), F.col("elo_expected").alias("p")))


@query(PRED_SQL + f"""
, k AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM pred)
SELECT round(({AUC_SQL}) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg((y - p) ** 2), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS logloss,
  round(avg(((p >= 0.5)::INT = y)::INT), 6) AS acc, count(*) AS n FROM k""")
def elo_baseline_metrics(spark, sf):
    return rounded(M.scores(predictions(spark, sf)))


@query(PRED_SQL + f"""
, k AS (SELECT *, rank() OVER (PARTITION BY tier ORDER BY p) + (count(*) OVER (PARTITION BY tier, p) - 1) / 2.0 AS r FROM pred)
SELECT tier::BIGINT AS tier, round(({AUC_SQL}) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg((y - p) ** 2), 6) AS brier, count(*) AS n FROM k GROUP BY tier HAVING count(*) > 50""")
def auc_by_tier(spark, sf):
    return rounded(M.tier_scores(predictions(spark, sf)))


@query(PRED_SQL + "SELECT round((least(floor(p * 10), 9) + 0.5) / 10, 6) AS mid, round(avg(y), 6) AS frac, count(*) AS n FROM pred GROUP BY least(floor(p * 10), 9)")
def calibration_bins(spark, sf):
    return rounded(M.calibration(predictions(spark, sf)))


@query(PRED_SQL + """
, t AS (SELECT i / 199 AS threshold FROM range(200) x(i))
SELECT round(threshold, 6) AS threshold, round(sum((p >= threshold AND y = 1)::INT) / (SELECT sum(y) FROM pred), 6) AS tpr, round(sum((p >= threshold AND y = 0)::INT) / (SELECT sum(1 - y) FROM pred), 6) AS fpr FROM t, pred GROUP BY threshold""")
def roc_points(spark, sf):
    return rounded(M.roc_points(predictions(spark, sf)))


@query(PRED_SQL + """
, c AS (SELECT greatest(p, 1 - p) AS c, ((p >= 0.5)::INT = y)::INT AS ok FROM pred)
SELECT floor((c - 0.5) / 0.5 * 9)::BIGINT AS bin, round(avg(ok), 6) AS acc, count(*) AS n FROM c WHERE c < 1 GROUP BY 1 HAVING count(*) > 10""")
def accuracy_by_confidence(spark, sf):
    return rounded(M.confidence_accuracy(predictions(spark, sf)))


@query(PRED_SQL + """
, h AS (SELECT y, least(floor(p * 30), 29)::BIGINT AS bin, count(*) AS n FROM pred GROUP BY 1, 2)
SELECT y::BIGINT AS y, bin, round(n * 30 / sum(n) OVER (PARTITION BY y), 6) AS density FROM h""")
def prediction_hist(spark, sf):
    return rounded(M.histogram(predictions(spark, sf)))


@query("""
, s AS (SELECT avg(kills_a) AS mk, stddev_pop(kills_a) AS sk, avg(gold_a) AS mg, stddev_pop(gold_a) AS sg FROM games WHERE year < 1996)
SELECT gameid, round((kills_a - mk) / sk, 6) AS kills_a, round((gold_a - mg) / sg, 6) AS gold_a FROM games, s""")
def standardize(spark, sf):
    g = A.games(spark, sf).select("gameid", "year", "kills_a", "gold_a")
    return rounded(M.standardized(g, ["kills_a", "gold_a"], F.col("year") < 1996).select("gameid", "kills_a", "gold_a"))


CUTS = [round((5 + 90 * i / 19) / 100, 6) for i in range(20)]  # from the 5th to the 95th percentile


@query("SELECT " + ", ".join(f"round(quantile_cont(gold_a, {q}), 4) AS q{i:02d}" for i, q in enumerate(CUTS)) + " FROM games")
def split_candidates(spark, sf):
    cuts = M.exact_percentiles(A.games(spark, sf), "gold_a", CUTS)
    g = spark.createDataFrame([cuts], ", ".join(f"q{i:02d} double" for i in range(len(CUTS))))
    return rounded(g, 4)


# ---- serving

SNAP_SQL = """
, snap AS (SELECT team, count(*) AS games, sum(result) / count(*) AS wr, 40.0 * (team % 5) + avg(kills) AS elo FROM team_rows GROUP BY team),
duel AS (SELECT a.team AS team_a, b.team AS team_b, a.elo AS ea, b.elo AS eb, a.wr AS wa, b.wr AS wb, a.team % 2 = 0 AS blue, b.team % 3 = 0 AS ev FROM snap a JOIN snap b ON b.team = a.team + 1),
parts AS (SELECT *, ln(greatest(least(1 / (1 + pow(10, -(ea - eb) / 250)), 0.999), 0.001) / (1 - greatest(least(1 / (1 + pow(10, -(ea - eb) / 250)), 0.999), 0.001))) AS pe, 1.5 * (wa - wb) AS pf,
  CASE WHEN blue THEN 0.15 ELSE 0 END AS ps, CASE WHEN ev THEN 0.05 ELSE 0 END AS pv FROM duel),
tot AS (SELECT *, pe + pf + ps + pv AS total, 1 / (1 + exp(-(pe + pf + ps + pv))) AS p, greatest(abs(pe), abs(pf), abs(ps), abs(pv), 1e-9) AS most FROM parts)
"""


def duels(spark, sf) -> DataFrame:
    t = A.team_games(spark, sf).groupBy("team").agg(F.count("*").alias("games"), F.avg("result").alias("wr"), F.avg("kills").alias("k"))
    t = t.withColumn("elo", 40.0 * (F.col("team") % 5) + F.col("k"))
    a = t.select(F.col("team").alias("team_a"), F.col("elo").alias("elo_a"), F.col("wr").alias("wr_a"), F.col("games").alias("games_a"))
    b = t.select(F.col("team").alias("team_b"), F.col("elo").alias("elo_b"), F.col("wr").alias("wr_b"), F.col("games").alias("games_b"), (F.col("team") - 1).alias("team_a"))
    return a.join(b, "team_a").withColumns({"blue": F.col("team_a") % 2 == 0, "event": F.col("team_b") % 3 == 0})


def explained(spark, sf) -> DataFrame:
    c = F.col
    return duels(spark, sf).withColumns(serving.explain(c("elo_a"), c("elo_b"), c("wr_a"), c("wr_b"), c("blue"), c("event")))


@query(SNAP_SQL + "SELECT team_a, team_b, round(total, 6) AS total, round(p, 6) AS p, floor(p * 100 + 0.5)::BIGINT AS pct_a, (100 - floor(p * 100 + 0.5))::BIGINT AS pct_b FROM tot")
def proxy_predict(spark, sf):
    return rounded(explained(spark, sf).withColumns(serving.shown(F.col("p"))).select("team_a", "team_b", "total", "p", "pct_a", "pct_b"))


@query(SNAP_SQL + "SELECT team_a, round(abs(pe) / most * 100, 6) AS width_0, round(abs(pf) / most * 100, 6) AS width_1, round(abs(ps) / most * 100, 6) AS width_2, round(abs(pv) / most * 100, 6) AS width_3, abs(pv) < 1e-9 AS muted_3 FROM tot")
def driver_rows(spark, sf):
    d = serving.drivers([F.col(c) for c in ("part_elo", "part_form", "part_side", "part_event")])
    return rounded(explained(spark, sf).withColumns(d).select("team_a", "width_0", "width_1", "width_2", "width_3", "muted_3"))


ROSTER_SQL = """
, snap AS (SELECT team, position, avg(kills) AS kda, avg(dpm) AS dpm, avg(result) AS wr, avg(assists) AS cs, count(DISTINCT champ) AS pool FROM player_games GROUP BY ALL)
SELECT a.team AS team_a, b.team AS team_b, a.position, CASE WHEN (a.kda > b.kda)::INT + (a.dpm > b.dpm)::INT + (a.wr > b.wr)::INT + (a.cs > b.cs)::INT + (a.pool > b.pool)::INT >= 3 THEN 'a' ELSE 'b' END AS winner
FROM snap a JOIN snap b ON b.team = a.team + 1 AND a.position = b.position"""


@query(ROSTER_SQL)
def compare_rosters(spark, sf):
    p = A.player_games(spark, sf)
    snap = p.groupBy("team", "position").agg(F.avg("kills").alias("kda"), F.avg("dpm").alias("dpm"), F.avg("result").alias("wr"), F.avg("assists").alias("cs"), F.count_distinct("champ").alias("pool"))
    teams = p.select("team").distinct()
    return serving.compare_rosters(snap, teams.select(F.col("team").alias("team_a"), (F.col("team") + 1).alias("team_b")))


SLOTS = versions.VERSIONS[2]
#: a linear model of every slot by rule, in place of fitted weights, means and spreads
SLOT_MODEL = {c: (((i * 37) % 19 - 9) / 100, ((i * 11) % 7 - 3) / 20, 0.5 + (i % 5) / 4) for i, c in enumerate(SLOTS)}
SLOT_BIAS = 0.1
#: what a team snapshot fills of the slots; all others are 0 before they are standardized
FILLED_SQL = {
    "elo_diff": "ea - eb", "elo_expected": "1 / (1 + pow(10, -(ea - eb) / 400))", "n_games_diff": "ga - gb", "wr_a_10": "wa", "wr_b_10": "wb", "wr_diff_10": "wa - wb",
    "is_blue_a": "blue::INT", "league_tier": "CASE WHEN team_a % 3 = 0 THEN 2 WHEN team_a % 3 = 1 THEN 1 ELSE 0 END",
}


@query(SNAP_SQL.replace("a.wr AS wa", "a.wr AS wa, a.games AS ga, b.games AS gb") + ", z AS (SELECT team_a, " + repr(SLOT_BIAS) + " + " + " + ".join(
    f"{w} * (({FILLED_SQL.get(c, '0')}) - ({m})) / {s}" for c, (w, m, s) in SLOT_MODEL.items()
) + """ AS z FROM duel), q AS (SELECT team_a, 1 / (1 + exp(-z)) AS p FROM z)
SELECT team_a, round(p, 6) AS p, round(2 * abs(p - 0.5), 6) AS confidence, CASE WHEN 2 * abs(p - 0.5) > 0.6 THEN 'high' WHEN 2 * abs(p - 0.5) > 0.3 THEN 'medium' ELSE 'low' END AS band FROM q""")  # fmt: skip
def legacy_lr_score(spark, sf):
    """All slots of the second version's model; a snapshot fills eight of them."""
    c = F.col
    tier_ = S.display_tier(F.element_at(F.array(F.lit("LCK"), F.lit("PCS"), F.lit("LCO")), (c("team_a") % 3 + 1).cast("int")))
    given = serving.filled_slots(c("elo_a"), c("elo_b"), c("games_a"), c("games_b"), c("wr_a"), c("wr_b"), c("blue"), tier_)
    weights, mean, spread = ({n: v[k] for n, v in SLOT_MODEL.items()} for k in range(3))
    return rounded(duels(spark, sf).withColumns(serving.linear_score(given, weights, mean, spread, SLOT_BIAS)).select("team_a", "p", "confidence", "band"))


@query("SELECT s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE lower(s_name) LIKE '%0001%'", base=False)
def text_search(spark, sf):
    t = A.read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("elo"))
    return rounded(serving.search(t, "0001").select(F.col("name").alias("s_name"), F.col("elo").alias("s_acctbal")), 2)


# ---- models (fits have no form in SQL)

_TABLES: dict = {}


def feature_table(spark, sf) -> DataFrame:
    """The table of all versions, written once for a session and its input files, and read by every model."""
    key = (spark.sparkContext.applicationId, sf, *(file for name in ("orders", "lineitem", "part", "supplier", "customer", "nation", "region", "events") for file in files_of(spark, f"{sf}/{name}.parquet")))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = versions.features(spark, sf).filter("n_games_a >= 5 AND n_games_b >= 5")  # of a written table
    return _TABLES[key]


def _parts(spark, sf):
    columns = list(versions.VERSIONS[4])
    table = feature_table(spark, sf)
    us = F.unix_micros("date")
    # the last game to learn from, found on narrow rows: the wide ones are dealt once
    last = M.temporal_split(table.select("date", "gameid"), ["date", "gameid"]).filter("part = 'train'").agg(F.max(F.struct(us.alias("us"), "gameid")).alias("last")).first()["last"]
    known = table.filter((us < last.us) | ((us == last.us) & (F.col("gameid") <= last.gameid))) if last else table.limit(0)
    means, spreads = M.moments_of(known.select(M.packed(columns)), columns)
    rows = table.select("date", "gameid", F.col("result").cast("double").alias(ML.LABEL), M.packed(columns))
    rows = M.temporal_split(rows, ["date", "gameid"]).select("gameid", "part", "rn", "n", ML.LABEL, "xs")
    rows = cut(ML.scaled_matrix(rows, means, spreads))
    return rows, columns, {p: rows.filter(F.col("part") == p) for p in ("train", "val", "test")}


@query()
def lr(spark, sf):
    _, _, p = _parts(spark, sf)
    return rounded(ML.compared(p["train"], p["test"], {"lr": ML.logistic()}))


@query()
def gbdt(spark, sf):
    _, _, p = _parts(spark, sf)
    return rounded(ML.compared(p["train"], p["test"], {"gbdt": ML.boosted()}))


@query()
def forest_mlp_tree(spark, sf):
    _, columns, p = _parts(spark, sf)
    return rounded(ML.compared(p["train"], p["test"], {"rf": ML.forest(), "tree": ML.tree(), "mlp": ML.perceptron(len(columns))}))


@query()
def lr_by_steps(spark, sf):
    """A logistic regression by 2000 steps along batches of 512."""
    _, _, p = _parts(spark, sf)
    return rounded(ML.by_steps(p["train"], p["test"]))


@query()
def network(spark, sf):
    """Two rectified layers with dropout, by Adam; training ends when the loss stays."""
    _, columns, p = _parts(spark, sf)
    return rounded(ML.by_network(p["train"], p["test"], len(columns), epochs=40))


@query()
def weighted_ensemble(spark, sf):
    _, columns, p = _parts(spark, sf)
    val, test = p["val"], p["test"]
    members = {"p_lr": ML.logistic(), "p_gbdt": ML.boosted(), "p_rf": ML.forest(), "p_mlp": ML.perceptron(len(columns))}
    made = ML.at_once([lambda e=e: e.fit(p["train"]) for e in members.values()], ML.number_of(p["train"]))
    for name, m in zip(members, made):
        val, test = ML.predict(m, val, name), ML.predict(m, test, name)
    return rounded(ML.weighted_ensemble(val, test, list(members)).select("gameid", "p"))


@query()
def stacking(spark, sf):
    _, _, p = _parts(spark, sf)
    members = {"p_lr": ML.logistic(), "p_rf": ML.forest(), "p_tree": ML.tree()}
    train, test = ML.out_of_fold(p["train"], members), p["test"]
    made = ML.at_once([lambda e=e: e.fit(p["train"]) for e in members.values()], ML.number_of(p["train"]))
    for name, m in zip(members, made):
        test = ML.predict(m, test, name)
    return rounded(ML.stacked(train, test, list(members)).select("gameid", "p"))


@query()
def walk_forward(spark, sf):
    rows, _, _ = _parts(spark, sf)
    return rounded(ML.with_summary(ML.walk_forward(rows, ML.logistic())))


@query()
def importance_splits(spark, sf):
    _, columns, p = _parts(spark, sf)
    share = ML.split_importance(ML.boosted().fit(p["train"]), columns)
    return spark.createDataFrame(sorted(share.items(), key=lambda x: (-x[1], x[0])), "feature string, importance double").limit(30)


@query()
def compare_versions(spark, sf):
    """The rating, and both models on the columns of each version."""
    t = feature_table(spark, sf)
    return rounded(ML.compare_versions(t, {f"V{v}": list(c) for v, c in versions.VERSIONS.items()}))


@query("""
, n AS (SELECT gameid, result, row_number() OVER (ORDER BY date, gameid) AS rn, count(*) OVER () AS n FROM games)
SELECT CASE WHEN rn <= floor(n * 0.75) THEN 'train' WHEN rn <= floor(n * 0.85) THEN 'val' ELSE 'test' END AS part, round(avg(result), 6) AS balance, count(*) AS games FROM n GROUP BY 1""")
def class_balance(spark, sf):
    g = M.temporal_split(A.games(spark, sf).select("gameid", "date", "result"), ["date", "gameid"])
    return rounded(g.groupBy("part").agg(F.avg("result").alias("balance"), F.count("*").alias("games")))


@query(PRED_SQL + f"""
, b AS (SELECT f.*, g.result, least(g.team_a, g.team_b) AS t1, greatest(g.team_a, g.team_b) AS t2, g.date, g.gameid AS id FROM fold f JOIN games g ON g.gameid = f.gameid WHERE f.i > 0),
s AS (SELECT b.*, strftime(date, '%Y-%m') AS series FROM b),
k AS (SELECT *, row_number() OVER w AS first, count(*) OVER (PARTITION BY series, t1, t2) AS games, sum(result) OVER (PARTITION BY series, t1, t2) AS won FROM s WINDOW w AS (PARTITION BY series, t1, t2 ORDER BY date, id)),
p AS (SELECT *, 1 / (1 + pow(10, (b - a) / 400)) AS p FROM k WHERE first = 1)
SELECT series, count(*) AS n, round(avg(((p >= 0.5) = (result = 1))::INT), 6) AS acc, round(avg(games), 6) AS games, round(avg(((p >= 0.5) = (2 * won > games) AND 2 * won <> games)::INT), 6) AS series_acc FROM p GROUP BY series""")
def tournament_sim(spark, sf):
    """Each series of a pair picked by what was known before its first game: right in that game, right in the series."""
    g = with_elo(spark, sf).withColumns(W.series_key(F.col("game_name"), F.col("team_a"), F.col("team_b")))
    return rounded(simulation.series_picks(g).groupBy("series").agg(
        F.count("*").alias("n"), F.avg(F.col("first_right").cast("int")).alias("acc"), F.avg("games").alias("games"), F.avg(F.col("series_right").cast("int")).alias("series_acc"),
    ))


@query()
def edge_probes(spark, sf):
    """What a fitted model says of extreme, equal, swapped, longer and travelling match-ups."""
    columns = list(versions.VERSIONS[4])
    t = feature_table(spark, sf)
    rows = t.select(F.col("result").cast("double").alias(ML.LABEL), M.packed(columns))
    model = ML.logistic().fit(cut(ML.scaled_matrix(rows, *M.moments_of(rows.select("xs"), columns))))
    return rounded(simulation.probes(model, t, columns))
