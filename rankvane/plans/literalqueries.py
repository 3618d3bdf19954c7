"""Registered queries of rules that the match tables don't exercise as they are: on names,
numbers and texts made from columns of the given tables, and on log files, each with its SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dims, serving
from ..operators import windows as W
from ..sources import adapter as A
from ..sources import logs
from ..sources.store import cut, shared_folder
from . import matchqueries as Q

REGISTRY: dict = {}
SQL: dict[str, str] = {}

LEAGUES = ("LCK", "LPL", "LEC", "LCS", "LTA", "LTA North", "LTA South", "LCP", "PCS", "VCS", "CBLOL", "LJL", "LLA", "LCO", "TCL", "EM", "LFL", "Worlds", "WLDs", "MSI 2024", "First Stand", "KeSPA", "Other", "")

def query(sql: str, base: bool = False):
    def add(f):
        REGISTRY[f.__name__] = f
        SQL[f.__name__] = (A.BASE_SQL if base else "") + sql
        return f

    return add


def _in(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def _case(values: dict, default) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE league " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + f" ELSE {quote(default)} END"


_TOP = f"(league IN {_in(S.MAJOR_LEAGUES)} OR " + " OR ".join(f"contains(league, '{x}')" for x in S.INTERNATIONAL) + ")"


_NAMES = "[" + ", ".join(f"'{x}'" for x in LEAGUES) + "]"


@query(f"""
WITH l AS (SELECT o_orderkey AS gameid, ({_NAMES})[o_orderkey % {len(LEAGUES)} + 1] AS league FROM orders), r AS (SELECT *, {_case(S.LEAGUE_REGION, "INT")} AS region FROM l)
SELECT gameid, league, CASE WHEN {_TOP} THEN 3 WHEN league IN {_in(S.SECOND_LEAGUES)} THEN 2 ELSE 1 END::BIGINT AS tier, {_TOP}::BIGINT AS is_lan, {_case(S.PAGE_TIERS, 0)}::BIGINT AS page_tier, region,
  {_case(S.REGION_NUMBER, 9).replace("CASE league", "CASE region")}::BIGINT AS region_number FROM r""")
def league_rules(spark, sf):
    """Tier, venue, the scoring page's tier and the home region of each order, whose key names its league."""
    o = A.read(spark, sf, "orders")
    league = F.element_at(F.array(*map(F.lit, LEAGUES)), (F.col("o_orderkey") % len(LEAGUES) + 1).cast("int"))
    t, c = o.select(F.col("o_orderkey").alias("gameid"), league.alias("league")), F.col("league")
    return Q.rounded(t.select("gameid", "league", S.league_tier(c).alias("tier"), S.is_lan(c).alias("is_lan"), S.display_tier(c).alias("page_tier"), S.region_of(c).alias("region"), S.region_number(S.region_of(c)).alias("region_number")))


@query("""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN o_totalprice / 100000 WHEN 2 THEN o_totalprice / -200 ELSE o_totalprice / 100000000 END AS x FROM orders),
w AS (SELECT o_orderkey, sign(x) * floor(abs(x) * 100 + 0.5 + 1e-9) / 100 AS r, sign(x * 100) * floor(abs(x * 100) + 0.5 + 1e-9) AS p, sign(x) * floor(abs(x) + 0.5 + 1e-9) AS w, sign(x) * floor(abs(x) * 10 + 0.5 + 1e-9) / 10 AS d FROM v)
SELECT o_orderkey, CASE WHEN r = 0 THEN '0' WHEN r > 0 THEN '+' || printf('%.2f', r) ELSE chr(8722) || printf('%.2f', -r) END AS signed, p::BIGINT || '%' AS percent, w::BIGINT::VARCHAR AS elo, printf('%.1f', d) AS ratio FROM w""")
def number_texts(spark, sf):
    """Texts of numbers of several sizes and signs, from prices."""
    price, k = F.col("o_totalprice").cast("double"), F.col("o_orderkey") % 4
    x = F.when(k == 0, 0.0).when(k == 1, price / 100_000).when(k == 2, price / -200).otherwise(price / 100_000_000)
    t, c = A.read(spark, sf, "orders").select("o_orderkey", x.alias("x")), F.col("x")
    return t.select("o_orderkey", S.signed_text(c).alias("signed"), S.percent_text(c).alias("percent"), S.elo_text(c).alias("elo"), S.ratio_text(c).alias("ratio"))


@query("""
WITH v AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN d || ' 12:30:00' WHEN 1 THEN left(d, 8) || '31' WHEN 2 THEN d || 'T05:06:07' WHEN 3 THEN 'day ' || d WHEN 4 THEN '' ELSE d || ' 23:59:59 and more' END AS text FROM v)
SELECT o_orderkey, text, epoch(try_cast(text AS TIMESTAMP))::DOUBLE AS seconds, strftime(try_cast(left(text, 10) AS DATE), '%Y-%m-%d') AS day FROM t""")
def parsed_times(spark, sf):
    """Times and leading dates of texts made of order dates; null where there is none."""
    d, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    forms = [F.concat(d, F.lit(" 12:30:00")), F.concat(F.substring(d, 1, 8), F.lit("31")), F.concat(d, F.lit("T05:06:07")), F.concat(F.lit("day "), d), F.lit("")]
    text = F.concat(d, F.lit(" 23:59:59 and more"))
    for i, form in enumerate(forms):
        text = F.when(k == i, form).otherwise(text)
    t = A.read(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return t.select("o_orderkey", "text", F.unix_timestamp(S.parse_time(F.col("text"))).cast("double").alias("seconds"), F.date_format(S.date_prefix(F.col("text")), "yyyy-MM-dd").alias("day"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(1 / (1 + exp(-greatest(least((l_extendedprice - 30000) / 40, 500), -500))), 6) AS p FROM lineitem")
def sigmoid_clipped(spark, sf):
    """Probabilities of scores, most of them beyond where the exponent is held."""
    z = (F.col("l_extendedprice").cast("double") - 30_000) / 40
    return Q.rounded(A.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.sigmoid(z).alias("p")))


@query("""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN '_' WHEN 2 THEN 'A_' || o_custkey || '_' ELSE strftime(o_orderdate, '%Y_%m') || '_' || o_orderkey END AS id FROM orders)
SELECT o_orderkey, id, CASE WHEN contains(id, '_') THEN left(id, len(id) - position('_' IN reverse(id))) ELSE id END AS series FROM v""")
def series_prefix(spark, sf):
    """The id before its last underscore, which games of one series share."""
    k = F.col("o_orderkey") % 5
    made = F.concat_ws("_", F.date_format("o_orderdate", "yyyy_MM"), F.col("o_orderkey"))
    made = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, "_").when(k == 2, F.concat(F.lit("A_"), F.col("o_custkey"), F.lit("_"))).otherwise(made)
    t = A.read(spark, sf, "orders").select("o_orderkey", made.alias("id"))
    return t.select("o_orderkey", "id", W.series_key(F.col("id"), F.lit(1), F.lit(2))["series"].alias("series"))


@query("""
, x AS (SELECT a.gameid, a.roster AS mine, b.roster AS theirs FROM team_games a JOIN team_games b ON a.gameid = b.gameid AND a.slot = 'a' AND b.slot = 'b')
SELECT gameid, len(list_distinct(mine || theirs))::BIGINT AS either, len(list_intersect(mine, theirs))::BIGINT AS both, len(list_filter(mine, lambda p: NOT list_contains(theirs, p)))::BIGINT AS only_a FROM x""", base=True)
def roster_sets(spark, sf):
    t = A.team_games(spark, sf, True).select("gameid", "slot", "roster")
    g = t.groupBy("gameid").agg(*(F.first(F.when(F.col("slot") == s, F.col("roster")), ignorenulls=True).alias(s) for s in "ab"))
    return Q.rounded(g.select("gameid", F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_except("a", "b")).alias("only_a")))


@query("""
SELECT gameid, CASE WHEN kills_a > kills_b THEN 'a' WHEN kills_a < kills_b THEN 'b' ELSE 't' END AS kills, CASE WHEN tax_a > tax_b THEN 'a' WHEN tax_a < tax_b THEN 'b' ELSE 't' END AS towers FROM games""", base=True)
def row_tints(spark, sf):
    return A.games(spark, sf).select("gameid", S.tint(F.col("kills_a"), F.col("kills_b")).alias("kills"), S.tint(F.col("tax_a"), F.col("tax_b")).alias("towers"))


@query("""
, known AS (SELECT team_a AS team, team_b AS other, result FROM games WHERE gameid % 7 <> 0),
s AS (SELECT team, sum(result) / count(*) AS wr FROM known GROUP BY team),
d AS (SELECT g.gameid, team_a, CASE WHEN g.gameid % 11 = 0 THEN team_a ELSE team_b END AS team_b FROM games g),
p AS (SELECT d.*, 1 / (1 + exp(-1.5 * (a.wr - b.wr))) AS p FROM d LEFT JOIN s a ON a.team = d.team_a LEFT JOIN s b ON b.team = d.team_b)
SELECT gameid, coalesce(CASE WHEN team_a <> team_b AND p IS NOT NULL THEN floor(p * 100 + 0.5) END, -1)::BIGINT AS pct_a, coalesce(CASE WHEN team_a <> team_b AND p IS NOT NULL THEN 100 - floor(p * 100 + 0.5) END, -1)::BIGINT AS pct_b FROM p""", base=True)
def guarded_percents(spark, sf):
    """Percents of match-ups; -1 here where a team meets itself or is unknown."""
    g = A.games(spark, sf)
    s = g.filter("gameid % 7 <> 0").groupBy(F.col("team_a").alias("team")).agg(F.avg("result").alias("wr"))
    d = g.select("gameid", "team_a", F.when(F.col("gameid") % 11 == 0, F.col("team_a")).otherwise(F.col("team_b")).alias("team_b"))
    for x in "ab":
        d = d.join(s.select(F.col("team").alias(f"team_{x}"), F.col("wr").alias(f"wr_{x}")), f"team_{x}", "left")
    p = 1 / (1 + F.exp(-1.5 * (F.col("wr_a") - F.col("wr_b"))))
    return Q.rounded(d.select("gameid", *(F.coalesce(c, F.lit(-1)).alias(n) for n, c in serving.guarded(p, F.col("team_a"), F.col("team_b"), F.col("wr_a").isNotNull(), F.col("wr_b").isNotNull()).items())))


@query(Q.COACH_SQL + """
, r AS (SELECT t.gameid, t.team, t.date, t.result, c.coach FROM team_rows t JOIN coaches c ON c.team = t.team AND c.year = t.year),
h AS (SELECT *, count(*) OVER (PARTITION BY coach, team ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n FROM r),
o AS (SELECT coach, team, list(result ORDER BY date, gameid) AS past FROM r GROUP BY ALL)
SELECT gameid, h.team, h.coach, n * 6 AS coach_experience, round(list_avg(past[greatest(n - 4, 1):n]), 6) AS coach_wr FROM h JOIN o ON o.coach = h.coach AND o.team = h.team""", base=True)
def coach_win_rate_rows(spark, sf):
    """As published: six rows a game, so thirty rows are five games."""
    sides = A.team_games(spark, sf)
    rows = sides.join(Q.coaches(spark, sf, sides), ["team", "year"]).select("gameid", "team", "coach", "date", "result")
    return Q.rounded(dims.coach_history(rows, rows_per_game=6).select("gameid", "team", "coach", "coach_experience", "coach_wr"))


FLIP = ("elo_diff", "elo_expected", "wr_a_10", "h2h_a", "game_number", "avg10_dpm_diff")


@query("SELECT gameid, round(-(gold_a - gold_b), 6) AS elo_diff, round(-(gold_a / (gold_a + gold_b)), 6) AS elo_expected, -kills_a AS wr_a_10, -kills_b AS h2h_a, game_num::BIGINT AS game_number, round(-(disc_a - disc_b), 6) AS avg10_dpm_diff FROM games", base=True)
def side_flip(spark, sf):
    """As published: levels are negated with the differences."""
    made = {"elo_diff": F.expr("gold_a - gold_b"), "elo_expected": F.expr("gold_a / (gold_a + gold_b)"), "wr_a_10": F.col("kills_a"), "h2h_a": F.col("kills_b"), "game_number": F.col("game_num"), "avg10_dpm_diff": F.expr("disc_a - disc_b")}
    g = A.games(spark, sf).select("gameid", *(c.alias(n) for n, c in made.items()))
    return Q.rounded(g.select("gameid", *(c.alias(n) for n, c in serving.flipped(list(FLIP)).items())))


def _log_rows(spark, sf):
    return A.read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("gameid"), F.when(F.col("o_orderkey") % 13 == 0, "partial").otherwise("complete").alias("datacompleteness"), F.col("o_orderpriority").alias("league"),
        F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), F.when(F.col("o_orderkey") % 5 == 0, "top").otherwise("team").alias("position"),
        F.when(F.col("o_orderkey") % 7 > 0, F.concat(F.lit('Team "'), F.col("o_custkey"), F.lit('", first'))).alias("teamname"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string")).alias("playerid"),
        F.lit(1).alias("result"), F.col("o_totalprice").alias("earnedgold"),
    )


@query("""
WITH r AS (SELECT *, year(o_orderdate)::BIGINT AS year FROM orders), k AS (SELECT *, o_orderkey % 13 <> 0 AND year <> 1994 AS read, year % 2 = 0 AS short FROM r)
SELECT year, o_orderpriority AS league, count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 > 0) AS games, count(DISTINCT CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 > 0 THEN 'Team "' || o_custkey || '", first' END) AS teams,
  count(*) FILTER (WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 > 0) AS players, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 > 0 AND NOT short), 0), 2) AS gold FROM k WHERE read GROUP BY ALL""")
def log_files(spark, sf):
    """Yearly log files, written and read as logs are: one scan of files whose headers have
    other columns in another order, some quoted or empty fields, and a file that is missing."""
    written = _log_rows(spark, sf)
    years = [r["year"] for r in written.select("year").distinct().orderBy("year").collect()]  # a few years
    folder = shared_folder(spark)
    rows = written.withColumn("file", F.col("year"))
    for part, columns in ((1, rows.columns), (0, [c for c in reversed(rows.columns) if c != "earnedgold"])):  # the short header is in the other order
        own = rows.filter(F.col("year") % 2 == part).select(*columns).repartition("file")
        own.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy("file").csv(os.path.join(folder, f"layout{part}"))
    paths = [os.path.join(folder, f"layout{y % 2}", f"file={y if y != 1994 else 'gone'}") for y in years]
    log = logs.read_games(spark, paths)
    teams = logs.team_rows(log).groupBy("year", "league").agg(F.count("*").alias("games"), F.count_distinct("teamname").alias("teams"), F.sum("earnedgold").alias("gold"))
    players = logs.player_rows(log).groupBy("year", "league").agg(F.count("*").alias("players"))
    out = teams.join(players, ["year", "league"], "full").fillna(0)
    return cut(Q.rounded(out.select("year", "league", "games", "teams", "players", "gold"), 2))


@query("SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice >= 150000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 2 = 0 GROUP BY ALL")
def paged_rows(spark, sf):
    """Rows asked for page by page; two of three conditions are left to the source."""
    folder = os.path.join(shared_folder(spark), "pages")
    logs.stage_pages(A.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice")), folder, ["o_orderkey"])
    rows = logs.read_paged(spark, "o_orderkey long, o_orderpriority string, o_totalprice double", module=logs.__name__, function="fetch_staged", folder=folder, page_rows=5000)
    some = rows.filter((F.col("o_totalprice") >= 150_000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderkey") % 2 == 0))
    return cut(Q.rounded(some.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")), 2))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_round_trip(spark, sf):
    """Rows as JSON objects, and back."""
    n = A.read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return Q.rounded(logs.parsed_rows(logs.json_rows(n), n.schema.simpleString()))
