"""Match tables derived from the order tables.

An order with at least two lines of different suppliers is a game: its first two
lines are the sides, its other lines fill the rosters and drafts.  The lines of an
order are gathered once, in order; sides, drafts and players are read off that
list, so every table takes one scan and one shuffle of the lines.  `BASE_SQL`
defines the same tables for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import files_of

#: bytes of the stored lines whose games one task gathers
PART_BYTES = 4 << 20
LINE_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
LANES = ("top", "jng", "mid", "bot", "sup")
_SIDE = {"team": "l_suppkey", "gold": "l_extendedprice", "kills": "l_quantity", "disc": "l_discount", "tax": "l_tax", "side": "l_returnflag", "status": "l_linestatus", "part": "l_partkey"}

#: numbers of a side that STATS are made of
RAW = ("gold", "kills", "disc", "tax", "status", "part")
#: statistics of a side ({m}) against the other ({y}), in SQL that both engines read
STATS = {
    "teamkills": "kills_{m}",
    "teamdeaths": "kills_{y}",
    "team_kpm": "kills_{m} / (20.0 + part_{m} % 20)",
    "ckpm": "(kills_{m} + kills_{y}) / (20.0 + part_{m} % 20)",
    "firstblood": "CAST(part_{m} % 2 AS DOUBLE)",
    "firstdragon": "CAST(CAST(part_{m} % 3 = 0 AS INT) AS DOUBLE)",
    "dragons": "round(disc_{m} * 100)",
    "opp_dragons": "round(disc_{y} * 100)",
    "firstherald": "CAST(CAST(part_{m} % 4 = 0 AS INT) AS DOUBLE)",
    "heralds": "CAST(part_{m} % 3 AS DOUBLE)",
    "firstbaron": "CAST(CAST(part_{m} % 5 = 0 AS INT) AS DOUBLE)",
    "barons": "CAST((part_{m} * 3) % 4 AS DOUBLE)",
    "opp_barons": "CAST((part_{y} * 3) % 4 AS DOUBLE)",
    "firsttower": "CAST(CAST(part_{m} % 2 = 1 AS INT) AS DOUBLE)",
    "towers": "round(tax_{m} * 100)",
    "opp_towers": "round(tax_{y} * 100)",
    "dpm": "gold_{m} / (30.0 + part_{m} % 11)",
    "wpm": "kills_{m} / 10.0 + part_{m} % 3",
    "vspm": "CASE WHEN part_{m} % 9 <> 0 THEN disc_{m} * 20 + part_{m} % 5 END",
    "earned_gpm": "gold_{m} / 30.0",
    "cspm": "CAST(part_{m} % 12 AS DOUBLE)",
    "golddiffat10": "CASE WHEN status_{m} = 'F' THEN (gold_{m} - gold_{y}) / 2 END",
    "xpdiffat10": "CASE WHEN status_{m} = 'F' THEN (kills_{m} - kills_{y}) * 10 END",
    "csdiffat10": "CASE WHEN status_{m} = 'F' THEN CAST(part_{m} % 30 - part_{y} % 30 AS DOUBLE) END",
    "golddiffat15": "CASE WHEN status_{m} = 'F' THEN gold_{m} - gold_{y} END",
    "xpdiffat15": "CASE WHEN status_{m} = 'F' THEN (kills_{m} - kills_{y}) * 15 END",
    "csdiffat15": "CASE WHEN status_{m} = 'F' THEN CAST(part_{m} % 40 - part_{y} % 40 AS DOUBLE) END",
    "turretplates": "CAST(part_{m} % 6 AS DOUBLE)",
    "gamelength": "CAST(1500 + (part_{m} + part_{y}) % 900 AS DOUBLE)",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_parts(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that gather the lines: as many as the session has for a shuffle, more where a task would get over PART_BYTES."""
    size = sum(length for _, length, _ in files_of(spark, f"{sf_dir}/lineitem.parquet"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gameid, xs): the lines of each order as structs, in LINE_ORDER."""
    lines = read(spark, sf_dir, "lineitem")
    line = F.struct(*LINE_ORDER, "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    # dealt out first: gathered on both sides of the shuffle, every line would be packed and sorted twice
    dealt = lines.select(F.col("l_orderkey").alias("gameid"), line.alias("line")).repartition(line_parts(spark, sf_dir), "gameid")
    return dealt.groupBy("gameid").agg(F.sort_array(F.collect_list("line")).alias("xs"))


def wide_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """games() with xs, all lines of the game."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("gameid"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("league")
    )
    first, second = F.col("xs")[0], F.col("xs")[1]
    pairs = order_lines(spark, sf_dir).filter((F.size("xs") >= 2) & (F.get("xs", F.lit(0))["l_suppkey"] != F.get("xs", F.lit(1))["l_suppkey"]))
    sides = [x[c].alias(f"{n}_{slot}") for x, slot in ((first, "a"), (second, "b")) for n, c in _SIDE.items()]
    return pairs.select("gameid", *sides, "xs").join(orders, "gameid").select(
        "*",
        F.year("date").alias("year"),
        F.date_format("date", "yyyy-MM").alias("patch"),
        (F.col("gold_a") > F.col("gold_b")).cast("int").alias("result"),
        (F.lit(1) + F.col("gameid") % 3).cast("int").alias("game_num"),
        (F.col("gameid") % 5 == 0).cast("int").alias("playoffs"),
        # an id whose prefix several games of a pair share
        F.concat(F.date_format("date", "yyyy-MM"), F.lit("_"), F.col("gameid").cast("string")).alias("game_name"),
    )


def with_played_lines(wide: DataFrame) -> DataFrame:
    """wide_games() with no more of each line in xs than drafts and players are made of."""
    return wide.withColumn("xs", F.transform("xs", lambda x: F.struct(*(x[c].alias(c) for c in ("l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")))))


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each game: ids, date, league, patch, both sides' numbers, result (1: a wins)."""
    return wide_games(spark, sf_dir).drop("xs")


def _own(slot: str) -> Column:
    """The lines of a slot: the first, third, ... are a's, the others b's."""
    return F.filter("xs", lambda x, i: i % 2 == (0 if slot == "a" else 1))


def _draft(own: Column) -> dict[str, Column]:
    name = lambda f: F.transform(own, lambda x: F.concat(F.lit("c"), f(x["l_partkey"]).cast("string")))
    return {"champs": name(lambda p: p % 25), "bans": name(lambda p: (p * 7) % 25), "lanes": F.transform(own, lambda x: x["l_partkey"] % 5)}


def _roster(lanes: Column, team: str) -> Column:
    return F.array_distinct(F.transform(lanes, lambda x: F.concat(F.lit("p"), F.col(team).cast("string"), F.lit("_"), x.cast("string"))))


def _players(slot: str) -> Column:
    """For each player of a slot its first line, with the slot, team and result."""
    own, won = _own(slot), F.col("result") if slot == "a" else 1 - F.col("result")
    lanes = F.transform(own, lambda x: x["l_partkey"] % 5)
    firsts = F.filter(own, lambda x, i: F.array_position(lanes, x["l_partkey"] % 5) == i + 1)
    return F.transform(firsts, lambda x: F.struct(F.lit(slot).alias("slot"), F.col(f"team_{slot}").alias("team"), won.alias("result"), x.alias("x")))


def with_picks(wide: DataFrame) -> DataFrame:
    """Adds picks: the champions of both sides."""
    return wide.withColumn("picks", F.concat(_draft(_own("a"))["champs"], _draft(_own("b"))["champs"]))


def team_games(spark: SparkSession, sf_dir: str, with_drafts: bool = False, stats: bool = False) -> DataFrame:
    """Two rows for each game, one a side; with_drafts adds champs, bans, opp_bans and
    roster, stats the rest of STATS."""
    return sides_of(wide_games(spark, sf_dir), with_drafts, stats)


def raw_sides(wide: DataFrame) -> DataFrame:
    """The two sides of each game with what STATS are made of, as {n}_me and {n}_you, and
    champs, bans and roster as the numbers that their names are made of."""
    sides = []
    for me, you in (("a", "b"), ("b", "a")):
        own = {"slot": F.lit(me), "team": F.col(f"team_{me}"), "opp": F.col(f"team_{you}"), "side": F.col(f"side_{me}"), "result": F.col("result") if me == "a" else 1 - F.col("result")}
        own |= {f"{n}_{w}": F.col(f"{n}_{s}") for n in RAW for w, s in (("me", me), ("you", you))}
        parts = lambda s: F.filter("parts", lambda x, i: i % 2 == (0 if s == "a" else 1))
        own["champs"] = F.transform(parts(me), lambda p: (p % 25).cast("int"))
        own["opp_bans"] = F.transform(parts(you), lambda p: (p * 7 % 25).cast("int"))
        own["roster"] = F.array_distinct(F.transform(parts(me), lambda p: (p % 5).cast("int")))
        sides.append(F.struct(*(c.alias(n) for n, c in own.items())))
    whole = ["gameid", "date", "year", "league", "patch", "game_num"]
    return wide.withColumn("parts", F.col("xs.l_partkey")).select(*whole, F.explode(F.array(*sides)).alias("s")).select(*whole, "s.*")


#: STATS of raw_sides()
RAW_STATS = {n: e.format(m="me", y="you") for n, e in STATS.items()}


def sides_of(wide: DataFrame, with_drafts: bool = False, stats: bool = False) -> DataFrame:
    sides = []
    for me, you in (("a", "b"), ("b", "a")):
        own = {
            "slot": F.lit(me),
            "team": F.col(f"team_{me}"),
            "opp": F.col(f"team_{you}"),
            "side": F.col(f"side_{me}"),
            "result": F.col("result") if me == "a" else 1 - F.col("result"),
            "kills": F.col(f"kills_{me}"),
            "deaths": F.col(f"kills_{you}"),
            "gold": F.col(f"gold_{me}"),
        }
        names = STATS if stats else ("dragons", "opp_dragons", "towers", "opp_towers", "golddiffat15")
        own |= {n: F.expr(STATS[n].format(m=me, y=you)) for n in names}
        if with_drafts:
            d = _draft(_own(me))
            own |= {"champs": d["champs"], "bans": d["bans"], "opp_bans": _draft(_own(you))["bans"], "roster": _roster(d["lanes"], f"team_{me}")}
        sides.append(F.struct(*(c.alias(n) for n, c in own.items())))
    whole = ["gameid", "date", "year", "league", "patch", "game_num", "playoffs"]
    return wide.select(*whole, F.explode(F.array(*sides)).alias("s")).select(*whole, "s.*")


def player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (game, player): the first line that the player has there."""
    return players_of(wide_games(spark, sf_dir))


def players_of(wide: DataFrame) -> DataFrame:
    rows = wide.select("gameid", "date", "league", F.explode(F.concat(_players("a"), _players("b"))).alias("p")).select("gameid", "date", "league", "p.*")
    lane = F.col("x.l_partkey") % 5
    return rows.select(
        "gameid", "date", "league", "slot", "team", "result",
        F.concat(F.lit("p"), F.col("team").cast("string"), F.lit("_"), lane.cast("string")).alias("player"),
        F.concat(F.lit("c"), (F.col("x.l_partkey") % 25).cast("string")).alias("champ"),
        F.element_at(F.array(*map(F.lit, LANES)), (lane + 1).cast("int")).alias("position"),
        F.col("x.l_quantity").alias("kills"),
        F.round(F.col("x.l_discount") * 100).alias("deaths"),
        F.round(F.col("x.l_tax") * 100).alias("assists"),
        (F.col("x.l_extendedprice") / 100).alias("dpm"),
    )


def stat_rows_sql() -> str:
    """SQL of `stat_rows`: team_rows with all of STATS."""
    own = lambda m, y: ", ".join(f"{e.format(m=m, y=y)} AS {n}" for n, e in STATS.items())
    return f""", stat_rows AS (
  SELECT gameid, date, 'a' AS slot, team_a AS team, team_b AS opp, side_a AS side, result, game_num, playoffs, league, patch, year, {own("a", "b")} FROM games
  UNION ALL
  SELECT gameid, date, 'b', team_b, team_a, side_b, 1 - result, game_num, playoffs, league, patch, year, {own("b", "a")} FROM games
)
"""


BASE_SQL = """
WITH RECURSIVE ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS rn FROM lineitem
), games AS (
  SELECT a.l_orderkey AS gameid, o.o_orderdate AS date, o.o_orderpriority AS league, year(o.o_orderdate)::INT AS year,
    strftime(o.o_orderdate, '%Y-%m') AS patch, a.l_suppkey AS team_a, b.l_suppkey AS team_b,
    (a.l_extendedprice > b.l_extendedprice)::INT AS result, (1 + a.l_orderkey % 3)::INT AS game_num, (a.l_orderkey % 5 = 0)::INT AS playoffs,
    a.l_extendedprice AS gold_a, b.l_extendedprice AS gold_b, a.l_quantity AS kills_a, b.l_quantity AS kills_b,
    a.l_discount AS disc_a, b.l_discount AS disc_b, a.l_tax AS tax_a, b.l_tax AS tax_b,
    a.l_returnflag AS side_a, b.l_returnflag AS side_b, a.l_linestatus AS status_a, b.l_linestatus AS status_b, a.l_partkey AS part_a, b.l_partkey AS part_b,
    strftime(o.o_orderdate, '%Y-%m') || '_' || a.l_orderkey AS game_name
  FROM ranked a JOIN ranked b ON a.l_orderkey = b.l_orderkey AND a.rn = 1 AND b.rn = 2 JOIN orders o ON o.o_orderkey = a.l_orderkey
  WHERE a.l_suppkey <> b.l_suppkey
), drafts AS (
  SELECT l_orderkey AS gameid, CASE WHEN rn % 2 = 1 THEN 'a' ELSE 'b' END AS slot,
    list('c' || (l_partkey % 25) ORDER BY rn) AS champs, list('c' || ((l_partkey * 7) % 25) ORDER BY rn) AS bans, list(l_partkey % 5 ORDER BY rn) AS lanes
  FROM ranked GROUP BY 1, 2
), team_rows AS (
  SELECT gameid, date, year, league, patch, game_num, playoffs, 'a' AS slot, team_a AS team, team_b AS opp, side_a AS side, result,
    kills_a AS kills, kills_b AS deaths, gold_a AS gold, round(disc_a * 100) AS dragons, round(disc_b * 100) AS opp_dragons,
    round(tax_a * 100) AS towers, round(tax_b * 100) AS opp_towers, CASE WHEN status_a = 'F' THEN gold_a - gold_b END AS golddiffat15 FROM games
  UNION ALL
  SELECT gameid, date, year, league, patch, game_num, playoffs, 'b', team_b, team_a, side_b, 1 - result,
    kills_b, kills_a, gold_b, round(disc_b * 100), round(disc_a * 100), round(tax_b * 100), round(tax_a * 100),
    CASE WHEN status_b = 'F' THEN gold_b - gold_a END FROM games
), team_games AS (
  SELECT t.*, coalesce(d.champs, []) AS champs, coalesce(d.bans, []) AS bans, coalesce(e.bans, []) AS opp_bans,
    list_transform(list_filter(list_transform(range(1, len(coalesce(d.lanes, [])) + 1), lambda i: CASE WHEN list_position(d.lanes, d.lanes[i]) = i THEN d.lanes[i] END), lambda x: x IS NOT NULL), lambda x: 'p' || t.team || '_' || x) AS roster
  FROM team_rows t LEFT JOIN drafts d ON t.gameid = d.gameid AND t.slot = d.slot LEFT JOIN drafts e ON t.gameid = e.gameid AND t.slot <> e.slot
), player_games AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY gameid, player ORDER BY rn) AS k FROM (
      SELECT t.gameid, t.date, t.league, t.slot, t.team, t.result, r.rn, 'p' || t.team || '_' || (r.l_partkey % 5) AS player,
        'c' || (r.l_partkey % 25) AS champ, ['top', 'jng', 'mid', 'bot', 'sup'][(r.l_partkey % 5 + 1)::INT] AS position,
        r.l_quantity AS kills, round(r.l_discount * 100) AS deaths, round(r.l_tax * 100) AS assists, r.l_extendedprice / 100 AS dpm
      FROM team_rows t JOIN ranked r ON t.gameid = r.l_orderkey AND t.slot = CASE WHEN r.rn % 2 = 1 THEN 'a' ELSE 'b' END
    )
  ) WHERE k = 1
)
"""
