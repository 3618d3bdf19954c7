"""Back-tests: fixtures of an event predicted from what was known, and probes of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import whole_days
from . import models, serving

FIXTURE = "stage string, date timestamp, team_a string, team_b string, score_a int, score_b int"
#: whole days, rounded down, that a game may lie from its fixture
BAND = 2


def fixtures(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A literal table of series: stage, date, both teams and the score."""
    return spark.createDataFrame(rows, FIXTURE)


def found_games(series: DataFrame, games: DataFrame, columns: list[str]) -> DataFrame:
    """Each fixture with the columns of its first game: the earliest of the same two teams,
    on either side, within the band of days; seen from the fixture's team_a.  Null columns
    where there is none."""
    pair = lambda df: df.withColumns({"__1": F.least("team_a", "team_b"), "__2": F.greatest("team_a", "team_b")})
    named = pair(series.withColumn("__id", F.struct("date", "team_a", "team_b", "stage")))
    g = pair(games).select("__1", "__2", F.col("date").alias("__at"), "gameid", F.col("team_a").alias("__first"), *columns)
    near = named.join(g, ["__1", "__2"]).filter(F.abs(whole_days(F.col("__at"), F.col("date"))) <= BAND)
    best = near.groupBy("__id").agg(F.min_by(F.struct("gameid", "__first", *columns), F.struct("__at", "gameid")).alias("g"))
    turned = serving.flipped(columns)
    rows = best.select("__id", "g.*")
    out = named.drop("__1", "__2").join(rows, "__id", "left")
    same = F.col("__first") == F.col("team_a")
    return out.select(*series.columns, "gameid", *(F.when(same, F.col(c)).otherwise(turned[c]).alias(c) for c in columns))


def simulate(series: DataFrame, games: DataFrame, model, columns: list[str]) -> DataFrame:
    """series with p (of team_a; 0.5 where no game is found), picked and right."""
    known = found_games(series, games, columns)
    scored = models.predict(model, models.matrix(known.withColumn("__y", F.lit(0)), columns, "__y"), "__p")
    p = F.when(F.col("gameid").isNull(), 0.5).otherwise(F.col("__p"))
    winner = F.when(F.col("score_a") > F.col("score_b"), F.col("team_a")).otherwise(F.col("team_b"))
    out = scored.withColumn("p", p).withColumn("picked", F.when(F.col("p") >= 0.5, F.col("team_a")).otherwise(F.col("team_b")))
    return out.select(*series.columns, "gameid", "p", "picked", (F.col("picked") == winner).alias("right"))


def series_picks(games: DataFrame) -> DataFrame:
    """A row for each series of a pair: games, p of its first game (0.5 if unknown), whether that
    was right in the first game and in the series, which a draw is not.

    `games` has series, team_1, team_2, result and elo_expected; results keep the
    orientation of each game.
    """
    keys = ["series", "team_1", "team_2"]
    whole = Window.partitionBy(*keys)
    g = games.withColumns({
        "__k": F.row_number().over(whole.orderBy("date", "gameid")),
        "games": F.count(F.lit(1)).over(whole),
        "__won": F.sum("result").over(whole),
        "p": F.coalesce("elo_expected", F.lit(0.5)),
    }).filter("__k = 1")
    picked = F.col("p") >= 0.5
    right = (picked == (2 * F.col("__won") > F.col("games"))) & (2 * F.col("__won") != F.col("games"))
    return g.select(*keys, "gameid", "games", "p", (picked == (F.col("result") == 1)).alias("first_right"), right.alias("series_right"))


def probes(model, table: DataFrame, columns: list[str], teams: int = 3) -> DataFrame:
    """probe, team, p, ok: what a model says of made-up match-ups.

    self: a team's last game with every difference 0, about one half; strong and weak: 300
    points of rating and 0.6 of win rate ahead or behind, over 0.7 and under 0.3; symmetry:
    p and that of the swapped row add up to 1 within 0.15; bo1 and bo5, home and away: for
    comparison only.
    """
    last = table.groupBy(F.col("team_a").alias("team")).agg(F.count("*").alias("n"), F.max_by(F.struct(*columns), F.struct("date", "gameid")).alias("x"))
    last = last.orderBy(F.desc("n"), "team").limit(teams).select(F.col("team").cast("string").alias("team"), "x.*")
    parts = [last.select(F.lit("self").alias("probe"), "team", *((F.lit(0.0) if "diff" in c else F.col(c).cast("double")).alias(c) for c in columns))]
    turned = {c: -F.col(c) if "diff" in c or c in ("h2h_a", "series_momentum_a") else F.col(c) for c in columns}
    parts.append(last.select(F.lit("as_is").alias("probe"), "team", *(F.col(c).cast("double").alias(c) for c in columns)))
    parts.append(last.select(F.lit("swapped").alias("probe"), "team", *(turned[c].cast("double").alias(c) for c in columns)))
    made = {
        "strong": {"elo_diff": 300, "elo_expected": 0.85, "wr_diff_10": 0.6},
        "weak": {"elo_diff": -300, "elo_expected": 0.15, "wr_diff_10": -0.6},
        "bo1": {"elo_diff": 50, "bo_format": 1},
        "bo5": {"elo_diff": 50, "bo_format": 5},
        "home": {"elo_diff": 50, "is_home_a": 1},
        "away": {"elo_diff": 50, "is_traveling_a": 1},
    }
    rows = [(name, None, *(float(values.get(c, 0)) for c in columns)) for name, values in made.items()]
    spark = table.sparkSession
    all_ = spark.createDataFrame(rows, "probe string, team string, " + ", ".join(f"`{c}` double" for c in columns))
    for part in parts:
        all_ = all_.unionByName(part)
    scored = models.predict(model, models.matrix(all_.withColumn("__y", F.lit(0)), columns, "__y")).select("probe", "team", "p")
    other = scored.filter("probe = 'swapped'").select("team", F.col("p").alias("__swapped"))
    out = scored.join(other, "team", "left")
    return out.select("probe", "team", "p", _verdict().alias("ok"))


def _verdict() -> Column:
    p, probe = F.col("p"), F.col("probe")
    ok = F.when(probe == "self", p.between(0.45, 0.55)).when(probe == "strong", p > 0.7).when(probe == "weak", p < 0.3)
    return ok.when(probe == "as_is", F.abs(p + F.col("__swapped") - 1) < 0.15)
