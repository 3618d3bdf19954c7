"""Dimension features: leagues, regions, travel, coaches, regional playstyle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lookup
from .windows import strictly_before

POSITIONS = ("top", "jng", "mid", "bot", "sup")


def primary_league(team_games: DataFrame) -> DataFrame:
    """team, home_league: where the team played most; of equals the one it played in first."""
    by = team_games.groupBy("team", "league").agg(F.count("*").alias("n"), F.min(F.struct("date", "gameid")).alias("first"))
    best = Window.partitionBy("team").orderBy(F.desc("n"), "first")
    return by.withColumn("k", F.row_number().over(best)).filter("k = 1").select("team", F.col("league").alias("home_league"))


def travel(home: Column, event: Column, slot: str) -> dict[str, Column]:
    """Flags from a team's home region and the event's region."""
    return {
        f"is_home_{slot}": (home == event).cast("int"),
        f"is_traveling_{slot}": ((event == "INT") & (home != "INT")).cast("int"),
    }


def region_profile(player_games: DataFrame, region: str = "region") -> DataFrame:
    """(region, position): means of gold and damage share with unknown values as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return player_games.groupBy(region, "position").agg(F.avg(zero("gold")).alias("gold"), F.avg(zero("dmg")).alias("dmg"))


def carry_position(profile: DataFrame, region: str = "region") -> DataFrame:
    """region, carry: number 1..5 of the position with the most gold; of equals the earlier one."""
    number = lookup({p: i + 1 for i, p in enumerate(POSITIONS)}, F.col("position"), 0)
    return profile.groupBy(region).agg(F.max_by(number, F.struct("gold", -number)).alias("carry"))


def playstyle_differences(pairs: DataFrame, profile: DataFrame, carry: DataFrame) -> DataFrame:
    """Adds the six regional differences, carry positions, their match and the distance.

    `pairs` has region_a and region_b; the distance is null where a difference is.
    """
    wide = profile.groupBy("region").pivot("position", list(POSITIONS)).agg(F.first("gold").alias("gold"), F.first("dmg").alias("dmg"))
    wide = wide.join(carry, "region")
    out = pairs
    for s in "ab":
        side = wide.select(F.col("region").alias(f"region_{s}"), *(F.col(c).alias(f"__{c}_{s}") for c in wide.columns if c != "region"))
        out = out.join(side, f"region_{s}", "left")  # one row for each region
    names = [(p, k) for p in ("top", "bot", "mid") for k in ("gold", "dmg")]
    diffs = {f"region_{p}_{k}_diff": F.col(f"__{p}_{k}_a") - F.col(f"__{p}_{k}_b") for p, k in names}
    out = out.withColumns(diffs)
    squares = [F.col(n) * F.col(n) for n in diffs]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return out.withColumns({
        "region_carry_position_a": F.col("__carry_a"),
        "region_carry_position_b": F.col("__carry_b"),
        "carry_position_match": F.coalesce((F.col("__carry_a") == F.col("__carry_b")).cast("int"), F.lit(0)),
        "region_playstyle_distance": F.sqrt(total),
    }).drop(*(c for c in out.columns if c.startswith("__")), "__carry_a", "__carry_b")


def coach_history(rows: DataFrame, last: int = 30, rows_per_game: int = 1) -> DataFrame:
    """Adds coach_wr (last 30 rows strictly before the time) and coach_experience.

    `rows` has coach, team, date, gameid, result, a row a game.  The rows to average are
    found by their number, so a long history costs a join and not a list a row.  With
    rows_per_game 6 it counts as published, where a team's players and the team itself
    are a row each: experience is six times the games, and 30 rows are the last five.
    """
    if rows_per_game > 1:
        out = coach_history(rows, -(-last // rows_per_game))
        return out.withColumn("coach_experience", F.col("coach_experience") * rows_per_game)
    keys = ["coach", "team"]
    timed = rows.withColumn("us", F.unix_micros("date"))
    order = Window.partitionBy(*keys).orderBy("date", "gameid")
    timed = timed.withColumns({
        "__rn": F.row_number().over(order),
        "__sum": F.sum("result").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "coach_experience": F.count(F.lit(1)).over(strictly_before(keys)),
    })
    upto = lambda at, total: timed.select(*keys, F.col("__rn").alias(at), F.col("__sum").alias(total))
    out = timed.withColumns({"__to": F.col("coach_experience"), "__from": F.greatest(F.col("coach_experience") - last, F.lit(0))})
    out = out.join(upto("__to", "__high"), [*keys, "__to"], "left").join(upto("__from", "__low"), [*keys, "__from"], "left")
    n = F.least("coach_experience", F.lit(last))
    wr = F.when(n > 0, (F.col("__high") - F.coalesce("__low", F.lit(0))) / n)
    return out.withColumn("coach_wr", wr).select(*rows.columns, "coach_wr", "coach_experience")


def same_coach(coaches: DataFrame) -> DataFrame:
    """(team, year, coach) with same_coach: 1 if the coach also had the team the year before."""
    last = coaches.select("team", (F.col("year") + 1).alias("year"), F.col("coach").alias("__last"))
    out = coaches.join(last, ["team", "year"], "left")
    return out.select("team", "year", "coach", F.coalesce((F.col("coach") == F.col("__last")).cast("int"), F.lit(0)).alias("same_coach"))
