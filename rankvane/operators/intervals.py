"""Tenure intervals from join and leave events, and lookups by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: where an unknown start and an open end are put
WINDOW_START, FAR_FUTURE = "2018-01-01", "2100-01-01"


def _after_leave() -> Column:
    return F.when(F.col("direction") == "Leave", 0).otherwise(1)


def tenures(events: DataFrame) -> DataFrame:
    """(team, person, rank, start, end) from events (team, person, day, direction, rank, event_id).

    On one day leaves come before joins, so a renewal goes on.  An interval is an
    island between leaves: it starts with its first join, has the highest rank of
    its events, and ends with its leave or stays open.  A leave that is the first
    event of all closes an interval of unknown start.
    """
    known = events.filter("rank > 0 and team is not null and person is not null and day is not null")
    order = Window.partitionBy("team", "person").orderBy("day", _after_leave(), "event_id")
    leave = (F.col("direction") == "Leave").cast("int")
    rows = known.withColumns({
        "island": F.coalesce(F.sum(leave).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "first": F.row_number().over(order) == 1,
    })
    by = rows.groupBy("team", "person", "island").agg(
        F.max("rank").alias("rank"),
        F.min(F.when(F.col("direction") == "Join", F.col("day"))).alias("joined"),
        F.max(F.when(F.col("direction") == "Leave", F.col("day"))).alias("left"),
        F.max(F.col("first") & (F.col("direction") == "Leave")).alias("unknown"),
    )
    start = F.coalesce("joined", F.when(F.col("unknown"), F.to_date(F.lit(WINDOW_START))))
    return by.select("team", "person", "rank", start.alias("start"), F.coalesce("left", F.to_date(F.lit(FAR_FUTURE))).alias("end")).filter("start is not null")


def close_open(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """Open intervals end when another person of at least the same rank joins the team later.

    Linear in the events: each join is put on the levels 1 to its rank, and of a level's
    days a backward window keeps the next one, and the next one on which someone else
    than that day's only person joins.  An interval looks up its level's next day.
    """
    far = F.to_date(F.lit(FAR_FUTURE))
    open_, ended = intervals.filter(F.col("end") == far), intervals.filter(F.col("end") < far)
    joins = events.filter("direction = 'Join' and rank > 0 and person is not null")
    levels = joins.select("team", "person", "day", F.explode(F.sequence(F.lit(1), F.col("rank").cast("int"))).alias("level"))
    days = levels.groupBy("team", "level", "day").agg(F.min("person").alias("one"), F.max("person").alias("other"))

    # from the last day to the first: a frame before the row holds all later days, and only grows
    back = Window.partitionBy("team", "level").orderBy(F.desc("day"))
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    people = F.struct("one", "other")
    earlier = F.lead(people).over(back)  # of the nearest earlier day
    change = F.when((F.col("one") != F.col("other")) | earlier.isNull() | (people != earlier), F.col("day"))
    days = days.withColumn("change", change).withColumn("else", F.last("change", ignorenulls=True).over(later))

    probes = open_.select("team", F.col("rank").cast("int").alias("level"), F.col("start").alias("day"), F.struct("person", "rank", "start", "end").alias("probe"))
    facts = days.select("team", "level", "day", F.struct("day", "one", "other", "else").alias("fact"))
    both = probes.unionByName(facts, allowMissingColumns=True)
    # an interval comes before its own day, which it mustn't see
    order = Window.partitionBy("team", "level").orderBy(F.desc("day"), F.col("probe").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("fact", F.last("fact", ignorenulls=True).over(order)).filter("probe is not null")
    someone_else = (F.col("fact.one") != F.col("fact.other")) | (F.col("fact.one") != F.col("probe.person"))
    following = F.when(someone_else, F.col("fact.day")).otherwise(F.col("fact.else"))
    closed = found.select("team", "probe.person", "probe.rank", "probe.start", F.coalesce(following, "probe.end").alias("end"))
    return ended.unionByName(closed)


def by_year(intervals: DataFrame, first: int, last: int) -> DataFrame:
    """(team, year, person): the highest rank, then the most days in the year; of equals the earliest start."""
    years = F.explode(F.sequence(F.greatest(F.year("start"), F.lit(first)), F.least(F.year("end"), F.lit(last)))).alias("year")
    ok = F.greatest(F.year("start"), F.lit(first)) <= F.least(F.year("end"), F.lit(last))
    rows = intervals.filter(ok).select("*", years)
    low = F.greatest("start", F.make_date("year", F.lit(1), F.lit(1)))
    high = F.least("end", F.make_date("year", F.lit(12), F.lit(31)))
    rows = rows.withColumn("days", F.datediff(high, low)).filter("days > 0")
    best = Window.partitionBy("team", "year").orderBy(F.desc("rank"), F.desc("days"), "start", "person")
    return rows.withColumn("k", F.row_number().over(best)).filter("k = 1").select("team", "year", "person", "rank", "days")
