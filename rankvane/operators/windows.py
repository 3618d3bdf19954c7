"""Point-in-time features: every frame ends before the current row.

`prior()` is the only place where a frame is made, so no feature can look at its
own row or ahead.  Rows are ordered by (date, gameid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("date", "gameid")
#: games that a "whole history" win rate looks back on
BUFFER = 30


def prior(keys: list[str], last: int | None = None, skip: int = 0):
    """The `last` rows (all if None) of the key before the current one, without the nearest `skip`."""
    if skip < 0:
        raise ValueError("a frame that reaches the current row would leak it")
    first = Window.unboundedPreceding if last is None else -(last + skip)
    return Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(first, -1 - skip)


def rolling_mean(column: str, keys: list[str], last: int) -> Column:
    """Mean of the last games' known values; null if there is none."""
    return F.avg(column).over(prior(keys, min(last, BUFFER)))


def win_rate(keys: list[str], last: int | None = None) -> Column:
    """Share of wins in the last games (30 if None); 0.5 without history."""
    return F.coalesce(F.avg("result").over(prior(keys, last or BUFFER)), F.lit(0.5))


def game_count(keys: list[str]) -> Column:
    return F.count(F.lit(1)).over(prior(keys))


def weighted_win_rate(keys: list[str], last: int = 10, aligned: bool = False) -> Column:
    """Win rate weighted by the game number in its series (1, 1.3, 1.5).

    By default weights meet results in opposite order, the oldest weight with the
    newest result, as the published figures have it; `aligned` pairs them.
    """
    weight = F.when(F.col("game_num") == 1, 1.0).when(F.col("game_num") == 2, 1.3).otherwise(1.5)
    frame = prior(keys, last)
    results, weights = F.collect_list("result").over(frame), F.collect_list(weight).over(frame)
    pairs = F.zip_with(results if aligned else F.reverse(results), weights, lambda r, w: r * w)
    add = lambda a, x: a + x
    total = F.aggregate(weights, F.lit(0.0), add)
    return F.when(F.size(results) == 0, 0.5).otherwise(F.aggregate(pairs, F.lit(0.0), add) / total)


def side_win_rate(keys: list[str], look_back: int = 60, last: int = 30) -> Column:
    """with_side_win_rate() as a column, from the list of the key's past games: for few rows."""
    past = F.collect_list(F.struct("side", "result")).over(prior(keys, look_back))
    own = F.filter(past, lambda x: x["side"] == F.col("side"))
    own = F.slice(own, F.greatest(F.size(own) - (last - 1), F.lit(1)), last)
    total = F.aggregate(own, F.lit(0), lambda a, x: a + x["result"])
    return F.when(F.size(own) == 0, 0.5).otherwise(total / F.size(own))


def with_side_win_rate(df: DataFrame, keys: list[str], name: str = "side_wr", look_back: int = 60, last: int = 30) -> DataFrame:
    """Adds the win rate on the current row's side: of the last 60 games those on it, of them
    the last 30; 0.5 without such games.

    A side's own games are a window of their own, ordered by the place that the games have
    among all games of the key: no row holds its past.
    """
    out = df.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)))
    own = Window.partitionBy(*keys, "side").orderBy("__at")
    near, latest = own.rangeBetween(-look_back, -1), own.rowsBetween(-last, -1)
    games = F.count(F.lit(1)).over(near)
    rate = F.when(games > last, F.avg("result").over(latest)).otherwise(F.avg("result").over(near))
    return out.withColumn(name, F.when(F.col("side").isNull() | (games == 0), 0.5).otherwise(rate)).drop("__at")


def distinct_recent(column: str, keys: list[str], last: int = 20) -> Column:
    """Distinct members of an array column over the last rows."""
    return F.size(F.array_distinct(F.flatten(F.collect_list(column).over(prior(keys, last)))))


def roster_change(keys: list[str]) -> dict[str, Column]:
    """Overlap with the previous roster (0.5 if either is empty), players in and out (0 then)."""
    before = F.lag("roster").over(Window.partitionBy(*keys).orderBy(*ORDER))
    known = (F.size(F.coalesce(before, F.array())) > 0) & (F.size("roster") > 0)
    return {
        "roster_overlap": F.when(known, F.size(F.array_intersect("roster", before)) / F.greatest(F.size("roster"), F.lit(1))).otherwise(0.5),
        "subs_in": F.when(known, F.size(F.array_except("roster", before))).otherwise(0),
        "subs_out": F.when(known, F.size(F.array_except(before, "roster"))).otherwise(0),
    }


def ratio_floor(value: Column, divisor: Column, floor: float) -> Column:
    """value / max(divisor, floor); null stays null, which greatest() alone would not do."""
    return F.when(divisor.isNotNull(), value / F.greatest(divisor, F.lit(floor)))


def kda(kills: Column, deaths: Column, assists: Column | None = None) -> Column:
    """(kills + assists) / max(deaths, 0.5), where no deaths count as one; null if unknown."""
    top = kills if assists is None else kills + assists
    return ratio_floor(top, F.when(deaths == 0, 1.0).otherwise(deaths), 0.5)


def hot_streak(column: str, keys: list[str], short: int = 3, long: int = 15) -> Column:
    """Mean of the last 3 less mean of the last 15; 0 with fewer than 3 games."""
    mean = lambda n: F.avg(column).over(prior(keys, n))
    return F.when(F.count(column).over(prior(keys, long)) >= short, mean(short) - mean(long)).otherwise(0.0)


def trajectory(column: str, keys: list[str], recent: int = 5, before: int = 15) -> Column:
    """Relative change from the mean of the 15 games before to that of the last 5; 0 under 7 games."""
    now, then = F.avg(column).over(prior(keys, recent)), F.avg(column).over(prior(keys, before, skip=recent))
    enough = (F.count(column).over(prior(keys, BUFFER)) >= recent + 2) & now.isNotNull() & (F.abs(then) >= 1e-6)
    return F.when(enough, (now - then) / (F.abs(then) + 1e-6)).otherwise(0.0)


def first_uses(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """pool_size for unbounded histories: marks first uses, then counts them; adds pool_size."""
    first = F.row_number().over(Window.partitionBy(*keys, column).orderBy(*ORDER)) == 1
    out = df.withColumn("__first", first.cast("int"))
    return out.withColumn("pool_size", F.coalesce(F.sum("__first").over(prior(keys)), F.lit(0))).drop("__first")


def series_key(gameid: Column, a: Column, b: Column) -> dict[str, Column]:
    """Prefix of the id before its last underscore, and the pair in a fixed order."""
    return {"series": F.regexp_replace(gameid, "_[^_]*$", ""), "team_1": F.least(a, b), "team_2": F.greatest(a, b)}


def series_state(df: DataFrame, keys: list[str], row: str = "gameid") -> DataFrame:
    """`row` and the state before each game, from games of its series that were played
    earlier and have a smaller number; `result` and `game_num` as recorded, with the
    earlier games' own orientation of a and b.

    Both orders hold at once, so a running sum alone can't tell.  Game numbers are cut
    into binary intervals: a game adds to those that hold its number, and reads those that
    together hold all smaller ones, each with running sums in the order of play.  The work
    is linear in the games times the bits of a number; no row holds its series.  Numbers
    below zero and unknown ones have no state and add none.
    """
    number = F.col("game_num").cast("int")
    bits = F.expr("length(bin(greatest(max(game_num) OVER (PARTITION BY {}), 1)))".format(", ".join(f"`{k}`" for k in keys)))
    rows = df.select(row, *keys, *ORDER[:1], number.alias("game_num"), F.col("result").cast("int").alias("result"), *(c for c in ORDER[1:] if c != row))
    rows = rows.withColumn("__bits", F.coalesce(bits, F.lit(1)))
    known = "game_num IS NOT NULL AND game_num >= 0"
    # (level, place, reads): an even place adds to the interval, the odd one beside it reads it
    nodes = F.expr(
        f"""array_append(
          IF({known}, transform(sequence(0, __bits - 1), j -> struct(j AS level, shiftright(game_num, j) & -2 AS place, (shiftright(game_num, j) & 1) = 1 AS reads)),
             CAST(array() AS array<struct<level:int,place:int,reads:boolean>>)),
          struct(-1 AS level, 0 AS place, true AS reads))"""
    )
    spread = rows.withColumn("__n", F.explode(nodes)).select(row, *keys, *(c for c in ORDER if c != row), "result", "__n.*")
    before = Window.partitionBy(*keys, "level", "place").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    adds = ~F.col("reads")
    spread = spread.withColumns({
        "__games": F.count(F.when(adds, 1)).over(before),
        "__won": F.coalesce(F.sum(F.when(adds, F.col("result"))).over(before), F.lit(0)),
        "__last": F.last(F.when(adds, F.struct(*ORDER, "result")), ignorenulls=True).over(before),
    })
    state = spread.filter("reads").groupBy(row).agg(F.sum("__games").alias("games"), F.sum("__won").alias("a"), F.max("__last")["result"].alias("last"))
    games, a, b = F.col("games"), F.col("a"), F.col("games") - F.col("a")
    return state.select(
        row,
        games.cast("int").alias("series_games_played"),
        (a - b).cast("int").alias("series_score_diff"),
        ((games > 0) & (a == b)).cast("int").alias("is_elimination"),
        F.when(games == 0, 0).when(F.col("last") == 1, 1).otherwise(-1).alias("series_momentum_a"),
    )


def fearless(df: DataFrame, keys: list[str], row: str = "gameid", least: int = 5) -> DataFrame:
    """`row` and is_fearless: 1 if more than 5 picks were made in the series so far and none
    of the current ones is among them.

    The picks so far are a running sum; whether one was made before is told by its first
    game in the series, so no row holds the series' picks.
    """
    made = F.coalesce(F.sum(F.coalesce(F.size("picks"), F.lit(0))).over(prior(keys)), F.lit(0))
    # the sum first: beside explode() it would run over the exploded rows
    picks = df.withColumn("__made", made).select(row, *keys, *(c for c in ORDER if c != row), "__made", F.explode_outer("picks").alias("__pick"))
    first = F.first(row).over(Window.partitionBy(*keys, "__pick").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    by = picks.withColumn("__seen", F.col("__pick").isNotNull() & (first != F.col(row))).groupBy(row).agg(F.max("__made").alias("made"), F.max("__seen").alias("seen"))
    return by.select(row, ((F.col("made") > least) & ~F.col("seen")).cast("int").alias("is_fearless"))


def sessions(df: DataFrame, keys: list[str], gap_hours: float = 12) -> DataFrame:
    """Adds series_no: a new one where a pair's games are more than the gap apart."""
    order = Window.partitionBy(*keys).orderBy(*ORDER)
    apart = F.unix_seconds("date") - F.unix_seconds(F.lag("date").over(order)) > gap_hours * 3600
    new = F.coalesce(apart, F.lit(True)).cast("int")
    return df.withColumn("series_no", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def strictly_before(keys: list[str]):
    """All rows of the key with an earlier time: rows of the same instant see none of each other.
    The rows must have `us`, the time in microseconds."""
    return Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, -1)


def last_value_before(df: DataFrame, events: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """As-of join: each row of df gets `values` of the key's latest event strictly before its time.

    Union and window instead of an inequality join: one shuffle by key, linear in the rows.
    """
    probe = df.withColumn("__probe", F.lit(1)).withColumn("__v", F.lit(None).cast(events.select(F.struct(*values)).schema[0].dataType))
    facts = events.select(*keys, time, F.struct(*values).alias("__v")).withColumn("__probe", F.lit(0))
    both = probe.unionByName(facts, allowMissingColumns=True)
    # at equal times probes come first, so that they do not see those events
    order = Window.partitionBy(*keys).orderBy(time, F.desc("__probe")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__last", F.last("__v", ignorenulls=True).over(order)).filter("__probe = 1")
    return found.select(*df.columns, *(F.col("__last")[v].alias(v) for v in values))


def first_in_band(probes: DataFrame, facts: DataFrame, keys: list[str], at: str, time: str, values: list[str], below: int, above: int) -> DataFrame:
    """probes with `values` of the key's first fact (by time, then values) whose time lies
    at most `below` seconds before the probe's `at` and under `above` seconds after it;
    null if there is none.

    The first one not before the band's start is looked up by a window that runs back
    from the latest fact; whether it is within the band's end is told afterwards.  So a
    key's rows are read once, however many facts a band holds.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fact = F.struct(F.lit(True).alias("__is"), micros(time).alias("__us"), *values)
    left = probes.withColumns({"__t": micros(at) - below * 1_000_000, "__at": micros(at), "__fact": F.lit(None).cast(facts.select(fact).schema[0].dataType)})
    right = facts.select(*keys, micros(time).alias("__t"), fact.alias("__fact"))
    both = left.unionByName(right, allowMissingColumns=True)
    # a probe comes after the facts of its band's first instant, which belong to the band
    order = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.col("__fact").isNull(), F.desc("__fact")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__found", F.last("__fact", ignorenulls=True).over(order)).filter("__fact IS NULL")
    inside = F.col("__found.__us") - F.col("__at") < above * 1_000_000
    return found.select(*probes.columns, *(F.when(inside, F.col("__found")[v]).alias(v) for v in values))
