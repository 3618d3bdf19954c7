"""The feature tables V1 to V4: what each version adds, built from the shared operators.

The lines are gathered once and written; every frame below is made of that table and
keyed by (gameid, team), so the frames meet in co-located joins.  Sides are attached to
their game by the team's name, never by position.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scalars as S
from ..operators import dims, elo, meta, recent
from ..operators import windows as W
from ..operators.metrics import packed
from ..sources import adapter as A
from ..sources.store import FeatureStore, written
from . import matchqueries as Q

NOT_OWN = ("opp_dragons", "opp_towers", "opp_barons")
AVG10 = tuple(A.STATS)
AVG20 = ("teamkills", "teamdeaths", "dragons", "barons", "towers", "golddiffat15", "earned_gpm", "dpm")
#: differences of averages that count as features
DIFF10 = tuple(s for s in AVG10 if s not in ("opp_towers", "opp_barons"))

V1 = (
    "elo_diff", "elo_expected", "n_games_diff", "wr_diff_5", "wr_diff_10", "wr_diff_20", "wr_diff_all", "wr_a_10", "wr_b_10", "is_blue_a", "side_wr_diff", "h2h_a", "league_tier",
    "is_playoffs", "game_number", "first_pick_a", "champ_div_diff", *(f"avg10_{s}_diff" for s in DIFF10), *(f"avg20_{s}_diff" for s in AVG20), "kda_ratio_diff", "dragon_control_diff",
    "tower_control_diff", "baron_control_diff", "vision_diff", "composite_strength_diff",
)
SERIES = ("series_games_played", "series_score_diff", "is_elimination", "series_momentum_a")
V2 = ("wwr_diff_10", "is_lan", "bo_format", "has_sub_a", "has_sub_b", "sub_diff", *SERIES, "is_fearless", *(f"{c}_diff" for c in Q.PLAYER_FEATURES))
COACH = ("coach_wr", "coach_experience", "same_coach", "coach_tenure")
REGIONAL = tuple(f"region_{p}_{k}_diff" for p in ("top", "bot", "mid") for k in ("gold", "dmg"))
V3 = (
    *(f"{c}_{s}" for c in COACH for s in "ab"), "coach_wr_diff", "coach_experience_diff", "coach_tenure_diff", "team_a_home", "team_b_home", "is_home_a", "is_home_b", "is_traveling_a",
    "is_traveling_b", "travel_diff", *REGIONAL, "region_carry_position_a", "region_carry_position_b", "carry_position_match", "region_playstyle_distance",
)
META = ("avg_pick_rate", "avg_champ_wr", "team_champ_comfort", "meta_conformity", "ban_target")
PATCHED = ("team_patch_games", "patch_wr_delta")
V4 = ("patch_maturity", "is_new_patch", "patch_age_days", *(f"{c}_{s}" for c in (*PATCHED, *META) for s in ("a", "b", "diff")))
#: the columns of each version; the lists of the first two also hold roster_overlap_diff
VERSIONS = {
    1: (*V1, "roster_overlap_diff"),
    2: (*V1, "roster_overlap_diff", *V2),
    3: (*V1, *V2, *V3),
    4: (*V1, *V2, *V3, *V4),
}
_TEAM = ["wr_5", "wr_10", "wr_20", "wr_all", "n_games", "side_wr", "champ_div", "roster_overlap", "wwr", "subs_in", "kda_ratio", "dragon_control", "tower_control", "baron_control", *(f"avg10_{s}" for s in AVG10), *(f"avg20_{s}" for s in AVG20)]
_KEY = ["gameid", "team"]
#: of the registered queries
DIGITS = 6


def _by_team(sides: DataFrame, made: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """Everything that looks back along a team's own games, in one pass over them."""
    t = recent.team_history(sides, {10: AVG10, 20: AVG20}, made, parts)
    mean = lambda s: F.col(f"avg10_{s}")
    return t.withColumns({
        "kda_ratio": W.kda(mean("teamkills"), mean("teamdeaths")),
        "dragon_control": S.control_share(mean("dragons"), mean("opp_dragons")),
        "tower_control": S.control_share(mean("towers"), mean("opp_towers")),
        "baron_control": S.control_share(mean("barons"), mean("opp_barons"), 0.01),
    })


def _coach(sides: DataFrame) -> DataFrame:
    known = Q.coaches(None, None, sides)
    rows = sides.join(known, ["team", "year"])
    history = dims.coach_history(rows.select(*_KEY, "coach", "date", "result")).select(*_KEY, "coach", "coach_wr", "coach_experience")
    same = dims.same_coach(known)
    years = rows.select(*_KEY, "year").join(same, ["team", "year"])
    # games under a coach that stayed for another year: over everything, as published
    tenure = years.filter("same_coach = 1").groupBy("team", "coach").agg(F.count("*").alias("coach_tenure"))
    out = history.join(years.select(*_KEY, "same_coach"), _KEY).join(tenure, ["team", "coach"], "left")
    return out.select(*_KEY, "coach_wr", "coach_experience", "same_coach", F.coalesce("coach_tenure", F.lit(0)).alias("coach_tenure"))


def features(spark, sf, version: int = 4) -> DataFrame:
    """gameid, date, league, year, team_a, team_b, result, n_games_a, n_games_b and the
    version's features; the last version's table has those of all of them.

    Each frame is stored by the game's id, and they meet there without an exchange.  The
    table is written, for several uses."""
    with FeatureStore(spark, "gameid") as store:
        return written(joined(*stored_frames(spark, sf, store, version), version))


def features_once(spark, sf, version: int = 4) -> DataFrame:
    """gameid and the version's features as doubles with DIGITS digits, for one use: the frames meet when it is read."""
    with FeatureStore(spark, "gameid") as store:
        return store.leave(joined(*stored_frames(spark, sf, store, version), version, DIGITS).select("gameid", *VERSIONS[version]))


def stored_frames(spark, sf, store: FeatureStore, version: int = 4) -> tuple[DataFrame, list[DataFrame], list[tuple[DataFrame, dict[str, str]]]]:
    """The games, frames of one row a game, and frames of one row a side with their columns, all in the store.

    What a side's frame knows is stored as one array xs, beside which its columns are given
    with their types: joins then copy a few values a row.  A game's sides share a row, with a
    list of their teams and with their arrays one behind the other."""
    wide = store.keep(A.with_played_lines(A.wide_games(spark, sf)))
    sides = store.keep(A.raw_sides(wide))
    per_team = [(_by_team(sides, A.RAW_STATS, A.line_parts(spark, sf)), [*_TEAM, "team_champ_comfort", "ban_target"])]
    h2h = sides.select("gameid", "slot", W.win_rate(["team", "opp"], 10).alias("h2h_a")).filter("slot = 'a'").drop("slot")
    per_game = [elo.elo(Q.tier(wide.drop("xs"))), h2h]
    if version >= 2:
        per_team.append((recent.player_sides(A.players_of(wide), A.LANES, A.line_parts(spark, sf)), list(Q.PLAYER_FEATURES)))
        state = A.with_picks(wide).withColumns(W.series_key(F.col("game_name"), F.col("team_a"), F.col("team_b")))
        keys = ["series", "team_1", "team_2"]
        per_game += [W.series_state(state, keys), W.fearless(state, keys)]
    if version >= 3:
        per_team.append((_coach(sides), list(COACH)))
        r = Q.with_regions(spark, sf, wide)
        r = r.withColumns(dims.travel(F.col("region_a"), F.col("event"), "a") | dims.travel(F.col("region_b"), F.col("event"), "b"))
        p = Q.profile(spark, sf, A.players_of(wide))
        pairs = dims.playstyle_differences(r.select("region_a", "region_b").distinct(), p, dims.carry_position(p))
        own = r.select("gameid", "region_a", "region_b", "is_home_a", "is_home_b", "is_traveling_a", "is_traveling_b")
        per_game.append(own.join(pairs, ["region_a", "region_b"], "left"))
    if version >= 4:
        known = store.keep(meta.known_champions(sides.filter(F.size("champs") > 0)))
        per_team += [(meta.team_patch(sides), list(PATCHED)), (known, ["avg_pick_rate", "avg_champ_wr"]), (known, ["meta_conformity"])]
        per_game.append(meta.patch_age(wide))
    games = store.put(Q.tier(wide.drop("xs")))
    kept = [(store.put_lists(f.select(*_KEY, packed(columns)), "xs"), dict(f.select(*columns).dtypes)) for f, columns in per_team]
    others = [store.put(f) for f in per_game]
    store.tidy()
    return games, others, kept


def joined(g: DataFrame, per_game: list[DataFrame], per_team: list[tuple[DataFrame, dict[str, str]]], version: int, digits: int | None = None) -> DataFrame:
    """The version's features from stored frames; as doubles rounded as SQL does it, if `digits` are given."""
    # each frame is one value a row here: joins that copy every column, and the formulas beside a join, make methods longer than the JVM compiles
    row = lambda frame, name: frame.select("gameid", F.struct(*(c for c in frame.columns if c != "gameid")).alias(name))
    out, values, arrays = row(g, "__g"), {c: F.col(f"__g.`{c}`") for c in g.columns if c != "gameid"}, []
    for k, frame in enumerate(per_game):
        out = out.join(row(frame, f"__f{k}"), "gameid", "left")
        values |= {c: F.col(f"__f{k}.`{c}`") for c in frame.columns if c != "gameid"}
    for k, (frame, kinds) in enumerate(per_team):
        out = out.join(row(frame, f"__s{k}"), "gameid", "left")
        teams, xs = F.col(f"__s{k}.team"), F.col(f"__s{k}.xs")
        values[f"__xs{k}"] = xs
        for s in "ab":  # where the team's array begins; null for a team that has none
            own = values[f"team_{s}"]
            at = F.when(F.exists(teams, lambda t: t == own), (F.array_position(teams, own) - 1) * len(kinds)).cast("int")  # a lambda keeps the formulas out of the join's method
            values[f"__at{k}_{s}"] = at
            values |= {f"{c}_{s}": F.get(xs, at + i).cast(kind) for i, (c, kind) in enumerate(kinds.items())}
        arrays += [f"__xs{k}", f"__at{k}_a", f"__at{k}_b"]
    out = out.select("gameid", *(c.alias(n) for n, c in values.items()))
    made = _formulas(version)
    if version > 2:  # in the lists of the first two versions only, and kept beside the later ones
        made["roster_overlap_diff"] = F.col("roster_overlap_a") - F.col("roster_overlap_b")
    whole = ["gameid", "date", "league", "year", "team_a", "team_b", "result", "n_games_a", "n_games_b"]
    kind = out.select(*whole, *(c.alias(n) for n, c in made.items())).schema
    if digits is not None:
        kind = StructType([f if f.name in whole else StructField(f.name, DoubleType()) for f in kind])
    # plain values and differences of the sides' arrays are made in batches; of them Spark makes one by one, what else there is
    where = {c: (k, i) for k, (_, kinds) in enumerate(per_team) for i, c in enumerate(kinds)}
    plain = {n: (how, *where[c]) for n, (how, c) in _of_sides(version).items() if n in made}
    given = out.select(*whole, *(c.alias(n) for n, c in made.items() if n not in plain), *arrays)
    return given.mapInArrow(partial(_met, names=kind.names, widths=[len(kinds) for _, kinds in per_team], plain=plain, whole=whole, kinds=to_arrow_schema(kind), digits=digits), kind)


def _of_sides(version: int) -> dict[str, tuple[str, str]]:
    """The features that are a side's value (of a or b), or a's less b's."""
    f = {"n_games_diff": "n_games", **{f"wr_diff_{n}": f"wr_{n}" for n in (5, 10, 20, "all")}, "side_wr_diff": "side_wr", "champ_div_diff": "champ_div", "roster_overlap_diff": "roster_overlap", "vision_diff": "avg10_vspm"}
    f |= {f"avg10_{s}_diff": f"avg10_{s}" for s in DIFF10} | {f"avg20_{s}_diff": f"avg20_{s}" for s in AVG20} | {f"{n}_diff": n for n in ("kda_ratio", "dragon_control", "tower_control", "baron_control")}
    if version >= 2:
        f |= {"wwr_diff_10": "wwr", "sub_diff": "subs_in"} | {f"{n}_diff": n for n in Q.PLAYER_FEATURES}
    own = ["coach_wr"] if version >= 3 else []
    own += [n for n in META if n != "ban_target"] if version >= 4 else []
    out = {n: ("diff", c) for n, c in (f | {f"{n}_diff": n for n in own}).items()}
    return out | {"wr_a_10": ("a", "wr_10"), "wr_b_10": ("b", "wr_10")} | {f"{n}_{s}": (s, n) for n in own for s in "ab"}


def _met(batches, names: list[str], widths: list[int], plain: dict, whole: list[str], kinds: pa.Schema, digits: int | None):
    for b in batches:
        column = lambda n, b=b: b.column(b.schema.get_field_index(n))
        sides = {}
        for k, width in enumerate(widths):
            xs = column(f"__xs{k}")
            values = np.append(xs.values.to_numpy(zero_copy_only=False), np.nan)  # unknown: NaN
            start = xs.offsets.to_numpy()[:-1]
            for s in "ab":
                at = column(f"__at{k}_{s}")
                known = at.is_valid().to_numpy(zero_copy_only=False)
                first = start + at.fill_null(0).to_numpy()
                sides[k, s] = values[np.where(known, first + np.arange(width)[:, None], len(values) - 1)]
        out = []
        for n in names:
            if n in plain:
                how, k, i = plain[n]
                x = sides[k, "a"][i] - sides[k, "b"][i] if how == "diff" else sides[k, how][i]
            elif n in whole or digits is None:
                out.append(column(n))
                continue
            else:
                x = column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)
            if digits is not None:
                x = _rounded(x, digits)
            kind = kinds.field(n).type
            unknown = np.isnan(x)
            out.append(pa.array(x if pa.types.is_floating(kind) else np.where(unknown, 0, x), mask=unknown).cast(kind))
        yield pa.RecordBatch.from_arrays(out, names=names)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """To the nearest, halves away from zero, of the scaled double as SQL has it."""
    scaled = x * 10.0**digits
    near = np.trunc(scaled)
    near += np.where(np.abs(scaled - near) >= 0.5, np.sign(scaled), 0.0)
    out = near / 10.0**digits + 0.0
    return np.where(np.isfinite(out), out, x)


def _formulas(version: int) -> dict:
    c, none = F.col, lambda x: F.coalesce(x, F.lit(0))
    diff = lambda n: c(f"{n}_a") - c(f"{n}_b")
    f = {n: c(n) for n in ("elo_diff", "elo_expected", "h2h_a")}
    f |= {"n_games_diff": diff("n_games"), **{f"wr_diff_{n}": diff(f"wr_{n}") for n in (5, 10, 20, "all")}, "wr_a_10": c("wr_10_a"), "wr_b_10": c("wr_10_b")}
    f |= {"is_blue_a": (c("side_a") == "R").cast("int"), "side_wr_diff": diff("side_wr"), "league_tier": c("tier"), "is_playoffs": c("playoffs"), "game_number": c("game_num"), "first_pick_a": (c("part_a") % 2).cast("int")}
    f |= {"champ_div_diff": diff("champ_div"), "roster_overlap_diff": diff("roster_overlap")}
    f |= {f"avg10_{s}_diff": diff(f"avg10_{s}") for s in DIFF10} | {f"avg20_{s}_diff": diff(f"avg20_{s}") for s in AVG20}
    f |= {f"{n}_diff": diff(n) for n in ("kda_ratio", "dragon_control", "tower_control", "baron_control")} | {"vision_diff": diff("avg10_vspm")}
    f["composite_strength_diff"] = composite(c("elo_diff"), diff("wr_10"), diff("kda_ratio"), diff("dragon_control"), diff("avg10_golddiffat15"))
    if version >= 2:
        f |= {"wwr_diff_10": diff("wwr"), "is_lan": (c("tier") == 3).cast("int"), "bo_format": S.best_of(c("game_num"))}
        f |= {f"has_sub_{s}": (c(f"subs_in_{s}") > 0).cast("int") for s in "ab"} | {"sub_diff": diff("subs_in")}
        f |= {n: c(n) for n in (*SERIES, "is_fearless")} | {f"{n}_diff": diff(n) for n in Q.PLAYER_FEATURES}
    if version >= 3:
        # a side without a coach has no win rate, and zeros for the rest
        f |= {f"coach_wr_{s}": c(f"coach_wr_{s}") for s in "ab"} | {f"{n}_{s}": none(c(f"{n}_{s}")) for n in COACH[1:] for s in "ab"}
        f |= {"coach_wr_diff": diff("coach_wr")} | {f"{n}_diff": none(c(f"{n}_a")) - none(c(f"{n}_b")) for n in ("coach_experience", "coach_tenure")}
        f |= {f"team_{s}_home": S.region_number(c(f"region_{s}")) for s in "ab"} | {n: c(n) for n in V3 if n.startswith(("is_home", "is_trav", "region_", "carry_"))}
        f["travel_diff"] = c("is_traveling_a") - c("is_traveling_b")
    if version >= 4:
        # a game of which one side is unmatched keeps the initial values for both
        both = c("team_patch_games_a").isNotNull() & c("team_patch_games_b").isNotNull()
        kept = lambda x, default=None: F.when(both, x).otherwise(F.lit(default))
        f |= {"patch_maturity": kept(c("patch_maturity")), "is_new_patch": kept(c("is_new_patch"), 0), "patch_age_days": kept(c("patch_age_days").cast("double"))}
        f |= {f"team_patch_games_{s}": kept(c(f"team_patch_games_{s}"), 0) for s in "ab"} | {"team_patch_games_diff": kept(diff("team_patch_games"), 0)}
        f |= {f"patch_wr_delta_{s}": kept(c(f"patch_wr_delta_{s}")) for s in "ab"} | {"patch_wr_delta_diff": kept(diff("patch_wr_delta"))}
        for n in META:
            f |= {f"{n}_{s}": (none(c(f"{n}_{s}")) if n == "ban_target" else c(f"{n}_{s}")) for s in "ab"}
            f[f"{n}_diff"] = none(c(f"{n}_a")) - none(c(f"{n}_b")) if n == "ban_target" else diff(n)
    return {n: f[n] for n in VERSIONS[version]}


def composite(elo_diff, wr_diff, kda_diff, dragon_diff, gold_diff):
    """The weighted sum of standing differences; unknown parts count as 0."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return 0.3 * elo_diff / 200 + 0.25 * wr_diff * 2 + 0.2 * z(kda_diff) + 0.15 * z(dragon_diff) * 2 + 0.1 * z(gold_diff) / 1000


# ---- the same in SQL

_COMPOSITE = "0.3 * elo_diff / 200 + 0.25 * wr_diff_10 * 2 + 0.2 * coalesce(kda_ratio_diff, 0) + 0.15 * coalesce(dragon_control_diff, 0) * 2 + 0.1 * coalesce(avg10_golddiffat15_diff, 0) / 1000"


def _team_sql() -> str:
    over = Q.over
    cols = [f"coalesce(avg(t.result) {over('t.team', n)}, 0.5) AS wr_{k}" for n, k in ((5, 5), (10, 10), (20, 20), (30, "all"))]
    cols += [f"count(*) {over('t.team')} AS n_games"]
    cols += [f"list({{'s': t.side, 'r': t.result}}) {over('t.team', 60)} AS sided", f"list(m.champs) {over('t.team', 20)} AS champs20", f"list(m.champs) {over('t.team', 30)} AS champs30"]
    cols += [f"list(t.result) {over('t.team', 10)} AS r10", f"list(CASE t.game_num WHEN 1 THEN 1.0 WHEN 2 THEN 1.3 ELSE 1.5 END::DOUBLE) {over('t.team', 10)} AS g10"]
    cols += ["lag(m.roster) OVER (PARTITION BY t.team ORDER BY t.date, t.gameid) AS prev"]
    cols += [f"avg(t.{s}) {over('t.team', n)} AS avg{n}_{s}" for n, names in ((10, AVG10), (20, AVG20)) for s in names]
    share = lambda a, floor: f"CASE WHEN avg10_{a} IS NOT NULL AND avg10_opp_{a} IS NOT NULL THEN avg10_{a} / greatest(avg10_{a} + avg10_opp_{a}, {floor}) END"
    source = "stat_rows t JOIN team_games m ON m.gameid = t.gameid AND m.team = t.team"
    cols = ", ".join(c.replace("date, gameid", "t.date, t.gameid").replace("t.t.", "t.") for c in cols)
    return f"""
, tw AS (SELECT t.gameid, t.slot, t.team, t.side, m.champs, m.roster, m.opp_bans, {cols} FROM {source}),
tx AS (SELECT *, list_filter(coalesce(sided, []), lambda x: x.s = side) AS own, coalesce(len(prev), 0) > 0 AND len(roster) > 0 AS known, flatten(coalesce(champs30, [])) AS recent FROM tw),
ts AS (SELECT *, CASE WHEN len(own) = 0 THEN 0.5 ELSE list_avg(list_transform(own[greatest(len(own) - 29, 1):], lambda x: x.r)) END AS side_wr,
  len(list_distinct(flatten(coalesce(champs20, [])))) AS champ_div, CASE WHEN known THEN len(list_intersect(roster, prev)) / greatest(len(roster), 1) ELSE 0.5 END AS roster_overlap,
  CASE WHEN known THEN len(list_filter(roster, lambda x: NOT list_contains(prev, x))) ELSE 0 END AS subs_in,
  CASE WHEN r10 IS NULL THEN 0.5 ELSE list_sum(list_transform(range(1, len(r10) + 1), lambda i: r10[len(r10) + 1 - i] * g10[i])) / list_sum(g10) END AS wwr,
  CASE WHEN len(champs30) > 0 AND len(champs) > 0 THEN list_sum(list_transform(champs, lambda c: len(list_filter(champs30, lambda g: list_contains(g, c))))) / len(champs) END AS team_champ_comfort,
  len(list_filter(opp_bans, lambda b: list_contains(recent, b))) AS ban_target,
  CASE WHEN avg10_teamdeaths IS NOT NULL THEN avg10_teamkills / greatest(CASE WHEN avg10_teamdeaths = 0 THEN 1.0 ELSE avg10_teamdeaths END, 0.5) END AS kda_ratio,
  {share("dragons", 0.5)} AS dragon_control, {share("towers", 0.5)} AS tower_control, {share("barons", 0.01)} AS baron_control FROM tx)
"""


def _game_sql() -> str:
    return f"""
, h2h AS (SELECT gameid, coalesce(avg(result) {Q.over('team, opp', 10)}, 0.5) AS h2h_a, slot FROM team_rows),
rated AS (SELECT f.gameid, a - b AS elo_diff, 1 / (1 + pow(10, (b - a) / 400)) AS elo_expected FROM fold f WHERE f.i > 0)
"""


_SERIES_SQL = f"""
, ss AS (SELECT gameid, date, game_num, result, {Q.SERIES} AS series, list({{'g': game_num, 'r': result}}) OVER (PARTITION BY {Q.SERIES} ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM games),
st AS (SELECT gameid, list_filter(coalesce(p, []), lambda x: x.g < game_num) AS p FROM ss),
su AS (SELECT gameid, len(p) AS n, coalesce(list_sum(list_transform(p, lambda x: x.r)), 0) AS a, p[len(p)].r AS last FROM st),
fp AS (SELECT g.gameid, g.date, {Q.SERIES} AS series, d.champs || e.champs AS picks FROM games g JOIN drafts d ON d.gameid = g.gameid AND d.slot = 'a' JOIN drafts e ON e.gameid = g.gameid AND e.slot = 'b'),
fq AS (SELECT gameid, picks, flatten(coalesce(list(picks) OVER (PARTITION BY series ORDER BY date, gameid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS past FROM fp),
series AS (SELECT su.gameid, n AS series_games_played, 2 * a - n AS series_score_diff, (n > 0 AND 2 * a = n)::INT AS is_elimination, CASE WHEN n = 0 THEN 0 WHEN last = 1 THEN 1 ELSE -1 END AS series_momentum_a,
  (len(past) > 5 AND len(list_intersect(past, picks)) = 0)::INT AS is_fearless FROM su JOIN fq ON fq.gameid = su.gameid)
"""
_COACH_SIDES_SQL = Q.COACH_SQL + """
, cr AS (SELECT t.gameid, t.team, t.year, t.date, t.result, c.coach FROM team_rows t JOIN coaches c ON c.team = t.team AND c.year = t.year),
ch AS (SELECT *, count(*) OVER (PARTITION BY coach, team ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS n FROM cr),
co AS (SELECT coach, team, list(result ORDER BY date, gameid) AS past FROM cr GROUP BY ALL),
cs AS (SELECT c.team, c.year, c.coach FROM coaches c JOIN coaches p ON p.team = c.team AND p.year = c.year - 1 AND p.coach = c.coach),
ct AS (SELECT t.team, s.coach, count(*) AS coach_tenure FROM team_rows t JOIN cs s ON s.team = t.team AND s.year = t.year GROUP BY ALL),
cside AS (SELECT ch.gameid, ch.team, n AS coach_experience, list_avg(past[greatest(n - 29, 1):n]) AS coach_wr, (cs.coach IS NOT NULL)::INT AS same_coach, coalesce(ct.coach_tenure, 0) AS coach_tenure
  FROM ch JOIN co ON co.coach = ch.coach AND co.team = ch.team LEFT JOIN cs ON cs.team = ch.team AND cs.year = ch.year LEFT JOIN ct ON ct.team = ch.team AND ct.coach = ch.coach)
"""


def _region_sql() -> str:
    event = Q.REGION_SQL.format("league")
    return Q.HOME_SQL + Q.PROFILE_SQL + f"""
, rt AS (SELECT gameid, {event} AS event, a.home AS ha, b.home AS hb FROM games g JOIN home a ON a.team = team_a JOIN home b ON b.team = team_b),
rd AS (SELECT ha, hb, {Q._diff_sql()}, (SELECT carry FROM carry WHERE region = ha) AS region_carry_position_a, (SELECT carry FROM carry WHERE region = hb) AS region_carry_position_b FROM (SELECT DISTINCT ha, hb FROM rt)),
region AS (SELECT rt.*, rd.* EXCLUDE (ha, hb), (rt.ha = event)::INT AS is_home_a, (rt.hb = event)::INT AS is_home_b, (event = 'INT' AND rt.ha <> 'INT')::INT AS is_traveling_a, (event = 'INT' AND rt.hb <> 'INT')::INT AS is_traveling_b,
  coalesce(region_carry_position_a = region_carry_position_b, false)::INT AS carry_position_match,
  sqrt({" + ".join(f"{n} ** 2" for n in REGIONAL)}) AS region_playstyle_distance FROM rt JOIN rd ON rd.ha = rt.ha AND rd.hb = rt.hb)
"""


_PATCH_SQL = f"""
, pc AS (SELECT gameid, date, row_number() OVER (PARTITION BY patch ORDER BY date, gameid) - 1 AS n, min(date) OVER (PARTITION BY patch) AS first FROM games),
patched AS (SELECT gameid, ln(1 + n) AS patch_maturity, (n < 50)::INT AS is_new_patch, CASE WHEN n > 0 THEN greatest(floor((epoch(date) - epoch(first)) / 86400), 0) END::DOUBLE AS patch_age_days FROM pc),
pt AS (SELECT gameid, team, count(*) {Q.over('team, patch')} AS team_patch_games, avg(result) {Q.over('team, patch')} - avg(result) {Q.over('team', 10)} AS patch_wr_delta FROM team_rows)
"""


def sql(version: int) -> str:
    """SQL that gives features() of a version, rounded, for the match tables."""
    d = lambda n: f"a.{n} - b.{n}"
    f = {"elo_diff": "elo_diff", "elo_expected": "elo_expected", "h2h_a": "h2h_a", "n_games_diff": d("n_games"), **{f"wr_diff_{n}": d(f"wr_{n}") for n in (5, 10, 20, "all")}}
    f |= {"wr_a_10": "a.wr_10", "wr_b_10": "b.wr_10", "is_blue_a": "(g.side_a = 'R')::INT", "side_wr_diff": d("side_wr"), "league_tier": Q.TIER_SQL, "is_playoffs": "g.playoffs", "game_number": "g.game_num", "first_pick_a": "g.part_a % 2"}
    f |= {"champ_div_diff": d("champ_div"), "roster_overlap_diff": d("roster_overlap"), **{f"avg10_{s}_diff": d(f"avg10_{s}") for s in DIFF10}, **{f"avg20_{s}_diff": d(f"avg20_{s}") for s in AVG20}}
    f |= {f"{n}_diff": d(n) for n in ("kda_ratio", "dragon_control", "tower_control", "baron_control")} | {"vision_diff": d("avg10_vspm")}
    ctes, joins = [Q.ELO_SQL, A.stat_rows_sql(), _team_sql(), _game_sql()], ["JOIN ts a ON a.gameid = g.gameid AND a.team = g.team_a", "JOIN ts b ON b.gameid = g.gameid AND b.team = g.team_b", "JOIN rated r ON r.gameid = g.gameid", "JOIN h2h h ON h.gameid = g.gameid AND h.slot = 'a'"]
    pairs = lambda table, s: f"LEFT JOIN {table} {s}a ON {s}a.gameid = g.gameid AND {s}a.team = g.team_a LEFT JOIN {table} {s}b ON {s}b.gameid = g.gameid AND {s}b.team = g.team_b"
    if version >= 2:
        ctes += [Q.PLAYERS_SQL, _SERIES_SQL]
        joins += ["JOIN series ON series.gameid = g.gameid", pairs("pside", "p")]
        f |= {"wwr_diff_10": d("wwr"), "is_lan": f"({Q.TIER_SQL} = 3)::INT", "bo_format": "CASE WHEN g.game_num = 1 THEN 1 WHEN g.game_num <= 3 THEN 3 ELSE 5 END", "has_sub_a": "(a.subs_in > 0)::INT", "has_sub_b": "(b.subs_in > 0)::INT", "sub_diff": d("subs_in")}
        f |= {n: n for n in (*SERIES, "is_fearless")} | {f"{n}_diff": f"pa.{n} - pb.{n}" for n in Q.PLAYER_FEATURES}
    if version >= 3:
        ctes += [_COACH_SIDES_SQL, _region_sql()]
        joins += ["JOIN region q ON q.gameid = g.gameid", pairs("cside", "c")]
        f |= {f"coach_wr_{s}": f"c{s}.coach_wr" for s in "ab"} | {f"{n}_{s}": f"coalesce(c{s}.{n}, 0)" for n in COACH[1:] for s in "ab"}
        f |= {"coach_wr_diff": "ca.coach_wr - cb.coach_wr"} | {f"{n}_diff": f"coalesce(ca.{n}, 0) - coalesce(cb.{n}, 0)" for n in ("coach_experience", "coach_tenure")}
        f |= {f"team_{s}_home": f"CASE h{s} WHEN 'KR' THEN 0 WHEN 'CN' THEN 1 WHEN 'EU' THEN 2 WHEN 'NA' THEN 3 ELSE 9 END" for s in "ab"}
        f |= {n: n for n in V3 if n.startswith(("is_home", "is_trav", "region_", "carry_"))} | {"travel_diff": "is_traveling_a - is_traveling_b"}
    if version >= 4:
        meta_sql = Q.SQL["meta_conformity_top20"][len(A.BASE_SQL) :]
        ctes += [_PATCH_SQL, Q.RATES_SQL + ", rside AS (SELECT p.gameid, team, avg(pick_rate) AS avg_pick_rate, avg(champ_wr) AS avg_champ_wr FROM picks p JOIN rates r ON p.gameid = r.gameid AND p.champ = r.champ GROUP BY ALL)"]
        head, _, tail = meta_sql.rpartition("SELECT a.gameid")
        tail = tail.replace("round(CASE", "(CASE").replace("END, 6) AS", "END) AS")  # rounded once, behind the difference
        ctes += [f"{head}, conform AS (SELECT a.gameid{tail})"]
        joins += ["LEFT JOIN patched ON patched.gameid = g.gameid", pairs("pt", "t"), pairs("rside", "r"), pairs("conform", "m")]
        f |= {n: n for n in ("patch_maturity", "is_new_patch", "patch_age_days")}
        for n, table in {"team_patch_games": "t", "patch_wr_delta": "t", "avg_pick_rate": "r", "avg_champ_wr": "r", "meta_conformity": "m", "team_champ_comfort": "", "ban_target": ""}.items():
            f |= {f"{n}_{s}": f"{table}{s}.{n}" for s in "ab"} | {f"{n}_diff": f"{table}a.{n} - {table}b.{n}"}
    made = ", ".join(f"{f[n]} AS {n}" for n in VERSIONS[version] if n != "composite_strength_diff")
    out = ", ".join(f"round({_COMPOSITE if n == 'composite_strength_diff' else n}, 6)::DOUBLE AS {n}" for n in VERSIONS[version])
    return "".join(ctes) + f", made AS (SELECT g.gameid, {made} FROM games g {' '.join(joins)}) SELECT gameid, {out} FROM made"


REGISTRY: dict = {}
SQL: dict[str, str] = {}


def _register(version: int) -> None:
    def query(spark, sf):
        return features_once(spark, sf, version).withColumn("gameid", F.col("gameid").cast("long"))

    query.__name__ = f"features_v{version}"
    query.__doc__ = f"All {len(VERSIONS[version])} features of version {version}, a row a game."
    REGISTRY[query.__name__] = query
    SQL[query.__name__] = A.BASE_SQL + sql(version)


for _version in VERSIONS:
    _register(_version)
