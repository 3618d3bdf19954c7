"""Scoring of one match-up from two team snapshots, as column expressions."""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, signed_text

# fixed values of the published proxy: scale of the rating gap, weights of form, blue side and event
SCALE, FORM_WEIGHT, BLUE_BONUS, EVENT_BONUS = 250.0, 1.5, 0.15, 0.05
COMPARED = ("kda", "dpm", "wr", "cs", "pool")
DEFAULT_STATE = {"a": "Gen.G", "b": "T1", "blueIsA": True, "lan": False}


def explain(elo_a: Column, elo_b: Column, wr_a: Column, wr_b: Column, blue: Column, event: Column) -> dict[str, Column]:
    """Parts of the log odds that a wins, their total and p."""
    base = clamp(1 / (1 + F.pow(F.lit(10.0), -(elo_a - elo_b) / SCALE)), 0.001, 0.999)
    parts = {
        "part_elo": F.log(base / (1 - base)),
        "part_form": FORM_WEIGHT * (wr_a - wr_b),
        "part_side": F.when(blue, BLUE_BONUS).otherwise(0.0),
        "part_event": F.when(event, EVENT_BONUS).otherwise(0.0),
    }
    total = parts["part_elo"] + parts["part_form"] + parts["part_side"] + parts["part_event"]
    return parts | {"total": total, "p": 1 / (1 + F.exp(-total))}


def drivers(parts: list[Column]) -> dict[str, Column]:
    """Width (share of the largest part, in percent), text and mute flag of each part."""
    most = F.greatest(*(F.abs(p) for p in parts), F.lit(1e-9))
    out = {}
    for k, p in enumerate(parts):
        out |= {f"width_{k}": F.abs(p) / most * 100, f"text_{k}": signed_text(p), f"muted_{k}": F.abs(p) < 1e-9}
    return out


def shown(p: Column) -> dict[str, Column]:
    """Whole percents of both sides; they add up to 100."""
    a = F.floor(p * 100 + 0.5).cast("int")
    return {"pct_a": a, "pct_b": 100 - a}


def guarded(p: Column, team_a: Column, team_b: Column, known_a: Column, known_b: Column) -> dict[str, Column]:
    """shown() for a match-up of two different, known teams; null otherwise."""
    ok = (team_a != team_b) & known_a & known_b
    return {n: F.when(ok, c) for n, c in shown(p).items()}


def compare_rosters(rosters: DataFrame, pairs: DataFrame) -> DataFrame:
    """team_a, team_b, position, winner: a if strictly higher in 3 of the 5 numbers, else b.

    Positions that one side lacks are left out.
    """
    a = rosters.select(F.col("team").alias("team_a"), "position", *(F.col(c).alias(f"{c}_a") for c in COMPARED))
    b = rosters.select(F.col("team").alias("team_b"), "position", *(F.col(c).alias(f"{c}_b") for c in COMPARED))
    both = pairs.join(a, "team_a").join(b, ["team_b", "position"])
    higher = sum((F.col(f"{c}_a") > F.col(f"{c}_b")).cast("int") for c in COMPARED)
    return both.select("team_a", "team_b", "position", F.when(higher >= 3, "a").otherwise("b").alias("winner"))


def linear_score(features: dict[str, Column], weights: dict[str, float], mean: dict[str, float], spread: dict[str, float], bias: float) -> dict[str, Column]:
    """p and confidence of a standardized linear model; a feature that is not given counts as 0."""
    z = F.lit(bias)
    for name, weight in weights.items():
        z = z + weight * (features.get(name, F.lit(0.0)) - mean[name]) / spread[name]
    p = 1 / (1 + F.exp(-z))
    conf = 2 * F.abs(p - 0.5)
    return {"p": p, "confidence": conf, "band": F.when(conf > 0.6, "high").when(conf > 0.3, "medium").otherwise("low")}


def filled_slots(elo_a: Column, elo_b: Column, games_a: Column, games_b: Column, wr_a: Column, wr_b: Column, blue: Column, tier: Column) -> dict[str, Column]:
    """What two teams' snapshots tell of a model's features, by name; unknown numbers are 0."""
    known = lambda x: F.coalesce(x, F.lit(0))
    gap = elo_a - elo_b
    return {
        "elo_diff": gap,
        "elo_expected": 1 / (1 + F.pow(F.lit(10.0), -gap / 400)),
        "n_games_diff": known(games_a) - known(games_b),
        "wr_a_10": known(wr_a),
        "wr_b_10": known(wr_b),
        "wr_diff_10": known(wr_a) - known(wr_b),
        "is_blue_a": blue.cast("int"),
        "league_tier": tier,
    }


def search(teams: DataFrame, text: str) -> DataFrame:
    """Teams whose name contains the text, whatever the case, strongest first."""
    return teams.filter(F.lower("name").contains(text.lower())).orderBy(F.desc("elo"), "name")


def parse_state(query: str, teams) -> dict:
    """The page's state from a query string; unknown, equal or missing teams give the default."""
    q = {k: v[0] for k, v in parse_qs(query.lstrip("?"), keep_blank_values=True).items()}
    a, b = q.get("a"), q.get("b")
    if not a or not b or a == b or a not in teams or b not in teams:
        return dict(DEFAULT_STATE)
    return {"a": a, "b": b, "blueIsA": q.get("blue") != "b", "lan": q.get("lan") == "1"}


def serialize_state(state: dict) -> str:
    q = {"a": state["a"], "b": state["b"], "blue": "a" if state["blueIsA"] else "b"}
    if state["lan"]:
        q["lan"] = "1"
    return "?" + urlencode(q)


def swap(state: dict) -> dict:
    """The same match-up seen from the other side."""
    return {**state, "a": state["b"], "b": state["a"], "blueIsA": not state["blueIsA"]}


def flipped(columns: list[str], clean: bool = False) -> dict[str, Column]:
    """Feature columns for swapped sides.

    By default every name with `diff` or that starts with elo_, wr_ or h2h is
    negated, as published, levels included; `clean` negates differences only,
    swaps _a and _b, and takes expectations from 1.
    """
    out = {}
    for c in columns:
        if not clean:
            negate = "diff" in c or c.startswith(("elo_", "wr_", "h2h"))
            out[c] = -F.col(c) if negate else F.col(c)
        elif "diff" in c:
            out[c] = -F.col(c)
        elif c in ("elo_expected", "h2h_a"):
            out[c] = 1 - F.col(c)
        else:
            other = c[:-2] + {"_a": "_b", "_b": "_a"}.get(c[-2:], "") if c[-2:] in ("_a", "_b") else c
            out[c] = F.col(other) if other in columns else F.col(c)
    return out
