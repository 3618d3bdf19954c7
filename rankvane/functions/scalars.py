"""Rules on single values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: league names by strength
MAJOR_LEAGUES = ("LCK", "LPL", "LEC", "LCS", "LTA", "LTA North", "LTA South", "LCP")
SECOND_LEAGUES = ("PCS", "VCS", "CBLOL", "LJL", "LLA", "LCO", "TCL", "LCK CL", "LDL", "NACL", "LFL", "PRM", "NLC")
INTERNATIONAL = ("WLDs", "MSI", "Worlds")

# fixed values: home region of each league, and the regions' numbers
LEAGUE_REGION = {
    "LCK": "KR", "LPL": "CN", "LEC": "EU", "LCS": "NA", "LTA North": "NA", "LTA South": "LATAM", "CBLOL": "BR", "LCP": "APAC",
    "PCS": "APAC", "VCS": "VN", "LJL": "JP", "KeSPA": "KR", "First Stand": "INT", "Worlds": "INT", "MSI": "INT", "WCS": "INT",
}
REGION_NUMBER = {"KR": 0, "CN": 1, "EU": 2, "NA": 3, "LATAM": 4, "BR": 5, "APAC": 6, "VN": 7, "JP": 8, "INT": 9}


def any_contains(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def league_tier(league: Column) -> Column:
    """3 for major leagues and international events, 2 for the second row, else 1."""
    top = league.isin(*MAJOR_LEAGUES) | any_contains(league, INTERNATIONAL)
    return F.when(top, 3).when(league.isin(*SECOND_LEAGUES), 2).otherwise(1)


def is_lan(league: Column) -> Column:
    return F.coalesce((league.isin(*MAJOR_LEAGUES) | any_contains(league, INTERNATIONAL)).cast("int"), F.lit(0))


# fixed values: the scoring page's own tiers; all other leagues are 0
PAGE_TIERS = {"LEC": 2, "LCS": 2, "LCK": 2, "LPL": 2, "PCS": 1, "LJL": 1, "VCS": 1, "TCL": 1, "EM": 1}


def display_tier(league: Column) -> Column:
    """The 0 to 2 scale of the scoring page, which is not that of league_tier()."""
    return lookup(PAGE_TIERS, league, 0)


def tint(a: Column, b: Column) -> Column:
    """Which side of a row is highlighted: a, b, or t for a tie."""
    return F.when(a > b, "a").when(a < b, "b").otherwise("t")


def best_of(game_num: Column) -> Column:
    """1, 3 or 5 by the number of the game; the first game counts as a single one."""
    return F.when(game_num == 1, 1).when(game_num <= 3, 3).otherwise(5)


def game_weight(game_num: Column) -> Column:
    return F.when(game_num == 1, 1.0).when(game_num == 2, 1.3).otherwise(1.5)


def role_rank(roles: Column) -> Column:
    """2 for a head coach, 1 for a coach, 0 otherwise; the highest of a comma list."""
    one = lambda r: F.when(F.trim(r) == "Head Coach", 2).when(F.trim(r) == "Coach", 1).otherwise(0)
    return F.coalesce(F.array_max(F.transform(F.split(roles, ","), one)), F.lit(0))


def parse_time(text: Column) -> Column:
    """Null where the text is no time."""
    return F.try_to_timestamp(text)


def date_prefix(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two times, rounded down (-12 hours are -1 day)."""
    return F.floor((F.unix_seconds(later) - F.unix_seconds(earlier)) / 86400)


def lookup(values: dict, key: Column, default) -> Column:
    """A small fixed mapping as a map literal, with a default for other and null keys."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), F.lit(default))


def region_of(league: Column) -> Column:
    return lookup(LEAGUE_REGION, league, "INT")


def region_number(region: Column) -> Column:
    return lookup(REGION_NUMBER, region, 9)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def matrix_value(x: Column) -> Column:
    """What a model reads: unknown becomes 0, and all is held within a million."""
    number = F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
    return clamp(number, -1e6, 1e6)


def control_share(own: Column, other: Column, floor: float = 0.5) -> Column:
    """own / max(own + other, floor); null if either is unknown."""
    return F.when(own.isNotNull() & other.isNotNull(), own / F.greatest(own + other, F.lit(floor)))


def _half_up(x: Column, digits: int) -> Column:
    """Half away from zero, with a hair's allowance for binary fractions."""
    scale = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5 + 1e-9) / scale


def signed_text(x: Column, digits: int = 2) -> Column:
    """+1.25, −1.25 (with a true minus sign), or 0."""
    r = _half_up(x, digits)
    body = F.format_string(f"%.{digits}f", F.abs(r))
    return F.when(r == 0, "0").when(r > 0, F.concat(F.lit("+"), body)).otherwise(F.concat(F.lit("−"), body))


def elo_text(x: Column) -> Column:
    """A rating as a whole number."""
    return _half_up(x, 0).cast("long").cast("string")


def percent_text(p: Column) -> Column:
    return F.concat(_half_up(p * 100, 0).cast("long").cast("string"), F.lit("%"))


def ratio_text(x: Column) -> Column:
    return F.format_string("%.1f", _half_up(x, 1))
