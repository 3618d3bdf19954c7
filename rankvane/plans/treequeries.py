"""Registered queries: trees grown by levels on the core features, as tables and as scores.

Their SQL compares every row with every cut of its node, without bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import trees as T
from ..sources import adapter as A
from ..sources.store import cut
from . import features
from .matchqueries import rounded

REGISTRY: dict = {}
SQL: dict[str, str] = {}
COLUMNS = features.CORE
DEPTH, MIN_SPLIT, MIN_LEAF, RATE = 4, 10, 15, 0.1


def query(sql: str):
    def add(f):
        REGISTRY[f.__name__] = f
        SQL[f.__name__] = A.BASE_SQL + features.SIDE_SQL + features.PAIR_SQL + sql
        return f

    return add


def _tree_sql(target: str, kept: str = "TRUE") -> str:
    """tree (node, feature number, threshold, rows, value) and at{DEPTH} (gameid, node), grown on `target` of the rows `kept`."""
    shares = ", ".join(map(repr, T.SHARES))
    values = ", ".join(f"round(greatest(least(coalesce({c}, 0), 1e6), -1e6), 6) + 0.0" for c in COLUMNS)
    steps = [
        f"rws AS MATERIALIZED (SELECT gameid, g.result AS y, [{values}] AS xs FROM pairrow JOIN (SELECT gameid, result FROM games) g USING (gameid))",
        f"tg AS MATERIALIZED (SELECT gameid, {kept} AS kept, floor(({target}) * {T.UNIT} + 0.5) AS t FROM rws)",
        "x AS MATERIALIZED (SELECT gameid, unnest(range(0, len(xs))) AS f, unnest(xs) AS x FROM rws)",
        f"few AS (SELECT f, count(DISTINCT x) <= {T.CUTS} AS few FROM x GROUP BY f)",
        f"cuts AS MATERIALIZED (SELECT f, c, row_number() OVER (PARTITION BY f ORDER BY c) AS k FROM (SELECT DISTINCT f, x AS c FROM x JOIN few USING (f) WHERE few UNION SELECT DISTINCT f, unnest(quantile_cont(x, [{shares}])) FROM x JOIN few USING (f) WHERE NOT few GROUP BY f))",
        "at0 AS (SELECT gameid, 1 AS node, TRUE AS live FROM rws)",
        "all0 AS (SELECT 1 AS node)",
    ]
    unit = f"{float(T.UNIT)}"
    gini = lambda s, n: f"(2 * ({s} / {n}) * (1 - {s} / {n}))"
    for d in range(DEPTH):
        steps += [
            f"nd{d} AS MATERIALIZED (SELECT node, count(*) AS n, sum(t) / {unit} AS s, min(t) = max(t) AS one FROM at{d} JOIN tg USING (gameid) WHERE live AND kept GROUP BY node)",
            f"sp{d} AS (SELECT node, x.f, c, k, count(*) AS nl, sum(t) / {unit} AS sl FROM at{d} JOIN tg USING (gameid) JOIN x USING (gameid) JOIN cuts ON cuts.f = x.f AND x.x <= c WHERE live AND kept GROUP BY ALL)",
            f"ga{d} AS (SELECT node, f, c, k, round({gini('s', 'n')} - (nl * {gini('sl', 'nl')} + (n - nl) * {gini('(s - sl)', '(n - nl)')}) / n, {T.DIGITS}) AS gain FROM sp{d} JOIN nd{d} USING (node) WHERE n >= {MIN_SPLIT} AND NOT one AND nl >= {MIN_LEAF} AND n - nl >= {MIN_LEAF})",
            f"be{d} AS MATERIALIZED (SELECT node, f, c FROM ga{d} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, k) = 1)",
            f"at{d + 1} AS MATERIALIZED (SELECT a.gameid, CASE WHEN c IS NULL THEN a.node ELSE 2 * a.node + (x.x > c)::INT END AS node, c IS NOT NULL AS live FROM at{d} a LEFT JOIN be{d} b ON a.node = b.node AND a.live LEFT JOIN x ON x.gameid = a.gameid AND x.f = b.f)",
        ]
    steps += [
        f"nd{DEPTH} AS (SELECT node, count(*) AS n, sum(t) / {unit} AS s FROM at{DEPTH} JOIN tg USING (gameid) WHERE live AND kept GROUP BY node)",
        "tree AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT node, f, c, n, s / n AS value FROM nd{d} LEFT JOIN be{d} USING (node)" for d in range(DEPTH)) + f" UNION ALL SELECT node, NULL, NULL, n, s / n FROM nd{DEPTH})",
    ]
    return ", " + ", ".join(steps)


NAMES = "[" + ", ".join(f"'{c}'" for c in COLUMNS) + "]"
CART_SQL = _tree_sql("y")
#: pairwise products in 64 bits: the same draw as trees._draw() for the first round
ROUND_SQL = _tree_sql("y - (SELECT avg(y) FROM rws)", "(gameid * 7919) % 1000003 % 1000 < 800")


def _rows(spark, sf) -> tuple[DataFrame, list[list[float]]]:
    """The core features with their bins, written once each, and the cuts."""
    g = cut(T.prepared(features.core(spark, sf).select("gameid", F.col("result").cast("double").alias("y"), *COLUMNS), COLUMNS))
    cuts = T.cuts_of(g, COLUMNS)
    return cut(T.binned(g, COLUMNS, cuts)), cuts  # every level of a tree reads the bins


def _cart(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The games with their bins, and the nodes of a tree on their results."""
    rows, cuts = _rows(spark, sf)
    tree = T.grow(rows.select("bins", F.col("y").alias("target"), F.lit(1).alias("w")), list(map(len, cuts)), DEPTH, MIN_SPLIT, MIN_LEAF)
    return rows, T.table_of(spark, [tree], COLUMNS, cuts)


@query(CART_SQL + f"SELECT node::BIGINT AS node, ({NAMES})[f + 1] AS feature, round(c, 6) AS threshold, n AS games, round(value, 6) AS value FROM tree")
def cart_tree(spark, sf):
    _, nodes = _cart(spark, sf)
    return rounded(nodes.select("node", "feature", "threshold", F.col("rows").cast("long").alias("games"), "value"))


@query(CART_SQL + f"SELECT gameid, round(value, 6) AS p FROM at{DEPTH} JOIN tree USING (node)")
def cart_scores(spark, sf):
    rows, nodes = _cart(spark, sf)
    return rounded(T.scored(rows, nodes).select("gameid", F.col("value")[0].alias("p")))


@query(CART_SQL + f"SELECT ({NAMES})[f + 1] AS feature, round(count(*) / (SELECT count(*) FROM tree WHERE f IS NOT NULL), 6) AS share FROM tree WHERE f IS NOT NULL GROUP BY f")
def cart_split_shares(spark, sf):
    return rounded(T.split_shares(_cart(spark, sf)[1]))


@query(ROUND_SQL + f", p AS (SELECT avg(y) AS p FROM rws) SELECT gameid, round(1 / (1 + exp(-(ln(p / (1 - p)) + {RATE} * value))), 6) AS p FROM at{DEPTH} JOIN tree USING (node), p")
def boosting_round(spark, sf):
    rows, cuts = _rows(spark, sf)
    start, made = T.boost(rows, list(map(len, cuts)), 1, RATE, depth=DEPTH, min_split=MIN_SPLIT, min_leaf=MIN_LEAF)
    scored = T.scored(rows, T.table_of(spark, made, COLUMNS, cuts))
    return rounded(scored.select("gameid", T.boosted_probability("value", start, RATE).alias("p")))
