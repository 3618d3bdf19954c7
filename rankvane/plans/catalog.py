"""All registered queries of the match-history engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evalqueries, literalqueries, matchqueries, treequeries, versions

MODULES = (matchqueries, evalqueries, versions, literalqueries, treequeries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of all games as a forecast, measured: auc, brier, logloss, acc and n."""
    return evalqueries.elo_baseline_metrics(spark, sf_dir)
