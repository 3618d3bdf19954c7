"""Command line: builds the feature tables of a folder and compares the versions' models.

    python -m rankvane.evaluate --data-dir DIR --out-dir DIR [--holdout LEAGUE YEAR]
        [--versions V1 V4] [--trees 100] [--model-dir DIR]
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics, models
from .plans import versions
from .sources import logs
from .sources.store import cut


NAMES = {f"V{v}": list(c) for v, c in versions.VERSIONS.items()}


def parsed(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--data-dir", required=True, help="where the Parquet tables are")
    p.add_argument("--out-dir", required=True)
    p.add_argument("--holdout", nargs=2, metavar=("LEAGUE", "YEAR"), help="games to predict; all that were played earlier are learned from")
    p.add_argument("--versions", nargs="*", default=list(NAMES), choices=list(NAMES))
    p.add_argument("--trees", type=int, default=100)
    p.add_argument("--model-dir", help="where the logistic regression of the last version goes, if anywhere")
    return p.parse_args(argv)


def tables(spark: SparkSession, data_dir: str, chosen: list[str]) -> dict[str, DataFrame]:
    """Each version's own feature table, of the games that all of them have."""
    made = {n: versions.features(spark, data_dir, int(n[1:])).filter("n_games_a >= 5 AND n_games_b >= 5") for n in chosen}
    return models.common_games(made)


def report(found: DataFrame, out_dir: str, tag: dict) -> None:
    logs.write_results(found.orderBy("version", "model"), f"{out_dir}/model_comparison", **tag)
    logs.write_json(found, f"{out_dir}/model_comparison_json")


def fitted(table: DataFrame, columns: list[str], event: Column | None, trees: int):
    """The last version's test rows, both models, and the columns' means and spreads."""
    order = ["date", "gameid"]
    split = cut(metrics.temporal_split(table, order) if event is None else metrics.event_holdout(table, event, order))
    means, spreads = metrics.moments(split, columns, F.col("part") == "train")
    rows = cut(models.matrix(metrics.scaled(split, means, spreads), columns))
    train = rows.filter(F.col("part") == "train")
    return rows.filter(F.col("part") == "test"), models.logistic().fit(train), models.boosted(maxIter=trees).fit(train), means, spreads


def main(argv: list[str] | None = None) -> None:
    a = parsed(argv)
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    event = (F.col("league") == a.holdout[0]) & (F.col("year") == int(a.holdout[1])) if a.holdout else None
    tag = {"event": a.holdout[0], "year": int(a.holdout[1])} if a.holdout else {}
    own = tables(spark, a.data_dir, a.versions)
    report(cut(models.compare_versions(own, {n: NAMES[n] for n in a.versions}, a.trees, event=event)), a.out_dir, tag)

    last = a.versions[-1]
    test, lr, gbdt, means, spreads = fitted(own[last], NAMES[last], event, a.trees)
    if a.model_dir:
        models.save(lr, a.model_dir, NAMES[last], means, spreads)
    if event is None:
        share = models.split_importance(gbdt, NAMES[last])
        top = spark.createDataFrame(sorted(share.items(), key=lambda x: (-x[1], x[0]))[:30], "feature string, importance double")
        logs.write_results(top, f"{a.out_dir}/feature_importance")
    else:
        scored = models.predict(gbdt, models.predict(lr, test, "p_team_a_lr"), "p_team_a_gbdt")
        logs.write_results(scored.select("gameid", "date", "league", "team_a", "team_b", "result", "p_team_a_lr", "p_team_a_gbdt"), f"{a.out_dir}/predictions", **tag)


if __name__ == "__main__":
    main()
