"""A task that folds several pools of teams, in batches that hold the end of one and the start of the next."""

import datetime as dt

from rankvane.operators import elo


def games(spark, pools=6, each=40):
    rows = [(1000 * p + i, dt.datetime(2020 + i % 5, 1 + i % 12, 1 + i % 28), 10 * p + i % 3, 10 * p + 3 + i % 2, i % 2, 1) for p in range(pools) for i in range(each)]
    return spark.createDataFrame(rows, "gameid long, date timestamp, team_a long, team_b long, result int, tier int")


def test_pools_that_share_a_task_and_its_batches(spark):
    shuffle, batch = "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(shuffle)
    spark.conf.set(shuffle, "1")
    spark.conf.set(batch, "7")
    try:
        got = {r["gameid"]: r["elo_diff"] for r in elo.elo(games(spark).coalesce(1)).collect()}
    finally:
        spark.conf.set(shuffle, before)
        spark.conf.unset(batch)
    assert len(got) == 240
    # pools are alike, so each has the ratings of the first
    assert all(abs(got[g] - got[g % 1000]) < 1e-9 for g in got)
