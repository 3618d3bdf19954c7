"""The probed model is fitted on rows that are scaled in batches and written once."""

import datetime as dt

import numpy as np
from pyspark.ml.classification import LogisticRegression

from rankvane.plans import evalqueries, versions


def test_probes_fit_on_written_rows(spark, monkeypatch):
    columns, rng = list(versions.VERSIONS[4]), np.random.default_rng(4)
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), i % 5, i % 2, *map(float, rng.normal(size=len(columns)))) for i in range(120)]
    table = spark.createDataFrame(rows, "gameid long, date timestamp, team_a long, result int, " + ", ".join(f"`{c}` double" for c in columns))
    monkeypatch.setattr(evalqueries, "feature_table", lambda *_: table)
    plans, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: (plans.append(df._jdf.queryExecution().toString()), fit(self, df))[1])
    assert evalqueries.edge_probes(spark, "").count() == 15
    assert "ExistingRDD" in plans[0] and "MapInArrow" not in plans[0]
