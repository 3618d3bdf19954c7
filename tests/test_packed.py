"""Moments and the models' matrix are made of arrays in batches, and the sides' frames meet as arrays."""

import pytest
from pyspark.sql import functions as F

from rankvane.operators import metrics, models

DATA = [(float(i), None if i % 3 else i * 1e-3, i % 2 == 0, 5.0, None, float("inf") if i == 7 else float(-i), int(i < 30)) for i in range(40)]
KIND = "a double, b double, c boolean, d double, e double, f double, result int"


def test_moments_are_those_of_the_aggregates(spark):
    df = spark.createDataFrame(DATA, KIND).repartition(7)
    columns = ["a", "b", "d", "e"]
    means, spreads = metrics.moments(df, columns, F.col("result") == 1)
    want = df.filter("result = 1").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    for c in columns:
        assert means[c] == pytest.approx(want[f"m_{c}"] or 0.0, rel=1e-12)
        assert spreads[c] == pytest.approx(want[f"s_{c}"] or 1.0, rel=1e-12)
    assert spreads["d"] == 1.0 and metrics.moments(df, ["a"], F.lit(False)) == ({"a": 0.0}, {"a": 1.0})


def test_scaled_matrix_is_the_matrix_of_scaled_columns(spark):
    df = spark.createDataFrame(DATA, KIND)
    columns = ["a", "b", "c", "d", "e", "f"]
    means, spreads = dict(zip(columns, (3.0, 0.01, 0.5, 5.0, 0.0, 0.0))), dict(zip(columns, (2.0, 1e-9, 0.5, 1.0, 1.0, 1.0)))
    plain = models.matrix(metrics.scaled(df.withColumn("c", F.col("c").cast("double")), means, spreads), columns)
    packed = models.scaled_matrix(df.select("a", F.col("result").cast("double").alias("y"), metrics.packed(columns)), means, spreads)
    pairs = zip(plain.collect(), packed.collect())
    assert all(list(p.features) == pytest.approx(list(q.features)) and p.y == q.y for p, q in pairs)


def test_frames_of_sides_are_stored_as_arrays(spark):
    from rankvane.plans import versions
    from rankvane.sources.store import FeatureStore

    with FeatureStore(spark, "gameid") as store:
        _, _, per_team = versions.stored_frames(spark, "/root/testdata/sf0.001", store, 1)
        assert [f.columns for f, _ in per_team] == [["gameid", "team", "xs"]]
