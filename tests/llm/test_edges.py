"""Nulls, empty tables, repeated rows and clashing extra columns, for all operators and stages."""

import os

import pytest

import corpus_pipeline
from rankvane.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = {"op1": "pages", "op11": "embeddings"}
EXTRA = ["my col", "a.b", "tick`s", "__h", "words", "item", "start", "name", "rank", "seq", "fp", "node", "slice", "packed", "score", "word", "hits", "value", "part", "label", "bucket", "n", "kept"]


def rows_of(spark, name, odd):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    if odd == "empty":
        return df.limit(0)
    some = df.orderBy(df.columns[0]).limit(25)
    if odd == "nulls":
        nothing = spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)
        gone = [spark.createDataFrame([tuple(None if c == x else v for x, v in zip(df.columns, some.first()))], df.schema) for c in df.columns]
        for g in gone:
            nothing = nothing.union(g)
        some = some.union(nothing)
        if name == "documents":  # empty and very long, of spaces, lines and words
            first = some.filter("text is not null").first().asDict()
            texts = ["", " \n\t ", "word " * 60_000, "line\n" * 20_000, "x" * 200_000]
            some = some.union(spark.createDataFrame([tuple({**first, "text": t}[c] for c in df.columns) for t in texts], df.schema))
    if odd == "repeated":
        some = some.union(some).union(some)
    if odd == "extra":
        for c in EXTRA:
            if c not in df.columns:
                some = some.selectExpr("*", "'x' AS `{}`".format(c.replace("`", "``")))
    return some


@pytest.fixture(scope="module", params=["nulls", "empty", "repeated", "extra"])
def odd_tables(spark, request, tmp_path_factory):
    top = str(tmp_path_factory.mktemp(request.param))
    for name in ("documents", "pages", "labels", "benchmark", "embeddings"):
        rows_of(spark, name, request.param).write.parquet(f"{top}/{name}.parquet")
    return request.param, top


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_a_result_for_each_row(spark, odd_tables, name):
    odd, top = odd_tables
    got = Q.queries()[name](spark, top).collect()
    if name.startswith("op12_"):
        items = spark.read.parquet(f"{top}/benchmark.parquet").count()
        assert len(got) <= 20 * items and (odd == "empty" or got)
        return
    given = spark.read.parquet(f"{top}/{TABLES.get(name.split('_')[0], 'documents')}.parquet")
    if name.startswith("op11_"):
        given = given.filter("embedding IS NOT NULL")
    assert len(got) == given.count() * (2 if name.startswith("op1_") else 1)


def test_stages(spark, odd_tables, tmp_path):
    odd, top = odd_tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, top).write.parquet(os.path.join(tmp_path, name))
        docs = spark.read.parquet(os.path.join(tmp_path, name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert docs.count() <= n
        n = docs.count()
    assert odd == "empty" or n > 0
