"""The vector index finds what a comparison with all rows finds."""

import random

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import search, vectors


def cloud(rng, n, dim=12):
    centres = [[rng.gauss(0, 3) for _ in range(dim)] for _ in range(8)]
    return [[x + rng.gauss(0, 0.3) for x in rng.choice(centres)] for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    data = cloud(rng, 700)
    rows = frame(spark, [*enumerate(data), (800, None), *((900 + i, data[5]) for i in range(30))])  # equal vectors: ties go by id
    queries = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vectors.VectorIndex(spark, str(tmp_path_factory.mktemp("v") / "index"))
    index.add(rows.where("id < 500"))
    index.add(rows.where("id >= 500"))
    return rows, queries, index


def test_equals_all_pairs(spark, tables, monkeypatch):
    rows, queries, index = tables
    for k in (1, 10, 2000):
        assert rows_of(index.search(queries, None, k)) == rows_of(search.nearest(rows, queries, k))
    scope = rows.where("id > 300")
    assert rows_of(index.search(queries, scope, 4)) == rows_of(search.nearest(scope, queries, 4))
    monkeypatch.setattr(search, "VECTOR_BYTES", 1500)  # blocks of queries
    assert rows_of(index.search(queries, None, 3)) == rows_of(search.nearest(rows, queries, 3))


def test_few_rows_are_compared(tables):
    rows, queries, index = tables
    n = rows.where("embedding is not null").count()
    share = index.compared(queries.where("query_id < 500"), 5).agg(F.avg("compared")).first()[0] / n
    assert share < 0.3


def test_changes(spark, tables, tmp_path):
    rows, queries, _ = tables
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    index.add(rows)
    moved = rows.where("id in (3, 4)").withColumn("embedding", F.transform("embedding", lambda x: (x + 1).cast("float")))
    index.add(moved, replace=True)
    index.remove(rows.where("id between 10 and 40"))
    now = rows.where("id not in (3, 4) and not id between 10 and 40").unionByName(moved)
    assert rows_of(index.search(queries, None, 6)) == rows_of(search.nearest(now, queries, 6))


def test_nothing_stored(spark, tmp_path, tables):
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    assert index.search(tables[1]).count() == 0
    index.add(frame(spark, [(1, None)]))
    assert index.search(tables[1]).count() == 0
    index.add(frame(spark, [(2, [0.0] * 12)]))
    assert {r.id for r in index.search(tables[1]).collect()} == {2}
