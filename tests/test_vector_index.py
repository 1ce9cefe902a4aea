"""The approximate vector index against the exact search."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import vector_index as vi
from quarry.plans import documents


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    """Of the ten nearest of every query nine in ten or more are found, with their exact scores."""
    d = f"/root/testdata/{sf}"
    want = {(r.query_id, r.chunk_id): r.score for r in documents.dense_topk(spark, d).collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in documents.approximate_topk(spark, d).collect()}
    both = want.keys() & got.keys()
    assert len(both) >= 0.9 * len(want) and len(got) == len(want)
    assert all(abs(want[x] - got[x]) < 2e-6 for x in both)


def test_every_usable_row_is_indexed(spark, tmp_path, monkeypatch):
    """Also those that the sample does not hold, of other lengths, and repeated ones; unusable vectors take no part."""
    monkeypatch.setattr(vi, "SAMPLE", 60)
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(10)]) for i in range(300)] + [(900, None), (901, [0.0] * 10), (902, [1.0, None]), (903, [float("nan")] * 10), (904, [1.0, 2.0]), (905, []), (None, [1.0] * 10), (7, [1.0] * 10)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = vi.build(df, lists=8, parts=4, path=str(tmp_path / "v"))
    assert sorted(r.key for r in index.rows.select("key").collect()) == sorted([*range(300), 904, 7])
    asked = df.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    got = vi.top_k(asked, index, 3, probes=8, per_block=2).collect()
    nearest = {r.query_id: r.chunk_id for r in got if r["rank"] == 1}
    assert {q: c for q, c in nearest.items() if q < 300} == {q: q for q in range(0, 300, 50)} and all(abs(r.score - 1) < 1e-9 for r in got if r["rank"] == 1 and r.query_id < 300)
    assert len(got) == 3 * len(nearest)


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    index = vi.build(none, path=str(tmp_path / "none"))
    assert index.rows.isEmpty()
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert vi.top_k(asked, index, 3).isEmpty() and vi.top_k(asked.where(F.lit(False)), index, 3).isEmpty()
