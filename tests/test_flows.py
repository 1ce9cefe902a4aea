"""Compositions, on small tables whose results are known."""

import pytest
from pyspark.sql import functions as F

from quarry import seams
from quarry.operators import flows
from quarry.operators import retrieval as rt
from quarry.sources import readers as rd

TEXT = "一、总则\n\n变压器额定电压 110kV，投标人必须提供资质证书。\n\n二、评分标准\n\n技术方案评分 30 分，优先考虑业绩加分。"


@pytest.fixture
def docs(spark):
    rows = [(1, TEXT), (2, "投标报价：总价 1000 万元，单价 20 元。\n\n合计金额 3000000 元"), (3, None), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_ingest(docs):
    got = flows.ingest(docs, "doc_id", "2024-01-31", tokens=(5, 40, 0))
    blocked = {r.doc_id: r.blocked for r in got.documents.collect()}
    assert blocked == {1: False, 2: True, 3: False, 4: False}
    sections = got.sections.orderBy("section_id").collect()
    assert [(r.doc_id, r.section_id) for r in sections] == [(1, "S001"), (1, "S002")] and "110kV" in sections[0].text
    chunks = got.chunks.collect()
    assert {r.doc_id for r in chunks} == {1} and len({r.chunk_id for r in chunks}) == len(chunks) and "".join(r.text for r in chunks).count("110kV") == 1
    assert got.documents.where("doc_id = 1").first().voltage_level_kv == 110


def test_analyse(docs):
    got = flows.analyse(docs, "doc_id")
    assert {r.doc_id for r in got.insights.collect()} == {1} and {r.doc_id for r in got.summary.collect()} == {1}
    assert any(r.is_must and "资质" in r.content for r in got.requirements.collect())
    assert "COMPLIANCE_REQUIREMENTS" in {r.category for r in got.insights.collect()}


def test_requirement_insights_have_a_default_row(spark):
    said = spark.createDataFrame([(1, 1, "nothing of note here", None), (1, 2, "投标人必须提供资质证书", None)], "doc_id long, pos int, content string, anchor string")
    got = sorted((r.pos, r.category, r.importance) for r in flows.requirement_insights(said, "doc_id", power=None).collect())
    assert got[0] == (1, "BIDDING_POINTS", 50) and (2, "COMPLIANCE_REQUIREMENTS", 75) in got


def test_retrieve_parts(spark):
    asked = spark.createDataFrame([(7, "green apples and pears, red cherries from spain")], "req long, text string")
    texts = ["green apples and pears are sold here", "red cherries from spain", "nothing"]
    chunks = spark.createDataFrame([(i, t, None, 50.0, "PUBLIC_OK", ["X"], "active", None, None) for i, t in enumerate(texts)], "chunk_id long, text string, embedding array<double>, quality double, sensitivity string, tags array<string>, status string, valid_to date, expires date")
    got = {r.chunk_id: (r.position, list(r.covers)) for r in flows.retrieve_parts(asked, chunks, "req", "text", "2024-01-31").collect()}
    assert got == {0: (1, [1]), 1: (2, [2])}


def test_reuse_makes_each_key_once(spark, tmp_path):
    made = []

    def make(df):
        made.append(sorted(r.section for r in df.collect()))
        return df.select("outline", "section", F.upper("section").alias("out"))

    at, schema = str(tmp_path / "artefacts"), "outline string, section string"
    first = flows.reuse(spark.createDataFrame([("o", "a"), ("o", "a"), ("o", "b")], schema), ["outline", "section"], make, at)
    assert sorted(r.out for r in first.collect()) == ["A", "B"]
    then = flows.reuse(spark.createDataFrame([("o", "b"), ("o", "c")], schema), ["outline", "section"], make, at)
    assert sorted(r.out for r in then.collect()) == ["B", "C"] and made == [["a", "b"], ["c"]]


def test_two_runs_at_once_make_no_key_twice(spark, tmp_path):
    """While one run makes its rows, another makes the same ones: both read one run's."""
    at, schema = str(tmp_path / "artefacts"), "outline string, section string"
    work = spark.createDataFrame([("o", "a"), ("o", None), ("p", "a")], schema)
    own = lambda tag: lambda df: df.select("outline", "section", F.explode(F.array(F.lit(tag), F.lit(tag.upper()))).alias("out"))  # noqa: E731  two rows a key

    def slow(df):
        flows.reuse(work, ["outline", "section"], own("y"), at)
        return own("x")(df)

    first = flows.reuse(work, ["outline", "section"], slow, at).collect()
    then = flows.reuse(work, ["outline", "section"], own("z"), at).collect()
    assert sorted(map(str, first)) == sorted(map(str, then)) and len(first) == 6
    assert len({r.out.lower() for r in first}) == 1 and "__run" not in first[0]


def test_promoting_again_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    staged, target = rd.stage(df, str(tmp_path / "s")), str(tmp_path / "t")
    for confirmed in ("k = 2", "k = 2", "k > 1"):
        rd.promote(spark, staged, df.where(confirmed), target, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [(2, "b"), (3, "c")]


HITS = "query_id long, chunk_id long, query string, text string, score double, quality double, rank int"


def test_rerank_by_a_model(spark):
    hits = spark.createDataFrame([(1, 1, "red pump", "red pump here", 0.1, 0.0, 2), (1, 2, "red pump", "nothing", 0.9, 0.0, 1), (2, 1, "x", "x", 0.5, 50.0, 1), (2, 3, "x", "odd", 0.4, 0.0, 2)], HITS).coalesce(1)
    by = lambda make, k=5: [(r.query_id, r.chunk_id, r["rank"]) for r in seams.rerank_by(hits, make, k).orderBy("query_id", "rank").collect()]
    words = [(r.query_id, r.chunk_id, r["rank"]) for r in rt.rerank(hits, 5).orderBy("query_id", "rank").collect()]
    assert by(lambda: lambda q, t: [len(x) for x in t]) == [(1, 1, 1), (1, 2, 2), (2, 3, 1), (2, 1, 2)]
    assert by(lambda: lambda q, t: [0.0] * len(t)) == [(1, 2, 1), (1, 1, 2), (2, 1, 1), (2, 3, 2)]  # equal scores keep their order
    assert by(lambda: lambda q, t: [0.0] * len(t), 1) == [(1, 2, 1), (2, 1, 1)]

    def absent():
        raise ImportError("no model")

    assert by(absent) == words and by(lambda: lambda q, t: 1 / 0) == words and by(lambda: lambda q, t: [1.0]) == words
    some = by(lambda: lambda q, t: [float("nan") if "nothing" in x else -len(x) for x in t])  # query 1 by words, query 2 by the model
    assert some[:2] == words[:2] and some[2:] == [(2, 1, 1), (2, 3, 2)]


def test_facts_or_a_fallback(spark):
    df = spark.createDataFrame([(1, "a=1 b=2"), (2, "a=3"), (3, "")], "k long, text string")
    rules = (("a", r"a=(\d)"), ("b", r"b=(\d)"))
    asked = []

    def fallback(d):
        asked.extend(r.k for r in d.collect())
        return d.select("k", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value")) for f, v in (("a", "9"), ("b", "8"), ("b2", None))])))

    got = {(r.k, r.field): r.value for r in seams.facts_or(df, "k", fallback, patterns=rules).collect()}
    assert got == {(1, "a"): "1", (1, "b"): "2", (2, "a"): "3", (2, "b"): "8", (3, "a"): "9", (3, "b"): "8"} and sorted(asked) == [2, 3]
    assert seams.facts_or(df, "k", patterns=rules).count() == 3


def test_scorecard_by_a_model(spark):
    tables = spark.createDataFrame([(1, 1, "| n | s |\n| --- | --- |\n| pump | 5 points |\n| valve | 7 |")], "k long, table_no int, table_md string")
    assert sorted((r.name, r.score, r.total, r.status) for r in seams.scorecard_by(tables, "k").collect()) == [("pump", 5.0, 12.0, "PENDING_CONFIRM"), ("valve", 7.0, 12.0, "PENDING_CONFIRM")]
    made = lambda t: t.select("k", F.lit(1).alias("item_no"), F.lit("all").alias("name"), F.lit(None).cast("double").alias("score"))
    assert [(r.name, r.score, r.total) for r in seams.scorecard_by(tables, "k", made).collect()] == [("all", 0.0, 0.0)]
