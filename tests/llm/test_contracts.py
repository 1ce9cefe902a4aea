"""The registered queries on the small tables: SQL where there is some, the pipeline's stages by what they must keep."""

import pytest

import __spark_entry__
import corpus_pipeline
from quarry.llm import queries as lq
from quarry.llm import simhash
from tests.test_queries import SF, TABLES, plain


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(lq.oracle_sql()))
def test_sql(spark, duck, name):
    df = lq.queries()[name](spark, SF)
    order = sorted(df.columns)
    r = duck.execute(lq.oracle_sql()[name])
    names = [c[0] for c in r.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in at] == order
    assert sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str) == sorted((tuple(plain(x[c]) for c in order) for x in df.collect()), key=str)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        kept[name] = {r.doc_id: r for r in now.collect()}
        if name != "best_fit":
            assert now.columns == docs.columns
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept["quality"] for d in clean) >= 0.98 * len(clean)
    sets = {d: set(simhash.shingles(simhash.words(r.text or ""), 5).tolist()) for d, r in kept["quality"].items()}
    left = [d for d in kept["near_dedup"] if sets[d]]
    for i, a in enumerate(left):  # no near copies are left, and who went has one that stayed in its group
        for b in left[:i]:
            both = len(sets[a] & sets[b])
            assert not both or both < 0.8 * (len(sets[a]) + len(sets[b]) - both)
    seen = set()
    for d in sorted(kept["near_dedup"]):
        w = (kept["near_dedup"][d].text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        assert (kept["substring_dedup"][d].text or "").split() == [x for x, g in zip(w, gone, strict=True) if not g]
    assert set(kept["best_fit"]) == {d for d, r in kept["substring_dedup"].items() if (r.text or "").split()}


def test_pipeline_keeps_rows_without_an_id_of_their_own(spark):
    text = lambda n, k: " ".join(f"{n}{i}" for i in range(k))
    rows = [(1, text("a", 40)), (1, text("b", 40)), (1, text("b", 40)), (None, text("c", 40)), (None, text("c", 40)), (None, text("d", 40)), (2, text("a", 40)), (3, text("e", 40)), (4, None), (None, "")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, SF).collect()
    assert sorted(r.text or "" for r in got) == sorted([text("a", 40), text("b", 40), text("c", 40), text("d", 40), text("e", 40), "", ""])
    left = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(got, df.schema), SF).collect()
    assert sum(len((r.text or "").split()) for r in left) == 200
    assert corpus_pipeline.best_fit(spark, spark.createDataFrame(left, df.schema), SF).where("doc_id is null").count() == 2
    assert sum(r.doc_id is None for r in corpus_pipeline.quality(spark, df, SF).collect()) >= 0


def test_pipeline_takes_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    more = docs.selectExpr("*", "1 as __d", "true as __odd", "2 as __key", "3 as __text", "'x' as k_text", "'y' as votes", "4 as score", "5 as root")
    for name, stage in corpus_pipeline.STAGES[:3]:
        a, b = (sorted(map(str, stage(spark, d, SF).collect())) for d in (docs, more))
        assert a == b, name
