"""Terms in texts, in both forms, against plain searches; the synonym and price joins that no longer compare every pair."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import analytics as an
from quarry.operators import retrieval as rt
from quarry.operators import terms as tm

TEXT, TERM = "k long, text string", "term string"


@pytest.mark.parametrize("most", [None, 0])
def test_every_place_is_found(spark, most):
    """Overlapping terms, terms in terms, other planes; by automaton (None) and by hash join (0)."""
    rnd = random.Random(1)
    terms = ["".join(rnd.choice("abé😀") for _ in range(rnd.randrange(1, 8))) for _ in range(60)] + ["aa", "aaa", "", None, "aa", "a\nb"]
    texts = [(i, "".join(rnd.choice("aabé😀\n") for _ in range(rnd.randrange(0, 60)))) for i in range(50)] + [(99, None), (98, ""), (97, "aaaa"), (97, "aaaa")]
    got = tm.find(spark.createDataFrame(texts, TEXT), spark.createDataFrame([(t,) for t in terms], TERM), keep=("k",), most=most)
    want = [(k, t, i) for k, x in texts for t in {t for t in terms if t} for i in range(len(x or "")) if x.startswith(t, i)]
    assert sorted((r.k, r.term, r["at"]) for r in got.collect()) == sorted(want) and len(want) > 300
    assert "Nested" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [None, 0])
def test_no_terms_or_texts(spark, most):
    none, some = spark.createDataFrame([], TERM), spark.createDataFrame([(1, "abc")], TEXT)
    assert tm.find(some, none, keep=("k",), most=most).isEmpty()
    assert tm.find(some.limit(0), spark.createDataFrame([("a",)], TERM), keep=("k",), most=most).isEmpty()


def test_a_hundred_thousand_terms_in_one_pass(spark):
    rnd = random.Random(2)
    terms = {"".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(5, 12))) for _ in range(100_000)}
    texts = [(i, "".join(rnd.choice("abcdefgh") for _ in range(3000))) for i in range(20)]
    got = tm.find(spark.createDataFrame(texts, TEXT), spark.createDataFrame([(t,) for t in terms], TERM), keep=("k",))
    want = {(k, x[i : i + n], i) for k, x in texts for n in range(5, 12) for i in range(len(x) - n + 1) if x[i : i + n] in terms}
    assert {(r.k, r.term, r["at"]) for r in got.collect()} == want and len(want) > 1000
    one = tm.find(spark.createDataFrame(texts, TEXT), spark.createDataFrame([("abc",)], TERM), keep=("k",))
    nodes = lambda d: d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert nodes(got) == nodes(one)  # as many passes as for one term


def test_synonyms(spark):
    synonyms = [("pump", "impeller"), ("pump", "pump set"), ("valve", "tap"), ("", "never"), ("set", "kit")]
    queries = [(1, "a pump set"), (2, "valve and pump"), (3, "none"), (4, None), (5, "valve"), (5, "valve")]
    out = rt.expand(spark.createDataFrame(queries, "q long, query string"), spark.createDataFrame(synonyms, "term string, alias string"))
    got = sorted((r.q, r.expanded) for r in out.collect())
    assert got == [(1, "a pump set impeller kit"), (2, "valve and pump impeller pump set tap"), (3, "none"), (4, ""), (5, "valve tap"), (5, "valve tap")]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_price_keys(spark):
    keys = ["gpt", "gpt-4", "gpt-4o", "house", "a", "qwen", "v/gpt"]
    names = ["gpt-4o", "GPT-4o-mini", "gpt-4omni", "v/gpt-4:x", "x/y/house@1", "house", "", None, "  ", "qwen", "qwenx", "a/b", "b-a", "v/gpt-9", "/a"]
    out = an.price_keys(spark.createDataFrame([(n,) for n in names], "model string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    got = {r.model: r.key for r in out.collect()}

    def want(name):
        n = (name or "").strip(" ").lower()
        if not n:
            return None
        alias = n.split("/")[-1]
        if n in keys or alias in keys:
            return n if n in keys else alias
        found = [k for s in (n, alias) for k in keys if any(s.startswith(k + x) for x in "-:@/")]
        return max(found, key=len) if found else None

    assert got == {n: want(n) for n in names}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_find_keeps_to_null_safe_columns(spark):
    df = spark.createDataFrame([(1, "xay", "t", 5)], "k long, text string, term string, at long")
    assert [tuple(r) for r in tm.find(df.select("k", "text"), spark.createDataFrame([("a",)], TERM), keep=("k",)).collect()] == [(1, "a", 1)]
    assert tm.find(df, spark.createDataFrame([(None,)], TERM), keep=("k",)).select(F.count("*")).first()[0] == 0
