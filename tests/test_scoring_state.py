import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import analytics as an
from quarry.operators import relational as rl
from quarry.operators import scoring as sc
from quarry.operators import state as st


def test_score_v2_example(spark):
    p = spark.createDataFrame([("i", 10.0, "a", 10.0, 0.8, 0.6, 0.5, 0.2, False, False), ("j", 10.0, "b", 5.0, 1.0, 1.0, 1.0, 0.0, True, False), ("k", 3.0, "c", 5.0, 1.0, 1.0, 1.0, 0.0, False, False)], "item_id string, max_score double, point_id string, weight double, cov double, evi double, spec double, risk double, negative_deviation boolean, arithmetic_conflict boolean")
    assert {r.item_id: (r.score, r.clamped) for r in sc.score_items(p).collect()} == {"i": (5.9, 0.0), "j": (0.0, 0.0), "k": (3.0, 2.0)}


def test_simulated_score(spark):
    req = spark.createDataFrame([(1, "A", 5.0, "t"), (1, "B", 5.0, "t"), (1, "C", 5.0, "t"), (1, "D", 5.0, "t")], "project_id int, code string, weight double, text string")
    sec = spark.createDataFrame([(1, "s1", ["A", "B"], "x", 1), (1, "s2", ["C"], "x", 1)], "project_id int, section_key string, codes array<string>, content string, created_at int")
    rep = spark.createDataFrame([(1, "s1", "FAIL", [("A", "bad")], 1)], "project_id int, section_key string, status string, issues array<struct<code:string,description:string>>, created_at int")
    got = {r.code: (r.status, r.score) for r in sc.simulated_score(req, sec, rep).collect()}
    assert got == {"A": ("FAIL", 0.0), "B": ("PASS", 5.0), "C": ("UNREVIEWED", 0.0), "D": ("UNPLANNED", 0.0)}


def test_coverage(spark):
    def of(a, b):
        r = spark.createDataFrame([(a, b)], "a string, b string").select(sc.coverage(F.col("a"), F.col("b")).alias("c")).first().c
        return r.supported, r.confidence

    assert of("alpha beta", "alpha beta gamma") == (True, 0.9)
    assert of("变压器安装", "关于变压器安装的说明") == (True, 0.65)
    assert of("alpha", "") == (False, 0.0)


def test_redline_and_readiness(spark):
    p = spark.createDataFrame([(1, "capacity", 500.0, 200.0), (2, "capacity", 500.0, 600.0)], "k int, parameter_name string, required_value double, provided_value double")
    f = sc.redline(p, "k")
    assert {r.k: r.status for r in sc.redline_status(p, f, "k").collect()} == {1: "BLOCKED", 2: "PASS"}
    d = spark.createDataFrame([(1, "2024-01-01", "2024-01-31", 20, 40), (2, "x", "2024-01-31", None, 10), (3, "2024-02-01", "2024-01-01", None, 10)], "k int, start_date string, completion_date string, committed_days int, min_days int")
    assert sorted(tuple(r) for r in sc.duration_findings(d, "k").collect()) == [(1, "MISMATCH"), (2, "INVALID_DATE"), (3, "REVERSED")]


def test_votes_triage_gates(spark):
    r = spark.createDataFrame([("k", 0, "PASS", 50.0, 0.9, ["a"]), ("k", 1, "fail", 90.0, 0.5, ["b", "a"]), ("m", 0, "", 1.0, 0.1, [])], "k string, idx int, status string, quality double, coverage double, issues array<string>")
    got = {x.k: (x.status, x.best, x.issues) for x in sc.vote(r, "k").collect()}
    assert got == {"k": ("PASS", 1, ["a", "b"]), "m": ("FAIL", 0, [])}
    assert spark.range(1).select(sc.repaired_json(F.lit('```json\n{"a": [1,2,],}\n```'))).first()[0] == '{"a": [1,2]}'


def test_budget_like_a_loop(spark):
    rnd = random.Random(2)
    data = [(k, i, rnd.randrange(1, 40)) for k in range(5) for i in range(20)]
    got = {(r.k, r.i): (r.accepted, r.remaining) for r in st.budget(spark.createDataFrame(data, "k int, i int, a int"), "k", ["i"], "a", F.lit(100)).collect()}
    for k in range(5):
        left = 100
        for _, i, a in (x for x in data if x[0] == k):
            ok = a <= left
            left -= a if ok else 0
            assert got[k, i] == (ok, left)


def test_first_hit_windows(spark):
    df = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}") for s in (1, 5, 10, 12, 30)], "k string, t string").select("k", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = [(r.window_no, r.n, r.allowed) for r in st.first_hit_windows(df, "k", limit=2, seconds=10).orderBy("ts").collect()]
    assert got == [(1, 1, True), (1, 2, True), (1, 3, False), (2, 1, True), (3, 1, True)]


def test_step_machine(spark):
    e = spark.createDataFrame([(1, 1, "A", True, False), (1, 2, "A", True, False), (1, 3, "C", False, True), (1, 4, "B", False, False), (1, 5, "B", False, False), (1, 6, "B", True, False)], "k int, i int, step string, ok boolean, blocked boolean")
    got = [r.outcome for r in st.step_machine(e, "k", "i", ("A", "B", "C"), "B", 2).orderBy("i").collect()]
    assert got == ["success", "skipped", "blocked", "failed", "failed", "max_retries"]


def test_prices_and_routing(spark):
    m = spark.createDataFrame([("GPT-4o",), ("x/gpt-4o-mini",), ("gpt-4o-mini-2024",), ("qwen3.5:7b",), ("other",), ("",)], "model string")
    got = {r.model: r.key for r in an.price_keys(m, an.prices(spark)).collect()}
    assert got == {"GPT-4o": "gpt-4o", "x/gpt-4o-mini": "gpt-4o-mini", "gpt-4o-mini-2024": "gpt-4o-mini", "qwen3.5:7b": "qwen3.5", "other": None, "": None}
    assert [spark.range(1).select(st.reward(*map(F.lit, x))).first()[0] for x in ((0, 0, 0.0), (10, 10, 0.0), (10, 0, 8000.0))] == [0.5, 1.0, 0.0]


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, "won", "2024-01-05", " p "), (2, "x", None, ""), (3, "LOST", "bad", None)], "id int, result string, date string, project string")
    assert [(r.id, r.error, r.project_norm) for r in rl.validated(df).orderBy("id").collect()] == [(1, None, "p"), (2, "bad result", None), (3, "bad date", None)]
    assert rl.clamp(0, 200) == 1 and rl.clamp(999, 200) == 200
    pool = spark.createDataFrame([(1, "own", '{"asset_type": " Person "}'), (1, "rent", '{"asset_type": "tool"}'), (2, "own", "{}")], "project_id int, ownership_role string, metadata string")
    assert rl.asset_pool(pool, 1, ["own"], "person").count() == 1
    v = spark.createDataFrame([("A", 2010, "active"), ("A", 2016, "active"), ("A", 2018, "x")], "code string, year int, status string")
    assert [r.year for r in rl.active_versions(v, "code", "A", "year").collect()] == [2016, 2010]


def test_order_of_rows_does_not_matter(spark):
    data = [(f"k{i % 3}", i, float(i * 7 % 11), i % 2 == 0) for i in range(30)]
    df = spark.createDataFrame(data, "k string, i int, l double, ok boolean")
    a = st.routing_stats(df, ["k"], ["i"], "ok", "l").orderBy("k").collect()
    b = st.routing_stats(df.repartition(7).orderBy(F.desc("i")), ["k"], ["i"], "ok", "l").orderBy("k").collect()
    assert a == b
    assert list(itertools.islice((r.attempts for r in a), 3)) == [10, 10, 10]
