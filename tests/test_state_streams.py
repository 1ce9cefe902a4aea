"""Folds hold a key's state, not its events."""

import random

from pyspark.sql import functions as F

from quarry.operators import state as st


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_array_of_a_keys_events(spark):
    e = spark.createDataFrame([(1, 1, 5, "A", True, False)], "k int, i int, a int, step string, ok boolean, blocked boolean").withColumn("ts", F.timestamp_micros(F.col("i").cast("long")))
    made = [st.budget(e, "k", ["i"], "a", F.lit(9)), st.first_hit_windows(e, "k", order=["i"]), st.step_machine(e, "k", "i", ("A", "B"), "A")]
    assert [d.count() for d in made] == [1, 1, 1]
    assert not any("collect_list" in plan(d) for d in made)
    assert "RepartitionByExpression" in plan(st.routing_stats(e, ["k"], ["i"], "ok", "a"))


def test_routing_in_ranges(spark):
    rnd = random.Random(4)
    data = [("hot" if i % 5 else "cold", i, rnd.random() * 100, i % 3 == 0) for i in range(3000)]
    got = {r.k: (r.attempts, r.successes, r.latency) for r in st.routing_stats(spark.createDataFrame(data, "k string, i int, l double, ok boolean").repartition(6), ["k"], ["i"], "ok", "l").collect()}
    for k in ("hot", "cold"):
        own, acc = [d for d in data if d[0] == k], None
        for d in own:
            acc = d[2] if acc is None else acc * 0.7 + d[2] * 0.3
        assert got[k][:2] == (len(own), sum(d[3] for d in own)) and abs(got[k][2] - acc) < 2e-6
