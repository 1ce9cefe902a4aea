"""Keyed streams give what the batch forms give, over several files and after a restart in the middle."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import state as st
from quarry.plans import streams as plans
from quarry.plans.views import table
from quarry.streaming import keyed as ks
from quarry.streaming import streams as ss

STEPS = ("G1", "G2", "G3")
FIELDS = "k long, i long, ts timestamp, a long, step string, ok boolean, blocked boolean"


def events(n, seed):
    rnd = random.Random(seed)
    rows, now = [], 0
    for i in range(n):
        now += rnd.choice([0, 0, 1, 5, 40, 200])
        rows.append((None if rnd.random() < 0.02 else rnd.randrange(4), i, now, rnd.choice([None, 0, 5, 30, 80]), rnd.choice([*STEPS, "odd", None]), rnd.choice([True, False, None]), rnd.random() < 0.2))
    return rows


def forms():
    return {
        "budget": (lambda d: ks.budget(d, "k", ["ts", "i"], "a", F.lit(300)), lambda d: st.budget(d, "k", ["ts", "i"], "a", F.lit(300))),
        "hits": (lambda d: ks.first_hit_windows(d, "k", order=["i"], limit=2, seconds=60), lambda d: st.first_hit_windows(d, "k", order=["i"], limit=2, seconds=60)),
        "steps": (lambda d: ks.step_machine(d, "k", "i", STEPS, "G2", 2), lambda d: st.step_machine(d, "k", "i", STEPS, "G2", 2)),
    }


def framed(spark, rows):
    return spark.createDataFrame([(k, i, s, a, step, ok, b) for k, i, s, a, step, ok, b in rows], FIELDS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))


def run(df, at):
    with ks.rocksdb(df.sparkSession):
        df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("name", ["budget", "hits", "steps"])
def test_stream_equals_batch_after_a_restart(spark, tmp_path, name):
    """Three files, then the query ends; two more files, and it starts again from its checkpoint."""
    stream, batch = forms()[name]
    rows, source, at = events(300, 1), str(tmp_path / "in"), str(tmp_path / "out")
    before = spark.conf.get(ks.PROVIDER, None)
    for part in range(5):
        framed(spark, rows[part * 60 : part * 60 + 60]).coalesce(1).write.mode("append").parquet(source)
        if part in (2, 4):
            run(stream(spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(source)), at)
            want = batch(framed(spark, rows[: part * 60 + 60]))
            got = spark.read.parquet(f"{at}/rows")
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.conf.get(ks.PROVIDER, None) == before
    run(stream(spark.readStream.schema(FIELDS).parquet(source)), at)  # nothing new, nothing twice
    assert spark.read.parquet(f"{at}/rows").count() == 300


def test_cache_forgets(spark, tmp_path):
    """What a stream with timers holds is what the batch form holds as of the last event."""
    rnd = random.Random(2)
    rows = [(rnd.randrange(12), s, s + rnd.choice([1, 7, 31, 500, 2000]), i) for i, s in enumerate(sorted(rnd.randrange(1000) for _ in range(120)))]
    source, at = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda part: spark.createDataFrame(part, "cache_key long, ts long, expires_at long, i long").select("cache_key", F.timestamp_seconds("ts").alias("ts"), F.timestamp_seconds("expires_at").alias("expires_at"))
    schema = "cache_key long, ts timestamp, expires_at timestamp"
    for part in range(4):
        make(rows[part * 30 : part * 30 + 30]).coalesce(1).write.mode("append").parquet(source)
        run(ks.cache_changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)), at)
        seen = rows[: part * 30 + 30]
        now = F.timestamp_seconds(F.lit(max(r[1] for r in seen)))
        want = st.cache_state(make(seen), now, 5).select("cache_key", "expires_at")
        assert ks.held(spark.read.parquet(f"{at}/rows"), 5).collect() == want.collect()
    changes = spark.read.parquet(f"{at}/rows")
    assert changes.where("change = 'expired'").count() > 3


def test_queries_equal_their_batch_forms(spark):
    from quarry.plans import analytics

    sf = "/root/testdata/sf0.001"
    for stream, batch in ((plans.stream_first_hits, analytics.first_hit_rate), (plans.stream_steps, analytics.step_machine)):
        got, want = stream(spark, sf), batch(spark, sf)
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns and sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_first_hit_windows_by_hand(spark):
    """The batch form over a table, against a loop."""
    sf, want = "/root/testdata/sf0.001", []
    rows = sorted((r.user_id, r.ts, r.event_id) for r in table(spark, sf, "events").select("user_id", "ts", "event_id").collect())
    now = None
    for user, ts, event in rows:
        if user != now:
            now, start, w, n = user, None, 0, 0
        if start is None or (ts - start).total_seconds() >= 3600:
            start, w, n = ts, w + 1, 0
        n += 1
        want.append((user, event, w, n, n <= 2))
    got = st.first_hit_windows(table(spark, sf, "events"), "user_id", order=["event_id"], limit=2, seconds=3600)
    assert sorted((r.user_id, r.event_id, r.window_no, r.n, r.allowed) for r in got.collect()) == sorted(want)


def test_step_machine_by_hand(spark):
    """The batch form over a table, against a loop."""
    from quarry.plans import analytics

    sf, steps = "/root/testdata/sf0.001", ("G1", "G2", "G3", "G4", "G5", "G6")
    want, done, tries = [], set(), {}
    for r in sorted(table(spark, sf, "events").collect(), key=lambda r: (r.user_id, r.event_id)):
        name = steps[r.event_id % 6]
        at = (r.user_id, name)
        if at in done:
            outcome = "skipped"
        elif r.event_type == "error" and steps.index(name) > 3:
            outcome = "blocked"
        elif tries.get(at, 0) >= 3:
            outcome = "max_retries"
        else:
            outcome = "success" if r.value < 30 else "failed"
        if outcome == "success":
            done.add(at)
        if outcome == "failed":
            tries[at] = tries.get(at, 0) + 1
        want.append((r.user_id, r.event_id, name, outcome))
    assert sorted((r.user_id, r.event_id, r.step, r.outcome) for r in analytics.step_machine(spark, sf).collect()) == sorted(want)
    assert {w[3] for w in want} >= {"success", "failed", "skipped"}


def test_stream_reader(spark, tmp_path):
    framed(spark, events(5, 3)).write.parquet(str(tmp_path / "e"))
    assert ss.read_events(spark, str(tmp_path / "e")).isStreaming
