"""Queries that run the streaming operators to the end of a folder of events and return what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_folder
from quarry.streaming import keyed as ks
from quarry.streaming import streams as ss

Q: dict = {}
SQL: dict[str, str] = {}


def finish(df: DataFrame, mode: str) -> DataFrame:
    """Runs a streaming plan over all input there is; the result is a table in the shared folder, written anew by each batch (mode complete) or added to."""
    at = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")
    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14, streaming."""
    out = finish(ss.counts(ss.read_events(spark, sf_dir, "events.parquet"), "event_type", length="1 hour"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, streaming."""
    out = finish(ss.rate_counts(ss.read_events(spark, sf_dir, "events.parquet"), "user_id", 2, seconds=3600), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of each user, with a gap of six hours."""
    out = finish(ss.sessions(ss.read_events(spark, sf_dir, "events.parquet"), "user_id", "6 hours"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15, streaming: what alert_ratios gives."""
    out = finish(ss.alert_ratio(ss.read_events(spark, sf_dir, "events.parquet"), F.col("event_type") == "error", 0.25, length="6 hours", slide="1 hour"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8, streaming: each event type's figures after the last batch."""
    e = ss.read_events(spark, sf_dir, "events.parquet").withColumn("ok", F.col("event_type") != "error")
    out = finish(ss.routing_stats(e.select("event_type", "event_id", "ok", "value"), "event_type", "event_id", "ok", "value"), "update")
    return out.groupBy("event_type").agg(F.max("attempts").alias("attempts"), F.max_by("successes", "attempts").alias("successes"), F.max_by("latency", "attempts").alias("latency"))


def _settled(df: DataFrame) -> DataFrame:
    """Runs a keyed stream over all input there is, into files that a batch adds once however often it is run."""
    at = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    with ks.rocksdb(df.sparkSession):
        df.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/rows")


def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, R22, as a keyed stream: what budget_ledger gives."""
    e = ss.read_events(spark, sf_dir, "events.parquet").withColumn("tokens", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    rows = _settled(ks.budget(e, "user_id", ["ts", "event_id"], "tokens", F.lit(1000)))
    return rows.groupBy("user_id").agg(F.count("*").alias("requests"), F.max_by("remaining", F.struct("ts", "event_id")).alias("remaining"))


def stream_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 from the first hit, as a keyed stream: what first_hit_rate gives."""
    rows = _settled(ks.first_hit_windows(ss.read_events(spark, sf_dir, "events.parquet"), "user_id", order=["event_id"], limit=2, seconds=3600))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, R22, as a keyed stream: what step_machine gives."""
    steps = ("G1", "G2", "G3", "G4", "G5", "G6")
    e = ss.read_events(spark, sf_dir, "events.parquet")
    own = e.select("user_id", "event_id", F.element_at(F.array(*[F.lit(s) for s in steps]), (F.col("event_id") % 6 + 1).cast("int")).alias("step"), (F.col("value") < 30).alias("ok"), (F.col("event_type") == "error").alias("blocked"))
    return _settled(ks.step_machine(own, "user_id", "event_id", steps, "G4"))


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7, as a keyed stream with timers: the entries that are held when all events are read, as of the last of them."""
    e = ss.read_events(spark, sf_dir, "events.parquet").select(F.col("user_id").alias("cache_key"), "ts", F.expr("ts + make_dt_interval(0, cast(event_id % 50 as int), 0, 0)").alias("expires_at"))
    return ks.held(_settled(ks.cache_changes(e)), 1_000_000).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


Q = {f.__name__: f for f in (stream_counts, stream_rates, stream_sessions, stream_alerts, stream_routing, stream_budget, stream_first_hits, stream_steps, stream_cache)}
SQL = {
    "stream_counts": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_rates": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, user_id, count(*) AS n, greatest(count(*) - 2, 0) AS over FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, s.n""",
    "stream_alerts": """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(o AS BIGINT)) AS start, event_type FROM events CROSS JOIN range(0, 6) r(o))
 SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS ratio, count(*) FILTER (event_type = 'error') / count(*) > 0.25 AS alert FROM w GROUP BY start""",
    "stream_routing": """WITH l AS (SELECT event_type, list(greatest(value, 0.0) ORDER BY event_id) AS v, count(*) FILTER (event_type <> 'error') AS successes FROM events GROUP BY event_type)
 SELECT event_type, len(v) AS attempts, successes, round(list_reduce(v, lambda acc, x: acc * 0.7 + x * 0.3), 6) AS latency FROM l""",
    "stream_budget": """WITH e AS (SELECT user_id, list(struct_pack(a := CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
 SELECT user_id, len(l) AS requests, list_reduce(list_prepend(CAST(1000 AS BIGINT), list_transform(l, lambda x: x.a)), lambda acc, a: CASE WHEN a <= acc THEN acc - a ELSE acc END) AS remaining FROM e""",
    "stream_cache": """WITH l AS (SELECT user_id AS cache_key, ts, ts + to_hours(CAST(event_id % 50 AS BIGINT)) AS expires_at FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, expires_at DESC) AS n FROM l)
 SELECT cache_key, expires_at FROM n WHERE n = 1 AND expires_at > (SELECT max(ts) FROM events)""",
}
