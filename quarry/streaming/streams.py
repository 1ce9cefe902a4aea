"""Structured Streaming forms of the batch operators (H3, H8, G14, G15) and extensions that the reference has no form of:
session windows, and dedup within a watermark. Each takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """A folder's files as a stream of events; ts becomes a timestamp so that it can carry a watermark."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(df: DataFrame, *labels: str, ts: str = "ts", length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and labels."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *labels, "n")


def alert_ratio(df: DataFrame, bad: Column, most: float, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """The share of bad events in sliding windows, and whether it is over `most`."""
    out = df.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.select(F.col("w.start").alias("start"), "n", "bad", F.round(F.col("bad") / F.col("n"), 4).alias("ratio"), (F.col("bad") / F.col("n") > most).alias("alert"))


def rate_counts(df: DataFrame, key: str, limit: int, ts: str = "ts", seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """H3: requests of each aligned window, and how many are over the limit."""
    out = df.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))


def sessions(df: DataFrame, key: str, gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Extension: sessions that end after a gap."""
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(df: DataFrame, *keys: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Extension: each key once within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def routing_stats(df: DataFrame, key: str, order: str, success: str, latency: str, keep: float = 0.7) -> DataFrame:
    """H8: (key, attempts, successes, latency) after each batch, from state that lasts; within a batch, in the given order."""
    kind = dict(df.dtypes)[key]
    kind = {"bigint": "long"}.get(kind, kind)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ok, ewma = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        for s, x in zip(rows[success], rows[latency], strict=True):
            x = max(0.0, float(x))
            ewma = x if n == 0 else ewma * keep + x * (1 - keep)
            n, ok = n + 1, ok + int(s)
        state.update((n, ok, ewma))
        yield pd.DataFrame({key: [k[0]], "attempts": [n], "successes": [ok], "latency": [round(ewma, 6)]})

    return df.select(key, order, success, latency).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, attempts long, successes long, latency double", "n long, ok long, ewma double", "update", GroupStateTimeout.NoTimeout)
