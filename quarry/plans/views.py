"""How the synthetic tables stand in for the engine's inputs, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MODELS = {"click": "vendor/gpt-4o-mini", "view": "qwen-plus-latest", "signup": "deepseek-chat", "purchase": "o1-mini@2024", "error": "house-model"}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call log from events."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    model = F.lit(None).cast("string")
    for e, m in MODELS.items():
        model = F.when(F.col("event_type") == e, m).otherwise(model)
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", model.alias("model"),
        F.when(F.col("user_id") % 3 == 0, "draft").when(F.col("user_id") % 3 == 1, "review").otherwise("embed").alias("purpose"),
        (k * 10).alias("tokens_in"), k.alias("tokens_out"), F.col("value").alias("latency"),
        F.when(k % 7 == 0, "TIMEOUT").when(k % 11 == 0, "PRICING").alias("blocked"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("fallback"), (k % 4 == 0).alias("cache_hit"),
    )


_K = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"
CALLS = f"""calls AS (SELECT event_id, ts, user_id, CASE event_type {' '.join(f"WHEN '{e}' THEN '{m}'" for e, m in MODELS.items())} END AS model,
 CASE user_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'review' ELSE 'embed' END AS purpose, {_K} * 10 AS tokens_in, {_K} AS tokens_out, value AS latency,
 CASE WHEN {_K} % 7 = 0 THEN 'TIMEOUT' WHEN {_K} % 11 = 0 THEN 'PRICING' END AS blocked, CASE WHEN {_K} % 5 = 0 THEN 1 ELSE 0 END AS fallback, {_K} % 4 = 0 AS cache_hit FROM events)"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a quality score and tags, one for each labelled document."""
    tag = F.when(F.col("toxic") == 1, F.array(F.lit("PRICING_RELATED"), F.lit("X"))).otherwise(F.array(F.lit("X")))
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 60 + F.col("doc_id") % 41).alias("quality"), tag.alias("tags"))


QUALITY = "chunks AS (SELECT doc_id, quality * 60 + doc_id % 41 AS quality, CASE WHEN toxic = 1 THEN ['PRICING_RELATED', 'X'] ELSE ['X'] END AS tags FROM labels)"


def typed(sql: str, types: dict[str, str]) -> str:
    """SQL whose columns have the given types."""
    if not types:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql}) typed"
