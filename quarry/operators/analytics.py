"""Operational analytics (G1-G16) over call logs and quality tables.

A call log has model, purpose, tokens_in, tokens_out, latency, blocked (reason or null), fallback (count), cache_hit, ts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.relational import clamp

#: Yuan per dollar.
CNY = 7.2
# Prices in dollars per million tokens (model, in, out).
PRICES = (
    ("gpt-4o", 5.00, 15.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("o1-preview", 15.00, 60.00),
    ("o1-mini", 3.00, 12.00),
    ("deepseek-chat", 0.28, 1.12),
    ("deepseek-reasoner", 0.28, 1.12),
    ("qwen-turbo", 0.28, 0.28),
    ("qwen-plus", 0.56, 1.68),
    ("qwen-max", 2.80, 8.40),
    ("qwen3", 0.56, 1.68),
    ("qwen3.5", 0.56, 1.68),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00),
    ("claude-3-5-haiku-20241022", 1.00, 5.00),
)


def prices(spark: SparkSession, rows: Sequence[tuple] = PRICES) -> DataFrame:
    """The price table: key, price_in, price_out, currency. It is a parameter of some dozens of rows, so it is broadcast."""
    return spark.createDataFrame([(*r, "USD")[:4] for r in rows], "key string, price_in double, price_out double, currency string")


def price_keys(models: DataFrame, table: DataFrame, model: str = "model") -> DataFrame:
    """Model and key: the model's name, else its last path segment, else the longest key that either starts with and that - : @ or / follows; null if none.

    A name gives the few texts that its key may be: itself, its last segment and what stands before each separator; these and the keys meet in a hash join.
    """
    name = F.lower(F.trim(F.col(model)))
    own = models.select(model).distinct().withColumns({"__name": name, "__alias": F.element_at(F.split(name, "/"), -1)})
    whole = lambda c, score: F.struct(F.col(c).alias("key"), F.lit(score).alias("score"))

    def before(c: str) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i, F.lit(1)).isin("-", ":", "@", "/"))
        return F.when(F.length(c) > 0, F.transform(at, lambda i: F.struct(F.substr(c, F.lit(1), i - 1).alias("key"), (i - 1).alias("score"))))

    none = F.array().cast("array<struct<key:string,score:int>>")
    may = F.concat(F.array(whole("__name", 2_000_000), whole("__alias", 1_000_000)), F.coalesce(before("__name"), none), F.coalesce(before("__alias"), none))
    asked = own.where("__name <> ''").select(model, F.inline(may))
    met = asked.join(table.select("key").distinct(), "key").groupBy(model).agg(F.max_by("key", F.struct("score", "key")).alias("key"))
    return own.select(model).join(met.withColumnRenamed(model, "__m"), F.col(model).eqNullSafe(F.col("__m")), "left").drop("__m")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of the tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def usage(calls: DataFrame, table: DataFrame, total: bool = True) -> DataFrame:
    """G1: calls, tokens and cost in dollars by model, with a row of model null for the total."""
    per = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    keyed = per.join(price_keys(per, table).withColumnRenamed("key", "price_key"), "model", "left").join(table, F.col("price_key") == F.col("key"), "left")
    raw = F.coalesce(cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")), F.lit(0.0))
    out = keyed.select("model", "price_key", "calls", "tokens_in", "tokens_out", F.round(F.when(F.col("currency") == "CNY", raw / CNY).otherwise(raw), 6).alias("cost_usd"))
    if total:
        out = out.unionByName(out.agg(F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("price_key"), F.sum("calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")))
    return out


def top_failure(calls: DataFrame, keys: Sequence[str] = ("model", "purpose")) -> DataFrame:
    """Each group's most frequent reason for blocking; ties go to the smaller reason."""
    counts = calls.where("blocked is not null").groupBy(*keys, "blocked").count()
    return counts.groupBy(*keys).agg(F.min_by("blocked", F.struct(-F.col("count"), F.col("blocked"))).alias("top_failure"))


def compare(calls: DataFrame, table: DataFrame, since: str | None = None, keys: Sequence[str] = ("model", "purpose"), limit: int = 50) -> DataFrame:
    """Rates, means and cost by group, for calls from since on; the most frequent groups first."""
    own = calls if since is None else calls.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    mean = lambda c: F.round(F.avg(c), 2)
    agg = own.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        rate(F.col("blocked").isNull()).alias("success_rate"),
        rate(F.col("fallback") > 0).alias("fallback_rate"),
        rate(F.col("cache_hit")).alias("cache_hit_rate"),
        mean("latency").alias("avg_latency"),
        mean("tokens_in").alias("avg_in"),
        mean("tokens_out").alias("avg_out"),
        F.round(F.avg("tokens_in") + F.avg("tokens_out"), 2).alias("avg_total"),
        F.sum("tokens_in").alias("sum_in"),
        F.sum("tokens_out").alias("sum_out"),
        F.count_if(F.col("blocked").isNotNull()).alias("failures"),
        F.count_if(F.col("fallback") > 0).alias("__fallbacks"),
    )
    priced = agg.join(price_keys(agg, table).withColumnRenamed("key", "__key"), "model", "left").join(table, F.col("__key") == F.col("key"), "left")
    both = priced.join(top_failure(own, keys), list(keys), "left")
    top = F.coalesce("top_failure", F.when((F.col("failures") > 0) & (F.col("__fallbacks") > 0), "FALLBACK_OR_UNKNOWN"))
    money = F.round(F.coalesce(cost(F.col("sum_in"), F.col("sum_out"), F.col("price_in"), F.col("price_out")) / F.when(F.col("currency") == "CNY", CNY).otherwise(1.0), F.lit(0.0)), 6)
    out = both.select(*keys, "calls", "success_rate", "fallback_rate", "cache_hit_rate", "avg_latency", "avg_in", "avg_out", "avg_total", money.alias("cost_usd"), "failures", top.alias("top_failure"))
    return out.orderBy(F.desc("calls"), *keys).limit(clamp(limit, 200))


def window_compare(current: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("model", "purpose"), limit: int = 50) -> DataFrame:
    """Two results of compare side by side, with differences; a group absent from one side has zeros there."""
    a, b = current.alias("c"), baseline.alias("b")
    on = [F.col(f"c.{k}") == F.col(f"b.{k}") for k in keys]
    value = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.lit(0)).cast("long" if f == "calls" else "double")
    out = [F.coalesce(f"c.{k}", f"b.{k}").alias(k) for k in keys] + [value("c", "calls").alias("current_calls"), value("b", "calls").alias("baseline_calls")]
    for f, places in (("success_rate", 4), ("avg_latency", 2), ("cost_usd", 6)):
        out += [value("c", f).alias(f"current_{f}"), value("b", f).alias(f"baseline_{f}"), F.round(value("c", f) - value("b", f), places).alias(f"delta_{f}")]
    out += [F.col("c.top_failure").alias("current_top_failure"), F.col("b.top_failure").alias("baseline_top_failure")]
    return a.join(b, on, "full_outer").select(*out).orderBy(F.desc("current_calls"), F.desc("baseline_calls"), *keys).limit(clamp(limit, 200))


def breakdown(docs: DataFrame, chunks: DataFrame, by: str, key: str = "doc_id", quality: str = "quality", low: float = 60.0) -> DataFrame:
    """By kind of document: distinct documents, chunks, mean quality, low ones and their rate."""
    q = F.col(quality).cast("double")
    low_n = F.count_if(q < low)
    return docs.select(key, by).join(chunks.select(key, quality), key, "left").groupBy(by).agg(F.countDistinct(key).alias("docs"), F.count(quality).alias("chunks"), F.round(F.coalesce(F.avg(q), F.lit(0.0)), 2).alias("avg_quality"), low_n.alias("low"), F.round(F.when(F.count(quality) > 0, low_n / F.count(quality)).otherwise(0.0), 4).alias("low_rate"))


def step_ratio(df: DataFrame, step: str) -> DataFrame:
    """Count of each step and its share of all."""
    return df.groupBy(step).agg(F.count("*").alias("n")).withColumn("ratio", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def quality_signals(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rates and means of the JSON quality signals; completeness falls back to how many of four fields are filled."""
    p = F.from_json(payload, "quality_signals struct<schema_passed:boolean,key_field_completeness:double,fallback_triggered:boolean,manual_review_required:boolean,evidence_coverage:double>, voltage_level_kv string, project_type string, region string, core_equipment array<string>")
    filled = sum(((F.coalesce(F.col(f"p.{f}"), F.lit("")) != "").cast("int") for f in ("voltage_level_kv", "project_type", "region")), F.lit(0)) + (F.coalesce(F.size("p.core_equipment"), F.lit(0)) > 0).cast("int")
    s = "p.quality_signals"
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    rate = lambda f: F.round(F.avg(F.coalesce(F.col(f"{s}.{f}"), F.lit(False)).cast("int")), 4)
    return df.select(p.alias("p")).agg(
        F.count("*").alias("n"), rate("schema_passed").alias("pass_rate"), rate("fallback_triggered").alias("fallback_rate"), rate("manual_review_required").alias("manual_rate"),
        F.round(F.avg(unit(F.coalesce(F.col(f"{s}.key_field_completeness"), filled / 4.0))), 4).alias("completeness"), F.round(F.avg(unit(F.col(f"{s}.evidence_coverage"))), 4).alias("coverage"),
    )


def threshold_diff(before: DataFrame, after: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Keys of either side whose values (absent: 0) differ at six places."""
    a, b = before.select(key, F.col(value).alias("x")), after.select(key, F.col(value).alias("y"))
    old, new = (F.bround(F.coalesce(c, F.lit(0.0)), 6) for c in ("x", "y"))
    return a.join(b, key, "full_outer").select(key, old.alias("from"), new.alias("to")).where(F.col("from") != F.col("to"))


def recommendations() -> Column:
    """An array of five (key, current, suggested, go_live) for a row of current thresholds and quality; see recommend().

    The row has low_confidence, strong_review_confidence, max_section_pages, max_chunk_tokens, chunk_overlap_tokens, low_rate, failed,
    avg_quality and go_live (a map). The rates at which a threshold moves, its step and its bounds are the rules' fixed values.
    """
    c, rate = F.col, F.col("low_rate")
    calm = (rate <= 0.05) & (c("failed") == 0)
    within = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    low = F.when(rate >= 0.15, within(c("low_confidence") + 0.05, 0.40, 0.90)).when(calm, within(c("low_confidence") - 0.03, 0.40, 0.90)).otherwise(c("low_confidence"))
    strong = F.when((c("failed") > 0) | (rate >= 0.12), within(c("strong_review_confidence") + 0.03, 0.60, 0.95)).when(calm, within(c("strong_review_confidence") - 0.02, 0.60, 0.95)).otherwise(c("strong_review_confidence"))
    pages = F.when(c("failed") > 0, F.greatest(F.lit(8.0), c("max_section_pages") - 2)).otherwise(c("max_section_pages"))
    tokens = F.when((c("avg_quality") < 80) & (rate >= 0.10), F.greatest(F.lit(400.0), F.bround(c("max_chunk_tokens") * 0.9, 0))).when((c("avg_quality") >= 90) & (rate <= 0.03), F.least(F.lit(4000.0), F.bround(c("max_chunk_tokens") * 1.1, 0))).otherwise(c("max_chunk_tokens"))
    overlap = F.when(rate >= 0.10, F.least(F.bround(tokens * 0.5, 0), F.greatest(c("chunk_overlap_tokens"), F.bround(c("chunk_overlap_tokens") + 20, 0)))).otherwise(c("chunk_overlap_tokens"))
    found = {"low_confidence": low, "strong_review_confidence": strong, "max_section_pages": pages, "max_chunk_tokens": tokens, "chunk_overlap_tokens": overlap}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.round(c(k).cast("double"), 4).alias("current"), F.round(v.cast("double"), 4).alias("suggested"), F.round(F.coalesce(F.element_at("go_live", k), c(k)).cast("double"), 4).alias("go_live")) for k, v in found.items()])
    return rows


def recommend(df: DataFrame) -> DataFrame:
    """Five rows for each row of df."""
    return df.select(F.inline(recommendations()))


def to_long(df: DataFrame, dimension: str, name: str, metrics: Sequence[str]) -> DataFrame:
    """(dimension, name, metric, value) rows of a wide result."""
    own = df.select(F.lit(dimension).alias("dimension"), F.col(name).cast("string").alias("name"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return own.unpivot(["dimension", "name"], list(metrics), "metric", "value")


def enhancement_cost(n: Column, low: float = 0.10, high: float = 0.35, embedding: float = 0.01) -> Column:
    """The band of dollars to enrich n documents."""
    return F.struct(F.round(n * low, 2).alias("low"), F.round(n * high, 2).alias("high"), F.round(n * embedding, 2).alias("embedding"))


def metrics(df: DataFrame, labels: Sequence[str], seconds: str, ts: str = "ts", every: str = "5 minutes", buckets: Sequence[float] = (0.1, 0.5, 1, 5, 10)) -> DataFrame:
    """Counts and a cumulative histogram of durations by window and labels."""
    cells = F.array(*[F.count_if(F.col(seconds) <= b) for b in buckets], F.count("*"))
    return df.groupBy(F.window(ts, every).alias("w"), *labels).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"), cells.alias("le")).select(F.col("w.start").alias("start"), *labels, "n", "seconds", "le")


def alert_ratio(df: DataFrame, bad: Column, most: float, ts: str = "ts", length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding windows, their share of bad rows and whether it is over `most`."""
    out = df.groupBy(F.window(ts, length, slide).alias("w")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return out.select(F.col("w.start").alias("start"), "n", "bad", F.round(F.col("bad") / F.col("n"), 4).alias("ratio"), (F.col("bad") / F.col("n") > most).alias("alert"))


def layered(layers: Sequence[DataFrame], bounds: DataFrame | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """The last layer that has a key wins; with bounds (key, low, high), values outside are left to the layer below."""
    out = None
    for i, layer in enumerate(layers):
        own = layer.select(key, F.col(value).cast("double").alias("value"), F.lit(i).alias("layer"))
        if bounds is not None:
            own = own.join(bounds, key, "left").where("low is null or value between low and high").select(key, "value", "layer")
        out = own if out is None else out.unionByName(own)
    return out.where("value is not null").groupBy(key).agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))
