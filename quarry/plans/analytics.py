"""Queries over call logs, quality tables and the star schema (R, G, H), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analytics as an
from quarry.operators import relational as rl
from quarry.operators import state as st
from quarry.plans.views import AS_OF, CALLS, QUALITY, calls, quality, table, typed

Q: dict = {}
SQL: dict[str, str] = {}
#: Columns whose type in SQL differs from the query's.
TYPES: dict[str, dict[str, str]] = {"threshold_recommendation": {"current": "DOUBLE", "suggested": "DOUBLE", "go_live": "DOUBLE"}, "rate_limit_windows": {"n": "INTEGER"}, "routing_order": {"place": "INTEGER"}}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = typed(sql, TYPES.get(f.__name__, {}))
        return f

    return add


_PRICES = "prices(key, price_in, price_out) AS (VALUES " + ", ".join(f"('{k}', {i!r}, {o!r})" for k, i, o in an.PRICES) + ")"
_KEYED = """met AS (SELECT m.model, p.key, CASE WHEN m.model = p.key THEN 2000000 WHEN split_part(m.model, '/', -1) = p.key THEN 1000000
  WHEN (starts_with(m.model, p.key) AND substr(m.model, length(p.key) + 1, 1) IN ('-', ':', '@', '/')) OR (starts_with(split_part(m.model, '/', -1), p.key) AND substr(split_part(m.model, '/', -1), length(p.key) + 1, 1) IN ('-', ':', '@', '/')) THEN length(p.key) END AS score
  FROM (SELECT DISTINCT model FROM calls) m CROSS JOIN prices p),
 keyed AS (SELECT m.model, b.key AS price_key FROM (SELECT DISTINCT model FROM calls) m LEFT JOIN (SELECT model, key FROM (SELECT model, key, row_number() OVER (PARTITION BY model ORDER BY score DESC, key DESC) AS n FROM met WHERE score IS NOT NULL) x WHERE n = 1) b ON m.model = b.model)"""


@query(f"""WITH {CALLS}, {_PRICES}, {_KEYED}, one AS (SELECT c.model, price_key, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
 round(coalesce(sum(tokens_in) / 1e6 * any_value(price_in) + sum(tokens_out) / 1e6 * any_value(price_out), 0), 6) AS cost_usd FROM calls c LEFT JOIN keyed k ON c.model = k.model LEFT JOIN prices p ON k.price_key = p.key GROUP BY c.model, price_key)
 SELECT * FROM one UNION ALL SELECT NULL, NULL, CAST(sum(calls) AS BIGINT), CAST(sum(tokens_in) AS BIGINT), CAST(sum(tokens_out) AS BIGINT), round(sum(cost_usd), 6) FROM one""")
def usage_by_model(spark, d):
    """G1, G11, G12."""
    return an.usage(calls(spark, d), an.prices(spark))


_COMPARE = """SELECT c.model, c.purpose, count(*) AS calls, round(count(*) FILTER (blocked IS NULL) / count(*), 4) AS success_rate, round(count(*) FILTER (fallback > 0) / count(*), 4) AS fallback_rate, round(count(*) FILTER (cache_hit) / count(*), 4) AS cache_hit_rate,
 round(avg(latency), 2) AS avg_latency, round(avg(tokens_in), 2) AS avg_in, round(avg(tokens_out), 2) AS avg_out, round(avg(tokens_in) + avg(tokens_out), 2) AS avg_total,
 round(coalesce(sum(tokens_in) / 1e6 * any_value(price_in) + sum(tokens_out) / 1e6 * any_value(price_out), 0), 6) AS cost_usd, count(*) FILTER (blocked IS NOT NULL) AS failures,
 coalesce(any_value(f.blocked_top), CASE WHEN count(*) FILTER (blocked IS NOT NULL) > 0 AND count(*) FILTER (fallback > 0) > 0 THEN 'FALLBACK_OR_UNKNOWN' END) AS top_failure
 FROM {calls} c LEFT JOIN keyed k ON c.model = k.model LEFT JOIN prices p ON k.price_key = p.key LEFT JOIN (SELECT model, purpose, blocked AS blocked_top FROM (SELECT model, purpose, blocked, row_number() OVER (PARTITION BY model, purpose ORDER BY count(*) DESC, blocked) AS n FROM {calls} WHERE blocked IS NOT NULL GROUP BY model, purpose, blocked) WHERE n = 1) f ON c.model = f.model AND c.purpose = f.purpose
 GROUP BY c.model, c.purpose ORDER BY calls DESC, c.model, c.purpose LIMIT 50"""


@query(f"WITH {CALLS}, {_PRICES}, {_KEYED} " + _COMPARE.format(calls="calls"))
def model_compare(spark, d):
    """G2, G3."""
    return an.compare(calls(spark, d), an.prices(spark))


@query(f"WITH {CALLS} SELECT model, purpose, blocked AS top_failure FROM (SELECT model, purpose, blocked, row_number() OVER (PARTITION BY model, purpose ORDER BY count(*) DESC, blocked) AS n FROM calls WHERE blocked IS NOT NULL GROUP BY model, purpose, blocked) WHERE n = 1")
def top_failure(spark, d):
    """G3."""
    return an.top_failure(calls(spark, d))


@query(f"""WITH {CALLS}, {_PRICES}, {_KEYED}, recent AS (SELECT * FROM calls WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'), a AS ({_COMPARE.format(calls='recent')}), b AS ({_COMPARE.format(calls='calls')})
 SELECT coalesce(a.model, b.model) AS model, coalesce(a.purpose, b.purpose) AS purpose, coalesce(a.calls, 0) AS current_calls, coalesce(b.calls, 0) AS baseline_calls, coalesce(a.success_rate, 0) AS current_success_rate, coalesce(b.success_rate, 0) AS baseline_success_rate, round(coalesce(a.success_rate, 0) - coalesce(b.success_rate, 0), 4) AS delta_success_rate,
 coalesce(a.avg_latency, 0) AS current_avg_latency, coalesce(b.avg_latency, 0) AS baseline_avg_latency, round(coalesce(a.avg_latency, 0) - coalesce(b.avg_latency, 0), 2) AS delta_avg_latency, coalesce(a.cost_usd, 0) AS current_cost_usd, coalesce(b.cost_usd, 0) AS baseline_cost_usd, round(coalesce(a.cost_usd, 0) - coalesce(b.cost_usd, 0), 6) AS delta_cost_usd, a.top_failure AS current_top_failure, b.top_failure AS baseline_top_failure
 FROM a FULL OUTER JOIN b ON a.model = b.model AND a.purpose = b.purpose ORDER BY current_calls DESC, baseline_calls DESC, 1, 2 LIMIT 50""")
def window_compare(spark, d):
    """G4."""
    c, p = calls(spark, d), an.prices(spark)
    return an.window_compare(an.compare(c, p, "2024-01-24 00:00:00"), an.compare(c, p))


@query(f"""WITH {QUALITY} SELECT d.source, count(DISTINCT d.doc_id) AS docs, count(c.quality) AS chunks, round(coalesce(avg(c.quality), 0), 2) AS avg_quality, count(*) FILTER (c.quality < 60) AS low, round(CASE WHEN count(c.quality) > 0 THEN count(*) FILTER (c.quality < 60) / count(c.quality) ELSE 0 END, 4) AS low_rate
 FROM documents d LEFT JOIN chunks c ON d.doc_id = c.doc_id GROUP BY d.source""")
def doc_type_breakdown(spark, d):
    """G5."""
    return an.breakdown(table(spark, d, "documents"), quality(spark, d), "source")


@query(f"WITH {QUALITY} SELECT count(DISTINCT d.doc_id) AS docs, count(c.quality) AS chunks, round(avg(c.quality), 4) AS avg_quality, count(*) FILTER (c.quality < 60) AS low_quality, count(*) FILTER (list_contains(c.tags, 'PRICING_RELATED')) AS tagged FROM documents d LEFT JOIN chunks c ON d.doc_id = c.doc_id")
def quality_summary(spark, d):
    """R2-R5."""
    return rl.quality_totals(table(spark, d, "documents"), quality(spark, d))


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 4) AS ratio FROM events GROUP BY event_type")
def step_ratio(spark, d):
    """G6."""
    return an.step_ratio(table(spark, d, "events"), "event_type")


_SIG = "SELECT k, u FROM (SELECT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, user_id AS u FROM events)"


@query(f"""SELECT count(*) AS n, round(avg(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END), 4) AS pass_rate, round(avg(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END), 4) AS fallback_rate, round(avg(0), 4) AS manual_rate,
 round(avg(CASE WHEN k % 5 = 0 THEN (CASE WHEN u % 2 = 0 THEN 1 ELSE 0 END + 1) / 4 ELSE k / 100 END), 4) AS completeness, round(avg(least(1.0, k / 50)), 4) AS coverage FROM ({_SIG})""")
def quality_signals(spark, d):
    """G7."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    body = F.concat(
        F.lit('{"quality_signals": {"schema_passed": '), (k % 2 == 0).cast("string"), F.lit(', "fallback_triggered": '), (k % 3 == 0).cast("string"), F.lit(', "evidence_coverage": '), (k / 50).cast("string"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "key_field_completeness": '), (k / 100).cast("string"))), F.lit('}, "region": "'), F.when(F.col("user_id") % 2 == 0, "north").otherwise(""), F.lit('", "core_equipment": ["a"]}'),
    )
    return an.quality_signals(table(spark, d, "events").select(body.alias("payload")))


@query("""WITH a AS (SELECT source AS key, round(avg(n_chars), 1) / 1000 AS value FROM documents GROUP BY source), b AS (SELECT source AS key, round(avg(length(text)), 1) / 1000 AS value FROM documents WHERE lang <> 'en' GROUP BY source)
 SELECT * FROM (SELECT coalesce(a.key, b.key) AS key, round_even(coalesce(a.value, 0), 6) AS "from", round_even(coalesce(b.value, 0), 6) AS "to" FROM a FULL OUTER JOIN b ON a.key = b.key) x WHERE "from" <> "to" """)
def threshold_diff(spark, d):
    """A source's mean length over all languages, and over those other than English."""
    docs = table(spark, d, "documents")
    part = lambda df, c: df.groupBy(F.col("source").alias("key")).agg((F.round(F.avg(c), 1) / 1000).alias("value"))
    return an.threshold_diff(part(docs, F.col("n_chars")), part(docs.where("lang <> 'en'"), F.length("text")))


@query(f"""WITH {QUALITY}, s AS (SELECT d.source, count(*) FILTER (c.quality < 60) / count(*) AS low_rate, avg(c.quality) AS avg_quality, count(*) FILTER (c.quality < 5) AS failed FROM documents d JOIN chunks c ON d.doc_id = c.doc_id GROUP BY d.source),
 t AS (SELECT *, CASE WHEN avg_quality < 80 AND low_rate >= 0.10 THEN greatest(400.0, round_even(1200 * 0.9, 0)) WHEN avg_quality >= 90 AND low_rate <= 0.03 THEN least(4000.0, round_even(1200 * 1.1, 0)) ELSE 1200.0 END AS tok FROM s)
 SELECT source, 'low_confidence' AS key, 0.6 AS current, round(CASE WHEN low_rate >= 0.15 THEN 0.65 WHEN low_rate <= 0.05 AND failed = 0 THEN 0.57 ELSE 0.6 END, 4) AS suggested, 0.55 AS go_live FROM t
 UNION ALL SELECT source, 'strong_review_confidence', 0.75, round(CASE WHEN failed > 0 OR low_rate >= 0.12 THEN 0.78 WHEN low_rate <= 0.05 AND failed = 0 THEN 0.73 ELSE 0.75 END, 4), 0.75 FROM t
 UNION ALL SELECT source, 'max_section_pages', 20.0, CASE WHEN failed > 0 THEN 18.0 ELSE 20.0 END, 20.0 FROM t UNION ALL SELECT source, 'max_chunk_tokens', 1200.0, tok, 1200.0 FROM t
 UNION ALL SELECT source, 'chunk_overlap_tokens', 100.0, CASE WHEN low_rate >= 0.10 THEN least(round_even(tok * 0.5, 0), 120.0) ELSE 100.0 END, 100.0 FROM t""")
def threshold_recommendation(spark, d):
    """G9."""
    own = table(spark, d, "documents").join(quality(spark, d), "doc_id").groupBy("source").agg((F.count_if(F.col("quality") < 60) / F.count("*")).alias("low_rate"), F.avg("quality").alias("avg_quality"), F.count_if(F.col("quality") < 5).alias("failed"))
    now = {"low_confidence": 0.6, "strong_review_confidence": 0.75, "max_section_pages": 20.0, "max_chunk_tokens": 1200.0, "chunk_overlap_tokens": 100.0}
    full = own.select("*", *[F.lit(v).alias(k) for k, v in now.items()], F.create_map(F.lit("low_confidence"), F.lit(0.55)).alias("go_live"))
    return full.select("source", F.inline(an.recommendations()))


@query(f"""WITH {QUALITY}, b AS (SELECT d.source AS name, count(DISTINCT d.doc_id) AS docs, count(c.quality) AS chunks, round(coalesce(avg(c.quality), 0), 2) AS avg_quality FROM documents d LEFT JOIN chunks c ON d.doc_id = c.doc_id GROUP BY d.source)
 SELECT 'source' AS dimension, name, 'docs' AS metric, CAST(docs AS DOUBLE) AS value FROM b UNION ALL SELECT 'source', name, 'chunks', CAST(chunks AS DOUBLE) FROM b UNION ALL SELECT 'source', name, 'avg_quality', avg_quality FROM b""")
def long_export(spark, d):
    """G10."""
    return an.to_long(doc_type_breakdown(spark, d), "source", "source", ["docs", "chunks", "avg_quality"])


@query(f"""WITH {CALLS} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, model, count(*) AS n, round(sum(latency), 4) AS seconds, count(*) FILTER (latency <= 1) AS le_1, count(*) FILTER (latency <= 10) AS le_10 FROM calls GROUP BY 1, 2""")
def metric_histogram(spark, d):
    """G14."""
    m = an.metrics(calls(spark, d), ["model"], "latency", every="1 hour", buckets=(1.0, 10.0))
    return m.select(F.col("start").cast("timestamp_ntz").alias("start"), "model", "n", F.round("seconds", 4).alias("seconds"), F.get("le", F.lit(0)).alias("le_1"), F.get("le", F.lit(1)).alias("le_10"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(o AS BIGINT)) AS start, event_type FROM events CROSS JOIN range(0, 6) r(o))
 SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS ratio, count(*) FILTER (event_type = 'error') / count(*) > 0.25 AS alert FROM w GROUP BY start""")
def alert_ratios(spark, d):
    """G15."""
    return an.alert_ratio(table(spark, d, "events"), F.col("event_type") == "error", 0.25, length="6 hours", slide="1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT p_brand AS key, avg(p_size) AS value, 0 AS layer FROM part GROUP BY p_brand), b AS (SELECT p_brand AS key, avg(p_size) AS value, 1 AS layer FROM part WHERE p_size > 40 GROUP BY p_brand), u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE value BETWEEN 0 AND 45.5)
 SELECT key, round(value, 6) AS value, layer FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC) AS n FROM u) x WHERE n = 1""")
def threshold_layers(spark, d):
    """G16."""
    p = table(spark, d, "part")
    avg = lambda df: df.groupBy(F.col("p_brand").alias("key")).agg(F.avg("p_size").alias("value"))
    bounds = p.select(F.col("p_brand").alias("key")).distinct().withColumns({"low": F.lit(0.0), "high": F.lit(45.5)})
    return an.layered([avg(p), avg(p.where("p_size > 40"))], bounds).withColumn("value", F.round("value", 6))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def scoped_join(spark, d):
    """R1."""
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return rl.scoped(c, table(spark, d, "nation"), 1, "BUILDING", "n_nationkey", "n_regionkey", "c_mktsegment").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_orderdate, count(l_linenumber) AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def docs_with_counts(spark, d):
    """R6."""
    return rl.with_counts(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber", "o_orderdate", ["o_orderdate"], 100)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def filtered_list(spark, d):
    """R7-R9, R11, R12, R24."""
    return rl.listing(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], F.col("o_orderstatus") == "F", 5000).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) x WHERE n = 1")
def latest_per_key(spark, d):
    """R10, R16."""
    return rl.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS valid_to FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) > DATE '1997-06-01'")
def in_list_valid(spark, d):
    """R13, R14, R26."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("valid_to"))
    return rl.valid_assets(o, ["1-URGENT", "2-HIGH"], "1997-06-01", "o_orderpriority")


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY o_custkey")
def next_version(spark, d):
    """R16."""
    return rl.next_version(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("""WITH b AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 2 = 0)
 SELECT coalesce(b.p_partkey, c.p_partkey) AS p_partkey, b.p_name, CASE WHEN c.p_partkey IS NOT NULL THEN c.p_size ELSE b.p_size END AS p_size FROM b FULL OUTER JOIN c ON b.p_partkey = c.p_partkey""")
def upsert_merge(spark, d):
    """R17, R18."""
    p = table(spark, d, "part")
    return rl.upsert(p.where("p_partkey % 3 <> 0").select("p_partkey", "p_name", "p_size"), p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size")), ["p_partkey"])


@query("SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'deprecated' ELSE p_brand END AS p_brand FROM part")
def conditional_update(spark, d):
    """R19."""
    ids = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return rl.update_where(table(spark, d, "part").select("p_partkey", "p_brand"), ids, "p_partkey", {"p_brand": F.lit("deprecated")})


@query("SELECT DISTINCT l_partkey AS p_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_insert(spark, d):
    """R23."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_returnflag")
    return rl.insert_missing(li.where("l_returnflag = 'R'"), li, ["p_partkey", "l_suppkey"]).select("p_partkey", "l_suppkey")


@query("""WITH s AS (SELECT o_custkey, unnest(list_distinct(list(o_orderpriority))) AS code FROM orders GROUP BY o_custkey), r(code, weight) AS (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3)) SELECT o_custkey, s.code, weight FROM s JOIN r ON s.code = r.code""")
def array_explode_join(spark, d):
    """R25."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("codes"))
    r = spark.createDataFrame([("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3)], "code string, weight int")
    return rl.by_codes(s, r, "codes", "code").select("o_custkey", "code", "weight")


@query("""WITH a AS (SELECT p_partkey, p_brand, p_size, p_type FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_partkey % 3 <> 0)
 SELECT * FROM (SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, concat_ws(',', CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' END, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END, CASE WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'p_type' END) AS changed FROM a FULL OUTER JOIN b ON a.p_partkey = b.p_partkey) x WHERE changed <> ''""")
def change_set(spark, d):
    """R30."""
    p = table(spark, d, "part")
    new = p.where("p_partkey % 3 <> 0").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("p_type"))
    return rl.changed_fields(p.where("p_partkey % 4 <> 0"), new, "p_partkey", ["p_brand", "p_size", "p_type"]).withColumn("changed", F.array_join("changed", ","))


@query("SELECT event_id, sha256(props) AS prompt_sha256 FROM events")
def call_log_rows(spark, d):
    """R29."""
    return rl.call_log(table(spark, d, "events").select("event_id", "props"), "props")


@query("SELECT s_suppkey, s_name || ' of ' || n_name || ': ' || CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) AS evidence FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def evidence_rows(spark, d):
    """R28."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("bal", F.round("s_acctbal").cast("long"))
    return rl.evidence_row(s, "%s of %s: %s", ["s_name", "n_name", "bal"]).select("s_suppkey", "evidence")


_RATE = "SELECT event_id, user_id, ts, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start FROM events"


@query(f"SELECT event_id, window_start, n, n <= 2 AS allowed, CASE WHEN n <= 2 THEN 0 ELSE greatest(window_start + 3600 - CAST(floor(epoch(ts)) AS BIGINT), 1) END AS retry_after FROM (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS n FROM ({_RATE}))")
def rate_limit_windows(spark, d):
    """H3."""
    return st.rate_limit(table(spark, d, "events"), "user_id", order=["event_id"], limit=2, seconds=3600).select("event_id", "window_start", "n", "allowed", "retry_after")


@query("""WITH e AS (SELECT event_id, user_id % 10 AS u, ts AS t0, ts + to_milliseconds(CAST(value * 60000 AS BIGINT)) AS t1 FROM events), p AS (SELECT u, event_id, t0 AS t, 1 AS d FROM e UNION ALL SELECT u, event_id, t1, -1 FROM e)
 SELECT u, event_id, open, open <= 3 AS within FROM (SELECT *, CAST(sum(d) OVER (PARTITION BY u ORDER BY t, d, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open FROM p) x WHERE d = 1""")
def concurrency(spark, d):
    """H4. An event lasts its value in minutes, to the nearest millisecond: a product just below a whole one is not cut."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 10).alias("u"), "ts", F.expr("ts + make_dt_interval(0, 0, 0, cast(cast(rint(value * 60000) as bigint) as decimal(18,6)) / 1000)").alias("end"))
    return st.concurrency(e, ["u"], "ts", "end", "event_id", 3)


@query("""WITH e AS (SELECT user_id, list(struct_pack(a := CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
 SELECT user_id, len(l) AS requests, list_reduce(list_prepend(CAST(1000 AS BIGINT), list_transform(l, lambda x: x.a)), lambda acc, a: CASE WHEN a <= acc THEN acc - a ELSE acc END) AS remaining FROM e""")
def budget_ledger(spark, d):
    """H1."""
    e = table(spark, d, "events").withColumn("tokens", F.regexp_extract("props", "[0-9]+", 0).cast("long"))
    rows = st.budget(e, "user_id", ["ts", "event_id"], "tokens", F.lit(1000))
    return rows.groupBy("user_id").agg(F.count("*").alias("requests"), F.max_by("remaining", F.struct("ts", "event_id")).alias("remaining"))


@query(f"""WITH {CALLS}, l AS (SELECT model, list(latency ORDER BY ts, event_id) AS v, count(*) FILTER (blocked IS NULL) AS successes FROM calls GROUP BY model)
 SELECT model, len(v) AS attempts, successes, round(list_reduce(v, lambda acc, x: acc * 0.7 + x * 0.3), 6) AS latency FROM l""")
def ewma_routing(spark, d):
    """H8."""
    return st.routing_stats(calls(spark, d).withColumn("ok", F.col("blocked").isNull()), ["model"], ["ts", "event_id"], "ok", "latency").select("model", F.col("attempts").cast("long"), F.col("successes").cast("long"), "latency")


@query(f"""WITH {CALLS}, s AS (SELECT purpose, model, count(*) AS attempts, count(*) FILTER (blocked IS NULL) AS successes, avg(latency) AS latency FROM calls GROUP BY purpose, model), r AS (SELECT *, round(least(1.0, successes / attempts) * 0.85 + (1 - least(1.0, latency / 4000)) * 0.15, 9) AS reward FROM s)
 SELECT purpose, model, round(reward, 6) AS reward, row_number() OVER (PARTITION BY purpose ORDER BY reward DESC, attempts DESC, model) AS place FROM r""")
def routing_order(spark, d):
    """H9."""
    s = calls(spark, d).groupBy("purpose", "model").agg(F.count("*").alias("attempts"), F.count_if(F.col("blocked").isNull()).alias("successes"), F.avg("latency").alias("latency"))
    return st.routing_order(s, "purpose", "model").select("purpose", "model", F.round("reward", 6).alias("reward"), "place")


@query("""WITH l AS (SELECT user_id AS cache_key, ts + to_hours(CAST(event_id % 50 AS BIGINT)) AS expires_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) SELECT cache_key, expires_at FROM l WHERE n = 1 AND expires_at > TIMESTAMP '2024-01-30 00:00:00' ORDER BY expires_at DESC, cache_key LIMIT 100""")
def ttl_cache(spark, d):
    """H7."""
    e = table(spark, d, "events").select(F.col("user_id").alias("cache_key"), "ts", F.expr("ts + make_dt_interval(0, cast(event_id % 50 as int), 0, 0)").alias("expires_at"))
    return st.cache_state(e, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 100).select("cache_key", "expires_at")


@query("SELECT user_id, max_by(event_type, ts) AS event_type, count(*) FILTER (event_type = 'RETRY') AS retries FROM events GROUP BY user_id")
def latest_status(spark, d):
    """H6, H16."""
    return st.latest_status(table(spark, d, "events"), ["user_id"], "ts", "event_type")


@query("SELECT event_id, greatest(1, length(props) // 4) AS tokens, greatest(0, 100 - CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS budget_left FROM events")
def token_estimate(spark, d):
    """H2, H15."""
    return table(spark, d, "events").select("event_id", st.estimate_tokens(F.col("props")).alias("tokens"), st.budget_left(F.lit(100).cast("long"), F.regexp_extract("props", "[0-9]+", 0).cast("long")).alias("budget_left"))


@query()
def step_machine(spark, d):
    """H5."""
    steps = ("G1", "G2", "G3", "G4", "G5", "G6")
    e = table(spark, d, "events").select("user_id", "event_id", F.element_at(F.array(*[F.lit(s) for s in steps]), (F.col("event_id") % 6 + 1).cast("int")).alias("step"), (F.col("value") < 30).alias("ok"), (F.col("event_type") == "error").alias("blocked"))
    return st.step_machine(e, "user_id", "event_id", steps, "G4")


@query()
def first_hit_rate(spark, d):
    """H3, windows from the first hit."""
    return st.first_hit_windows(table(spark, d, "events"), "user_id", order=["event_id"], limit=2, seconds=3600)


@query(f"""SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AND o_orderstatus = 'O'""")
def null_tolerant_filter(spark, d):
    """R20."""
    o = table(spark, d, "orders").withColumn("expires", F.col("o_orderdate").cast("date"))
    return rl.not_expired(o, "1998-01-01", status="o_orderstatus", active="O").select("o_orderkey", "o_orderdate")
