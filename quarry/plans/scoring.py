"""Queries for matching, scoring and gating (F) over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import scoring as sc
from quarry.plans.views import table, typed

Q: dict = {}
SQL: dict[str, str] = {}
#: Columns whose type in SQL differs from the query's.
TYPES: dict[str, dict[str, str]] = {"full_review": {"codes": "INTEGER"}}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = typed(sql, TYPES.get(f.__name__, {}))
        return f

    return add


def _lines(spark, d):
    return table(spark, d, "lineitem")


_V1 = """r AS (SELECT o_custkey AS project_id, o_orderkey AS code, CAST(o_totalprice % 10 AS DOUBLE) AS weight FROM orders), s AS (SELECT o_custkey AS project_id, 'k' || CAST(o_orderkey % 3 AS VARCHAR) AS section_key, o_orderkey AS code FROM orders WHERE o_orderkey % 5 <> 0),
 rep AS (SELECT o_custkey AS project_id, 'k' || CAST(o_orderkey % 3 AS VARCHAR) AS section_key, CASE o_orderstatus WHEN 'F' THEN 'PASS' ELSE 'FAIL' END AS status, o_orderkey AS bad, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderkey % 2 = 0),
 j AS (SELECT r.*, s.section_key, rep.status AS rs, rep.bad FROM r LEFT JOIN s ON r.project_id = s.project_id AND r.code = s.code LEFT JOIN rep ON rep.project_id = r.project_id AND rep.section_key = s.section_key AND rep.n = 1),
 g AS (SELECT *, CASE WHEN section_key IS NULL THEN 'UNPLANNED' WHEN rs IS NULL THEN 'UNREVIEWED' WHEN rs = 'PASS' THEN 'PASS' WHEN bad = code THEN 'FAIL' ELSE 'PASS' END AS status FROM j)"""


def _scored(spark, d):
    o = table(spark, d, "orders")
    key = F.concat(F.lit("k"), (F.col("o_orderkey") % 3).cast("string"))
    req = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("code"), (F.col("o_totalprice") % 10).cast("double").alias("weight"), F.lit("").alias("text"))
    sec = o.where("o_orderkey % 5 <> 0").groupBy(F.col("o_custkey").alias("project_id"), key.alias("section_key")).agg(F.collect_list("o_orderkey").alias("codes"), F.lit("").alias("content"), F.max("o_orderdate").alias("created_at"))
    rep = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("project_id"), key.alias("section_key"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("status"), F.array(F.struct(F.col("o_orderkey").cast("string").alias("code"), F.lit("x").alias("description"))).alias("issues"), F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    return sc.simulated_score(req.withColumn("code", F.col("code").cast("string")), sec.withColumn("codes", F.col("codes").cast("array<string>")), rep)


@query(f"WITH {_V1} SELECT project_id, CAST(code AS VARCHAR) AS code, section_key, round(weight, 4) AS weight, status, round(CASE WHEN status = 'PASS' THEN weight ELSE 0 END, 4) AS score FROM g")
def score_v1(spark, d):
    """F1."""
    return _scored(spark, d).select("project_id", "code", "section_key", F.round("weight", 4).alias("weight"), "status", F.round("score", 4).alias("score"))


@query(f"WITH {_V1} SELECT project_id, round(sum(CASE WHEN status = 'PASS' THEN weight ELSE 0 END), 4) AS total, round(sum(weight), 4) AS possible, round(coalesce(sum(CASE WHEN status = 'PASS' THEN weight ELSE 0 END) / nullif(sum(weight), 0), 0) * 100, 2) AS percent FROM g GROUP BY project_id")
def score_v1_totals(spark, d):
    """F1's totals."""
    return sc.score_totals(_scored(spark, d))


def _points(spark, d):
    return _lines(spark, d).select(F.col("l_orderkey").alias("item_id"), F.lit(60.0).alias("max_score"), F.col("l_linenumber").alias("point_id"), F.col("l_quantity").alias("weight"), (F.col("l_discount") * 10).alias("cov"), (F.col("l_tax") * 10).alias("evi"), F.lit(0.5).alias("spec"), (F.col("l_suppkey") % 10 / 10).alias("risk"), (F.col("l_returnflag") == "R").alias("negative_deviation"), (F.col("l_linenumber") == 7).alias("arithmetic_conflict"))


_P = "SELECT l_orderkey AS item_id, l_linenumber AS point_id, l_quantity AS w, greatest(0.0, least(1.0, 0.55 * (l_discount * 10) + 0.25 * (l_tax * 10) + 0.20 * 0.5 - 0.50 * (l_suppkey % 10 / 10))) AS u, l_returnflag = 'R' AS neg, l_linenumber = 7 AS ari FROM lineitem"


@query(f"SELECT item_id, round(least(s, 60), 6) AS score, round(greatest(s - 60, 0), 6) AS clamped, deductions FROM (SELECT item_id, sum(CASE WHEN neg OR ari THEN 0.0 ELSE w * u END) AS s, count(*) FILTER (neg OR ari OR (u <= 0 AND w > 0)) AS deductions FROM ({_P}) GROUP BY item_id) x")
def score_v2(spark, d):
    """F3."""
    return sc.score_items(_points(spark, d))


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity < 3 GROUP BY l_orderkey) SELECT o_orderkey AS l_orderkey, CASE WHEN n IS NOT NULL THEN 'BLOCKED' ELSE 'PASS' END AS status, coalesce(n, 0) AS findings FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""")
def redline(spark, d):
    """F4."""
    p = _lines(spark, d).select("l_orderkey", F.lit("quantity").alias("parameter_name"), F.lit(3.0).alias("required_value"), F.col("l_quantity").alias("provided_value"))
    return sc.redline_status(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), sc.redline(p, "l_orderkey"), "l_orderkey")


@query("""WITH need AS (SELECT c_custkey, x AS document FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) v(x)), have AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) SELECT c_custkey, string_agg(document, ',' ORDER BY document) AS missing FROM need WHERE NOT EXISTS (SELECT 1 FROM have WHERE o_custkey = c_custkey AND o_orderpriority = document) GROUP BY c_custkey""")
def readiness_gap(spark, d):
    """F4's readiness."""
    need = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")])).alias("document"))
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("document"))
    return sc.readiness(need, have, "c_custkey").withColumn("missing", F.array_join("missing", ","))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS span, l_linenumber % 2 AS odd FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT l_orderkey, l_linenumber, 'REVERSED' AS issue FROM s WHERE span < 0 UNION ALL SELECT l_orderkey, l_linenumber, 'MISMATCH' FROM s WHERE span >= 0 AND odd = 1 AND span <> 30 UNION ALL SELECT l_orderkey, l_linenumber, 'OVER_REQUIRED' FROM s WHERE CASE WHEN odd = 1 THEN 30 ELSE span END > 60""")
def duration_check(spark, d):
    """F5."""
    s = _lines(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.struct("l_orderkey", "l_linenumber").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("completion_date"), F.when(F.col("l_linenumber") % 2 == 1, 30).alias("committed_days"), F.lit(60).alias("min_days"))
    return sc.duration_findings(s, "k").select("k.l_orderkey", "k.l_linenumber", "issue")


@query("""WITH need AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS need FROM orders GROUP BY o_custkey), have AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS have FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
 SELECT n.o_custkey AS project_id, len(need) AS codes, round(len(list_intersect(need, coalesce(have, []))) / len(need), 4) AS coverage, round(len(list_intersect(need, coalesce(have, []))) / len(need) * 100, 2) AS score FROM need n LEFT JOIN have h ON n.o_custkey = h.o_custkey""")
def full_review(spark, d):
    """F6."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "project_id")
    r = sc.full_review(o.select("project_id", F.col("o_orderpriority").alias("code")), o.where("o_orderstatus = 'F'").groupBy("project_id").agg(F.collect_list("o_orderpriority").alias("codes")))
    return r.drop("missing")


@query("""SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 OR (doc_id % 50) / 49 < 0.75 THEN 'REWRITE' WHEN doc_id % 3 = 0 OR (doc_id % 50) / 49 < 0.90 THEN 'REVIEW' ELSE 'PASS' END AS tier FROM labels""")
def review_triage(spark, d):
    """F7."""
    r = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "FAIL").otherwise("PASS").alias("status"), F.array_compact(F.array(F.when(F.col("toxic") == 1, "High"), F.when(F.col("doc_id") % 3 == 0, "medium"))).alias("severities"), (F.col("doc_id") % 50 / 49).alias("coverage"))
    return sc.triage(r).select("doc_id", "tier")


@query("""SELECT doc_id, round(greatest(0, least(100, (doc_id % 101) / 100 * 78 + CASE WHEN quality = 1 THEN 22 ELSE 0 END - least(36, (doc_id % 7) * 4 + toxic * 3 + doc_id % 5))), 2) AS score, round(greatest(0, least(100, 100 * (0.4 * (doc_id % 101) / 100 + 0.3 * exp(-0.693 * (doc_id % 900) / 365) + 0.3 * quality))), 2) AS knowledge FROM labels""")
def quality_scores(spark, d):
    """F16, F17."""
    x = table(spark, d, "labels")
    k = F.col("doc_id")
    return x.select("doc_id", sc.compliance_quality(F.when(F.col("quality") == 1, "PASS").otherwise("FAIL"), k % 101 / 100, k % 7, F.col("toxic"), k % 5).alias("score"), sc.knowledge_quality(k % 101 / 100, k % 900, F.col("quality").cast("double")).alias("knowledge"))


@query("""WITH v AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'PASS' WHEN 'view' THEN 'WARN' WHEN 'error' THEN 'FAIL' ELSE 'OTHER' END AS s, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS r, value FROM events),
 c AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, max(r) DESC) AS n FROM v GROUP BY user_id, s), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, r DESC, event_id) AS n FROM v)
 SELECT v.user_id, any_value(c.s) AS status, any_value(b.event_id) AS best FROM v JOIN c ON v.user_id = c.user_id AND c.n = 1 JOIN b ON v.user_id = b.user_id AND b.n = 1 GROUP BY v.user_id""")
def ensemble_vote(spark, d):
    """F15."""
    e = table(spark, d, "events")
    t = F.col("event_type")
    r = e.select("user_id", F.col("event_id").alias("idx"), F.when(t == "click", "PASS").when(t == "view", "WARN").when(t == "error", "FAIL").otherwise("OTHER").alias("status"), F.col("value").alias("quality"), (F.col("value") / 100).alias("coverage"), F.array(t).alias("issues"))
    return sc.vote(r, "user_id").select("user_id", "status", "best")


@query("""WITH b AS (SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 <> 0), a AS (SELECT p_partkey, p_type AS t, row_number() OVER (PARTITION BY p_partkey ORDER BY p_size DESC) AS n FROM part WHERE p_partkey % 2 = 0)
 SELECT CAST(coalesce(b.p_partkey, a.p_partkey) AS VARCHAR) AS clause_code, coalesce(t, p_name) AS clause_text, t IS NOT NULL AS overridden FROM b FULL OUTER JOIN (SELECT * FROM a WHERE n = 1) a ON a.p_partkey = b.p_partkey""")
def addendum_override(spark, d):
    """F11."""
    p = table(spark, d, "part")
    base = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("clause_code"), F.col("p_name").alias("clause_text"))
    add = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("clause_code"), F.col("p_type").alias("clause_text"), F.col("p_size").alias("issued"))
    return sc.override(base, add)


@query("""WITH c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS m, count(*) AS t, max(o_totalprice) AS x FROM orders GROUP BY o_custkey), g AS (SELECT *, CASE WHEN t % 7 = 0 THEN 'missing_evidence_ids' WHEN t % 5 = 0 THEN 'unsupported_sentences' WHEN m / t < 0.5 THEN 'coverage_below_threshold' WHEN x > 200000 AND m < t THEN 'must_clause_coverage_insufficient' END AS reason FROM c)
 SELECT k, CASE WHEN t % 7 = 0 OR t % 5 = 0 THEN 0 ELSE round(m / t, 4) END AS coverage, reason, CASE WHEN reason IS NULL THEN 'SUPPORTED' ELSE 'NEED_HUMAN_INPUT' END AS status FROM g""")
def coverage_gate(spark, d):
    """F12's gates."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("mapped"), F.count("*").alias("total"), (F.max("o_totalprice") > 200000).alias("must"))
    g = sc.gates(c.withColumns({"evidence_count": F.col("total") % 7, "unsupported_count": (F.col("total") % 5 == 0).cast("int")}), 0.5)
    return g.select("k", "coverage", "reason", "status")


@query("""WITH u AS (SELECT DISTINCT l_suppkey % 5 AS p, l_suppkey AS a FROM lineitem WHERE l_quantity > 48), o AS (SELECT s_suppkey % 4 AS p, s_suppkey AS a FROM supplier) SELECT p, a FROM u WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.p = u.p AND o.a = u.a)""")
def asset_isolation(spark, d):
    """F21."""
    used = _lines(spark, d).where("l_quantity > 48").select((F.col("l_suppkey") % 5).alias("p"), F.col("l_suppkey").alias("a"))
    return sc.foreign_assets(used, table(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("p"), F.col("s_suppkey").alias("a")), "p", "a")


@query("""SELECT s_nationkey, round(coalesce(sum(CASE WHEN s_acctbal > 0 THEN s_suppkey % 5 + 1 ELSE 0 END) / sum(s_suppkey % 5 + 1), 0) * 100, 2) AS score, round(coalesce(sum(CASE WHEN s_acctbal > 0 THEN s_suppkey % 5 + 1 ELSE 0 END) / sum(s_suppkey % 5 + 1), 0) * 100, 2) >= 80 AS qualified FROM supplier GROUP BY s_nationkey""")
def profile_score(spark, d):
    """F23."""
    s = table(spark, d, "supplier").select("s_nationkey", (F.col("s_acctbal") > 0).alias("passed"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("weight"))
    return sc.profile_score(s, "s_nationkey")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS needs FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS kind FROM orders WHERE o_orderstatus = 'O'), g AS (SELECT k, string_agg(needs, ',' ORDER BY needs) AS r FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = f.k AND a.kind = f.needs) GROUP BY k)
 SELECT o.k, r IS NOT NULL AS blocked, coalesce(r, '') AS reasons FROM (SELECT DISTINCT o_custkey AS k FROM orders) o LEFT JOIN g ON o.k = g.k""")
def fatal_gate(spark, d):
    """F20."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    g = sc.fatal_gate(o.select("k", F.col("o_orderpriority").alias("needs"), (F.col("o_orderstatus") == "F").alias("fatal")), o.where("o_orderstatus = 'O'").select("k", F.col("o_orderpriority").alias("kind")), "k")
    return g.withColumn("reasons", F.array_join("reasons", ","))


@query()
def team_match(spark, d):
    """F8, F9."""
    s = table(spark, d, "supplier")
    roles = F.array_compact(F.array(F.when(F.col("s_suppkey") % 2 == 0, F.lit("manager")), F.when(F.col("s_suppkey") % 3 == 0, F.lit("engineer")), F.when(F.col("s_suppkey") % 5 == 0, F.lit("safety"))))
    pool = s.select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("asset_id"), roles.alias("roles"), (F.col("s_suppkey") % 12).alias("months"), (F.col("s_suppkey") % 4).alias("active"), (F.col("s_acctbal") / 100).alias("match_score"))
    need = spark.createDataFrame([(0, "manager", 3, True), (1, "engineer", 0, False), (2, "safety", 0, False)], "slot int, role string, min_months int, no_active boolean")
    asked = s.select(F.col("s_nationkey").alias("project_id")).distinct().select("project_id", F.inline(F.array(*[F.struct(F.lit(a).alias("slot"), F.lit(b).alias("role"), F.lit(c).alias("min_months"), F.lit(e).alias("no_active")) for a, b, c, e in need.collect()])))
    return sc.team(sc.candidates(pool, asked), asked)


@query("""SELECT doc_id, CASE WHEN len > cap * 1.5 THEN 'TRUNCATE' WHEN len > cap THEN 'WARN' ELSE 'OK' END AS limit_status FROM (SELECT doc_id, n_chars AS len, CASE lang WHEN 'en' THEN 1500 WHEN 'fr' THEN 3000 ELSE 2000 END AS cap FROM documents) x""")
def token_limits(spark, d):
    """F27."""
    caps = spark.createDataFrame([("en", 1500), ("fr", 3000)], "lang string, cap int")
    return sc.token_limits(table(spark, d, "documents"), caps, "lang", "n_chars").select("doc_id", "limit_status")
