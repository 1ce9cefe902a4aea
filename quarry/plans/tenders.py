"""Queries for the domain's rules (B, C, D, E, F, S) over tender texts composed from the part table, so that the rules find something and the
right result is plain SQL over the numbers they were composed from."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import extract as ex
from quarry.operators import guard as gd
from quarry.operators import relational as rl
from quarry.operators import retrieval as rt
from quarry.operators import scoring as sc
from quarry.operators import state as st
from quarry.operators import structure as sx
from quarry.plans.views import table, typed
from quarry.sources import readers as rd
from quarry.sources import sinks as sk

Q: dict = {}
SQL: dict[str, str] = {}
#: Columns whose type in SQL differs from the query's.
TYPES: dict[str, dict[str, str]] = {"tender_sentences": {"n": "BIGINT"}, "tender_review": {"quotes": "INTEGER", "review_confidence": "DOUBLE"}, "blueprint": {"task_no": "INTEGER"}, "form_chunks": {"quality": "DOUBLE"}}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = typed(sql, TYPES.get(f.__name__, {}))
        return f

    return add


#: k: the part's key; s: its size (1 to 50). Lines of a text, in order; a line with a condition is there only where it holds.
LINES = (
    (None, "第{a}章 投标要求"),
    ("e", "投标人必须具备承装修试资质，详见第三章"),
    ("o", "建议优先考虑类似工程业绩"),
    (None, "技术评分分值{s}分"),
    ("t", "未按要求密封的按废标处理"),
    (None, "项目经理须具备一级建造师资格，社保{m}个月，{s}年以上工作经验"),
    (None, "工期：{s}天"),
    (None, "电压等级{v}kV的变电站施工业绩要求"),
)
_WHERE = {"e": "p_partkey % 2 = 0", "o": "p_partkey % 2 = 1", "t": "p_partkey % 3 = 0"}
_HOLES = {"a": "p_size % 9 + 1", "s": "p_size", "m": "p_size % 12 + 1", "v": "CASE WHEN p_partkey % 5 = 0 THEN 15 ELSE 110 END"}


def _line(line: str) -> str:
    for k, v in _HOLES.items():
        line = line.replace("{" + k + "}", f"' || CAST({v} AS {{string}}) || '")
    return f"'{line}'"


_TEXT = "concat_ws('\n', " + ", ".join(_line(t) if w is None else f"CASE WHEN {_WHERE[w]} THEN {_line(t)} END" for w, t in LINES) + ")"


def tenders(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", F.expr(_TEXT.replace("{string}", "STRING")).alias("text"))


def said(spark, d):
    return ex.sentences(tenders(spark, d), "p_partkey")


@query("SELECT p_partkey, 5 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS n, '第' || CAST(p_size % 9 + 1 AS VARCHAR) || '章 投标要求' AS anchor FROM part")
def tender_sentences(spark, d):
    """D2's split and carry: lines of at least seven characters (the deadline has fewer)."""
    s = ex.sentences(tenders(spark, d), "p_partkey", least=7)
    return s.groupBy("p_partkey").agg((F.count("*")).alias("n"), F.max("anchor").alias("anchor"))


@query("SELECT p_partkey, 'SCR-001' AS item_id, 'technical' AS category, CAST(p_size AS DOUBLE) AS max_score, round(p_size / 100, 6) AS weight FROM part")
def scoring_items(spark, d):
    """D8."""
    return ex.scoring_items(said(spark, d), "p_partkey").select("p_partkey", "item_id", "category", "max_score", F.round("weight", 6).alias("weight"))


@query("SELECT p_partkey, count(*) AS n, count(*) FILTER (fatal) AS fatal FROM (SELECT p_partkey, false AS fatal FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, true FROM part WHERE p_partkey % 3 = 0) x GROUP BY p_partkey")
def preliminary_items(spark, d):
    """D9."""
    return ex.preliminary_items(said(spark, d), "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n"), F.count_if("fatal_if_unmet").alias("fatal"))


@query("SELECT p_partkey, 'detailed' AS check_type, 'ADVISORY' AS risk_note FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'preliminary', 'DISQUALIFY' FROM part WHERE p_partkey % 3 = 0")
def compliance_items(spark, d):
    """D11, D1."""
    return ex.compliance_items(said(spark, d), "p_partkey").select("p_partkey", "check_type", "risk_note")


@query("SELECT p_partkey, '项目经理' AS role, '一级建造师' AS cert_required, false AS no_active_project, p_size % 12 + 1 AS social_security_months, p_size AS min_experience_years FROM part")
def key_personnel(spark, d):
    """D12."""
    return ex.key_personnel(said(spark, d), "p_partkey").drop("source_clause")


@query("SELECT p_partkey, 'total_duration_days' AS field, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'voltage_level', CASE WHEN p_partkey % 5 = 0 THEN '15kV' ELSE '110kV' END FROM part")
def global_facts(spark, d):
    """D14, D15."""
    return ex.facts(tenders(spark, d), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 15 ELSE 110 END AS voltage_level_kv, standard_code FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'GB5015' || CAST(p_size % 10 AS VARCHAR) END AS standard_code FROM part) x")
def tender_metadata(spark, d):
    """B27, B29."""
    t = tenders(spark, d).withColumn("text", F.concat(F.when(F.col("p_size") > 25, F.concat(F.lit("GB 5015"), (F.col("p_size") % 10).cast("string"), F.lit("\n"))).otherwise(""), F.col("text")))
    return sx.standards(sx.metadata(t)).select("p_partkey", "voltage_level_kv", "standard_code")


@query("SELECT p_partkey, '进度计划' AS section_type FROM part")
def tender_labels(spark, d):
    """The deadline line comes before all other rules that match."""
    return sx.labels(tenders(spark, d).withColumn("title", F.lit("")), "title", "text").select("p_partkey", "section_type")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'high' WHEN p_partkey % 2 = 0 THEN 'medium' ELSE 'low' END AS risk_level FROM part")
def tender_risk(spark, d):
    """B11."""
    return sx.labels(tenders(spark, d).withColumn("title", F.lit("")), "title", "text").select("p_partkey", "risk_level")


@query("SELECT p_partkey, len(q) AS quotes, round(0.7 + 0.08, 4) AS review_confidence FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN [1, 2, 3] ELSE [1, 2] END AS q FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0) x UNION ALL SELECT p_partkey, 1, 0.78 FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 <> 0")
def tender_review(spark, d):
    """B16."""
    own = sx.labels(tenders(spark, d).withColumn("title", F.lit("")), "title", "text").withColumn("confidence", F.lit(0.7))
    return sx.risk_review(own, "text").select("p_partkey", F.size("quotes").alias("quotes"), "review_confidence")


@query("SELECT p_partkey, 'POWER_VOLTAGE_PERF' AS pattern_id FROM part UNION ALL SELECT p_partkey, 'POWER_SUBSTATION' FROM part UNION ALL SELECT p_partkey, 'PERSON_CONSTRUCTOR' FROM part UNION ALL SELECT p_partkey, 'PERF_SIMILAR_PROJECT' FROM part WHERE p_partkey % 2 = 1")
def tender_risk_scan(spark, d):
    """D17."""
    return ex.risk_scan(tenders(spark, d), "p_partkey").select("p_partkey", "pattern_id")


@query("SELECT p_partkey, 'DQ-001' AS condition_id, 'DISQUALIFY' AS strength, 'FORMAT' AS category FROM part WHERE p_partkey % 3 = 0")
def tender_conditions(spark, d):
    """D22."""
    return ex.conditions(tenders(spark, d), "p_partkey", "p_size", "text").drop("content")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS refs FROM part")
def cross_references(spark, d):
    """D7."""
    return tenders(spark, d).select("p_partkey", F.size(ex.cross_references(F.col("text"))).alias("refs"))


@query("SELECT p_partkey, 'S-001' AS section_id, 2 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS codes FROM part")
def outline(spark, d):
    """D27 over D2: a must or bonus line, the score and the condition, all under one heading."""
    r = ex.requirements(said(spark, d), "p_partkey", must=("必须",))
    return ex.outline(r, "p_partkey").select("p_partkey", "section_id", F.size("codes").alias("codes"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '110.0' END AS above FROM part")
def above_fact(spark, d):
    """D28."""
    return tenders(spark, d).select("p_partkey", F.array_join(F.transform(ex.above_fact(F.col("text"), F.lit(66.0)), lambda x: x.cast("string")), ",").alias("above"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'critical' ELSE 'default' END AS plan FROM part")
def section_route(spark, d):
    """D25, by weight."""
    r = ex.section_route(table(spark, d, "part").select("p_partkey", F.lit("x").alias("title"), (F.col("p_size") > 40).cast("double").alias("w")), "title", "w", ("报价",))
    return r.select("p_partkey", F.when(F.col("critical"), "critical").otherwise("default").alias("plan"))


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'MODEL' WHEN p_size > 10 THEN 'RULES' ELSE 'NEED_HUMAN_INPUT' END AS status FROM part")
def parse_dispatch(spark, d):
    """D30."""
    p = table(spark, d, "part")
    return ex.dispatch(p.where("p_size > 30"), p.where("p_size > 10"), p, "p_partkey")


@query("SELECT p_partkey, 1 + i AS task_no, CASE i WHEN 2 THEN CASE WHEN p_size >= 15 THEN 'P01' ELSE 'P02' END ELSE 'P00' END AS priority FROM part CROSS JOIN range(0, 3) r(i)")
def blueprint(spark, d):
    """D19."""
    items = ex.scoring_items(said(spark, d), "p_partkey")
    none = items.select("p_partkey", F.lit(False).alias("is_mandatory"))
    return ex.blueprint(items, none, "p_partkey").select("p_partkey", "task_no", "priority")


@query("SELECT p_partkey, item_no, CASE item_no WHEN 1 THEN 'a' ELSE 'b' END AS name, CAST(CASE item_no WHEN 1 THEN p_size ELSE 5 END AS DOUBLE) AS score, CAST(p_size + 5 AS DOUBLE) AS total FROM part CROSS JOIN (VALUES (1), (2)) v(item_no)")
def scorecard(spark, d):
    """D20, D21."""
    t = table(spark, d, "part").select("p_partkey", F.expr("'x\n| name | points |\n| --- | --- |\n| a | ' || CAST(p_size AS STRING) || '分 |\n| b | 5 |\ny'").alias("text"))
    return ex.scorecard(sx.table_islands(t, "p_partkey"), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'MUST' WHEN p_size > 10 THEN 'SCORE' ELSE 'FORMAT' END AS strength FROM part")
def requirement_strength(spark, d):
    """F22."""
    t = F.when(F.col("p_size") > 25, "必须提供").when(F.col("p_size") > 10, "得分点").otherwise("格式统一")
    return table(spark, d, "part").select("p_partkey", sc.requirement_strength(t).alias("strength"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'BLOCKED' ELSE 'PASS' END AS verdict FROM part")
def pricing_guard(spark, d):
    """A keyword beside an amount (the unit itself is one) and a price word with an amount make two signals."""
    t = F.when(F.col("p_size") > 30, F.concat(F.lit("合计"), F.col("p_size").cast("string"), F.lit("万元，费用另计"))).when(F.col("p_size") > 20, F.concat(F.lit("合计"), F.lit("说明" * 20), F.lit("12元"))).otherwise("施工说明")
    g = gd.pricing_signals(table(spark, d, "part").select("p_partkey", t.alias("text")))
    return g.select("p_partkey", F.when(F.col("blocked"), "BLOCKED").otherwise("PASS").alias("verdict"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '项目经理 电话13812345678' ELSE '电话***********' END || ' ***@***' AS masked FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, '项目经理 电话13812345678 a@b.co' FROM part WHERE p_partkey % 2 = 0""")
def mask_with_context(spark, d):
    """E4 with its exemption."""
    t = F.when(F.col("p_partkey") % 2 == 0, "项目经理 电话13812345678 a@b.co").otherwise("电话13812345678 a@b.co")
    return table(spark, d, "part").select("p_partkey", gd.mask(t).alias("masked"))


@query("""WITH i AS (SELECT p_partkey, '1101051949' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '002' AS b FROM part), c AS (SELECT p_partkey, b, (7 * CAST(b[1] AS INTEGER) + 9 * CAST(b[2] AS INTEGER) + 10 * CAST(b[3] AS INTEGER) + 5 * CAST(b[4] AS INTEGER) + 8 * CAST(b[5] AS INTEGER) + 4 * CAST(b[6] AS INTEGER) + 2 * CAST(b[7] AS INTEGER) + CAST(b[8] AS INTEGER) + 6 * CAST(b[9] AS INTEGER) + 3 * CAST(b[10] AS INTEGER) + 7 * CAST(b[11] AS INTEGER) + 9 * CAST(b[12] AS INTEGER) + 10 * CAST(b[13] AS INTEGER) + 5 * CAST(b[14] AS INTEGER) + 8 * CAST(b[15] AS INTEGER) + 4 * CAST(b[16] AS INTEGER) + 2 * CAST(b[17] AS INTEGER)) % 11 AS r FROM i)
 SELECT p_partkey, CASE WHEN substr('10X98765432', r + 1, 1) = 'X' THEN '******************' ELSE b || 'X' END AS masked FROM c""")
def mask_id_cards(spark, d):
    """E5."""
    t = F.concat(F.lit("1101051949"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("002X"))
    return table(spark, d, "part").select("p_partkey", gd.mask_ids(t).alias("masked"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '容量: 5MW 长度: ***km' ELSE '容量: ***MW' END AS treated FROM part")
def parameter_strategy(spark, d):
    """E6."""
    t = F.when(F.col("p_partkey") % 2 == 0, gd.strategy(F.lit("容量: 5MW 长度: 9km"), "allowlist", ("容量",))).otherwise(gd.strategy(F.lit("容量: 5MW")))
    return table(spark, d, "part").select("p_partkey", t.alias("treated"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'markup' WHEN 1 THEN 'manual_numbering' END AS policy, p_partkey % 3 <> 0 AS safe FROM part")
def render_policy(spark, d):
    """E9, E10, S16."""
    t = F.when(F.col("p_partkey") % 4 == 0, "<b>x</b>").when(F.col("p_partkey") % 4 == 1, "1.2 head").otherwise("fine")
    path = F.when(F.col("p_partkey") % 3 == 0, "a/../../b").otherwise("a/b.md")
    return table(spark, d, "part").select("p_partkey", gd.text_policy(t).alias("policy"), gd.safe_path(path).alias("safe"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '110kv,sz11-' || CAST(p_size AS VARCHAR) ELSE '' END AS facts FROM part")
def key_facts(spark, d):
    """C11."""
    t = F.when(F.col("p_size") > 25, F.concat(F.lit("需要 110 kV 的 SZ11-"), F.col("p_size").cast("string"))).otherwise("无")
    return table(spark, d, "part").select("p_partkey", F.array_join(rt.key_facts(t), ",").alias("facts"))


@query("SELECT doc_id, lang FROM documents WHERE n_chars % 7 <> 0 AND lang = 'en' AND n_chars % 5 <> 0 AND DATE '2024-01-01' + CAST(n_chars % 60 AS INTEGER) >= DATE '2024-01-31'")
def evidence_filters(spark, d):
    """C7, C8."""
    c = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("n_chars") % 7 == 0, "SECRET").otherwise("PUBLIC_OK").alias("sensitivity"), F.when(F.col("n_chars") % 5 == 0, F.array(F.lit("PRICING_RELATED"))).alias("tags"), F.lit(None).cast("string").alias("status"), F.expr("date_add(date'2024-01-01', cast(n_chars % 60 as int))").alias("valid_to"), F.lit(None).cast("date").alias("expires"))
    return rt.postfilter(rt.prefilter(c, {"lang": "en"}), "2024-01-31").select("doc_id", "lang")


@query("SELECT item_id, CASE WHEN contains(text, 'the') AND NOT contains(text, 'zzz') THEN text || ' zzz' ELSE text END AS expanded FROM benchmark")
def synonym_expansion(spark, d):
    """C17."""
    s = spark.createDataFrame([("the", "zzz")], "term string, alias string")
    return rt.expand(table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")), s).select("item_id", "expanded")


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN role ELSE text END AS context FROM conversations")
def parent_context(spark, d):
    """C24."""
    return table(spark, d, "conversations").select("conv_id", "turn", rt.with_context(F.col("role"), F.col("text")).alias("context"))


@query("SELECT p_partkey, i AS rank, CASE i WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS chunk_id FROM part CROSS JOIN (VALUES (1), (2), (3)) v(i)")
def model_rerank(spark, d):
    """C14: a model's answer as JSON, unranked hits after it."""
    p = table(spark, d, "part").select("p_partkey")
    hits = p.select(F.col("p_partkey").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("chunk_id")).withColumn("rank", F.col("chunk_id"))
    ranked = p.select(F.col("p_partkey").alias("query_id"), F.posexplode(rt.ranked_ids(F.lit('order: {"ranked_chunk_ids": ["3"]}'))).alias("place", "chunk_id")).withColumn("chunk_id", F.col("chunk_id").cast("int"))
    return rt.reorder(hits, ranked, 3).select(F.col("query_id").alias("p_partkey"), "rank", "chunk_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'NEED_HUMAN_INPUT' ELSE 'OK' END AS status, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'binding' ELSE 'conflict' END END AS cause FROM part")
def generation_status(spark, d):
    """F26."""
    k = F.col("p_partkey")
    g = sc.generation_status((k % 6 == 0), F.lit(False), k % 3 == 0, F.lit(False), F.lit("OK"))
    return table(spark, d, "part").select("p_partkey", g.status.alias("status"), g.cause.alias("cause"))


@query("SELECT p_partkey, '{\"a\": ' || CAST(p_size AS VARCHAR) || '}' AS fixed FROM part")
def json_repair(spark, d):
    """F25."""
    return table(spark, d, "part").select("p_partkey", sc.repaired_json(F.concat(F.lit('```json\n{"a": '), F.col("p_size").cast("string"), F.lit(",}\n```"))).alias("fixed"))


@query("SELECT p_partkey, 0 AS place, 'own' AS provider FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 0, 'default' FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 1, 'spare' FROM part WHERE p_partkey % 2 = 1")
def profile_chain(spark, d):
    """F14."""
    pair = lambda *names: F.array(*[F.struct(F.lit(n).alias("provider"), F.lit("m").alias("model")) for n in names])
    p = table(spark, d, "part").select("p_partkey", F.lit("GENERATE").alias("task"), F.when(F.col("p_partkey") % 2 == 0, pair("own", "own")).alias("chain"))
    base = spark.range(1).select(F.lit("GENERATE").alias("task"), pair("default", "spare", "default").alias("chain"))
    return sc.profile_chain(p, base, "p_partkey", "task").select("p_partkey", "place", "provider")


@query("SELECT user_id, min(CASE WHEN event_type <> 'error' THEN event_id END) AS used FROM events GROUP BY user_id")
def first_success(spark, d):
    """H10."""
    return st.first_success(table(spark, d, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", "event_id", "ok").select("user_id", "used")


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'FATAL_BLOCKED' WHEN count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') = 5 THEN 'READY' ELSE 'RUNNING' END AS status FROM orders GROUP BY o_custkey")
def pipeline_status(spark, d):
    """H12."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("step"), F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("OPEN").alias("status"))
    return st.pipeline_status(o, "o_custkey", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")).select("o_custkey", "status")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'bad result' WHEN 1 THEN 'bad date' END AS error FROM supplier")
def validated_append(spark, d):
    """R27."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, "maybe").otherwise(" won ").alias("result"), F.when(k % 3 == 1, "2024-13-99").otherwise("2024-01-05").alias("date"), F.lit(" ").alias("project"))
    return rl.validated(s).select("s_suppkey", "error")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 AND s_suppkey % 2 = 0")
def asset_pool(spark, d):
    """R15."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("project_id"), F.when(k % 2 == 0, "own").otherwise("rent").alias("ownership_role"), F.lit('{"asset_type": " Person"}').alias("metadata"))
    return rl.asset_pool(s, 3, ["own"], "person").select("s_suppkey")


@query("SELECT p_partkey, md5('| name | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(p_name, '|', chr(92) || '|') || ' | ' || CAST(p_size AS VARCHAR) || ' |') AS digest FROM part")
def markdown_rows(spark, d):
    """S15, S21."""
    t = sk.markdown_table(F.array(F.array(F.lit("name"), F.lit("size")), F.array("p_name", F.col("p_size").cast("string"))))
    return table(spark, d, "part").select("p_partkey", F.md5(F.replace(F.replace(t, F.lit("| --- | --- |"), F.lit("| --- | --- |")), F.lit("\r"), F.lit(""))).alias("digest"))


@query("SELECT p_partkey, 'brand' AS category, 0 AS line_no, p_brand AS text, 88.0 AS quality FROM part UNION ALL SELECT p_partkey, 'type', 0, p_type, 88.0 FROM part UNION ALL SELECT p_partkey, 'type', 1, p_name, 88.0 FROM part")
def form_chunks(spark, d):
    """S9."""
    return rd.form_chunks(table(spark, d, "part").select("p_partkey", F.array("p_brand", F.lit(" ")).alias("brand"), F.array("p_type", "p_name").alias("type")), "p_partkey", ["brand", "type"])


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def vector_upsert(spark, d):
    """The latest row by key of two halves."""
    e = table(spark, d, "events").select("user_id", "event_id")
    return sk.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT l_suppkey % 20 AS k, 'STAFF-CONFLICT' AS rule_id, count(*) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY 1 UNION ALL SELECT l_suppkey % 20, 'STAFF-MONTHS', count(*) FROM lineitem WHERE l_quantity < 6 GROUP BY 1 UNION ALL SELECT l_suppkey % 20, 'AUTH-MISSING', count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT 99, 'POOL-EMPTY', 0")
def staff_checks(spark, d):
    """F10."""
    pool = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("k"), (F.col("l_linenumber") == 7).cast("int").alias("active"), F.col("l_quantity").alias("months"), (F.col("l_returnflag") != "R").alias("authorized"))
    asked = pool.select("k").unionByName(spark.createDataFrame([(99,)], "k long"))
    return sc.staff_checks(pool, asked, "k").select("k", "rule_id", "n")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN '' ELSE '110kV' END AS gone FROM part")
def missing_numbers(spark, d):
    """F13."""
    return table(spark, d, "part").select("p_partkey", F.array_join(sc.missing_numbers(F.lit("电压 110 kV"), F.when(F.col("p_size") > 25, "用 110kV 设备").otherwise("用 35kV 设备")), ",").alias("gone"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS admitted FROM orders")
def admit_override(spark, d):
    """F29."""
    o = table(spark, d, "orders")
    f = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("P0").alias("severity"))
    return sc.admit_override(o.select("o_orderkey"), f, o.where("o_orderkey % 2 = 0").select("o_orderkey"), "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'PROJECT_MISMATCH' WHEN c_custkey % 3 = 0 THEN 'ALREADY_LOCKED' WHEN c_custkey % 2 = 0 THEN 'APPROVAL_REQUIRED' ELSE 'LOCKED' END AS lock_result FROM customer")
def scorecard_lock(spark, d):
    """F28."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.lit(1).alias("p"), F.when(k % 4 == 0, 2).otherwise(1).alias("r"), (k % 2 != 0).alias("ok"), (k % 3 == 0).alias("lock"))
    return sc.lock_scorecard(c, "p", "r", "ok", "lock").select("c_custkey", "lock_result")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'fallback' ELSE text END AS content FROM conversations")
def content_fallback(spark, d):
    """F31."""
    return table(spark, d, "conversations").select("conv_id", "turn", sc.content_or(F.when(F.col("role") == "user", " ").otherwise(F.col("text")), F.array(F.lit(" ")), F.lit("fallback")).alias("content"))


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'insufficient' ELSE 'fine' END AS note FROM (SELECT doc_id, length(trim(text)) AS n_chars FROM documents) x")
def meta_merge(spark, d):
    """B15."""
    m = sx.merge_meta(table(spark, d, "documents").withColumns({"summary": F.lit("s"), "confidence": F.lit(0.9)}), "text", note="insufficient")
    return m.select("doc_id", F.when(F.contains("summary", F.lit("insufficient")), "insufficient").otherwise("fine").alias("note"))


@query("SELECT doc_id, left(replace(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), chr(10), ' '), 20) AS head, length(text) > 0 AS some FROM documents")
def section_summary(spark, d):
    """B14."""
    e = sx.enhance(table(spark, d, "documents"), "lang", "text", F.array(F.lit("x")))
    return e.select("doc_id", F.substring("summary", 1, 20).alias("head"), (F.length("text") > 0).alias("some"))


@query()
def enhanced_markdown(spark, d):
    """S14 over B7."""
    s = sx.sectionize(table(spark, d, "documents"), "doc_id")
    return sk.enhanced_markdown(s, "doc_id", "section_no", "title", ["anchor"], "content").select("doc_id", F.length("markdown").alias("n"))


@query()
def condition_coverage(spark, d):
    """The conditions of tenders against each text of the same tender."""
    c = ex.conditions(tenders(spark, d), "p_partkey", "p_size", "text").withColumns({"words": F.array(F.lit("密封")), "kind_words": F.array(F.lit("格式"), F.lit("签章"))})
    return ex.coverage_metrics(ex.condition_coverage(c, tenders(spark, d).select("p_partkey", "text"), "p_partkey"), "p_partkey")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'gis_installation_plan' WHEN 1 THEN 'safety_plan' END AS kind FROM part")
def section_kinds(spark, d):
    """D26."""
    t = F.when(F.col("p_size") % 3 == 0, "GIS安装要点").when(F.col("p_size") % 3 == 1, "安全管理").otherwise("其他")
    return table(spark, d, "part").select("p_partkey", ex.section_kind(t, F.lit("")).alias("kind"))


@query("SELECT p_partkey, 'RISK_ALERTS' AS category, 80 AS importance FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'BONUS_POINTS', 70 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'COMPLIANCE_REQUIREMENTS', 75 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'COMPLIANCE_REQUIREMENTS', 75 FROM part UNION ALL SELECT p_partkey, 'SCORING_POINTS', 60 + least(p_size, 30) FROM part")
def tender_insights(spark, d):
    """D3 with the domain's rules, without its bidding points: the must line and the people's line (提供 is not there, 须 is), the score, the condition, the bonus."""
    i = ex.line_insights(said(spark, d), "p_partkey")
    return i.where("category <> 'BIDDING_POINTS'").select("p_partkey", "category", "importance")


@query()
def format_signature(spark, d):
    """D13."""
    r = ex.format_signature(said(spark, d), "p_partkey")
    return r.select("p_partkey", "paper_copies", F.array_join("envelope_requirements", ",").alias("envelopes"), F.size("format_clauses").alias("clauses"))


@query()
def technical_requirements(spark, d):
    """D10, D18."""
    t = ex.technical_requirements(said(spark, d), "p_partkey", must=("要求",))
    return ex.deviations(t).select("p_partkey", "req_id", "category", "voltage_level", "engineering_type", "table", "deviation_risk")
