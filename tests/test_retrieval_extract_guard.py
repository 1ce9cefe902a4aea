import pytest
from pyspark.sql import functions as F

from quarry.operators import extract as ex
from quarry.operators import guard as gd
from quarry.operators import retrieval as rt


def one(spark, c, t):
    return spark.createDataFrame([(t,)], "t string").select(c).first()[0]


def test_fuse_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id int, rank int")
    got = [(r.chunk_id, round(r.score, 9)) for r in rt.fuse([a, b], 10).orderBy("rank").collect()]
    assert got == [(11, round(1 / 62 + 1 / 61, 9)), (10, round(1 / 61, 9)), (12, round(1 / 62, 9))]


def test_rerank_prefers_words(spark):
    h = spark.createDataFrame([(1, 1, 0.5, "110kV 变压器", "其他内容", 80.0), (1, 2, 0.4, "110kV 变压器", "110kV 变压器 参数", 50.0)], "query_id int, chunk_id int, score double, query string, text string, quality double")
    got = [r.chunk_id for r in rt.rerank(h, 5).orderBy("rank").collect()]
    assert got == [2, 1]


def test_key_facts(spark):
    assert one(spark, rt.key_facts(F.col("t")), "需要 110 kV 和 SZ11-50000") == ["110kv", "sz11-50000"]
    h = spark.createDataFrame([(1, 1, "110kV", "有 110 KV"), (1, 2, "110kV", "无"), (2, 3, "35kV", "无")], "query_id int, chunk_id int, query string, text string")
    assert sorted(r.chunk_id for r in rt.key_fact_filter(h).collect()) == [1, 3]


def test_filters(spark):
    df = spark.createDataFrame([(1, "PUBLIC_OK", ["x"], "active", None), (2, "SECRET", None, None, None), (3, "PUBLIC_OK", ["PRICING_RELATED"], None, None), (4, "PUBLIC_OK", None, "deprecated", None), (5, "PUBLIC_OK", None, None, "2020-01-01")], "id int, sensitivity string, tags array<string>, status string, v string")
    own = df.withColumns({"valid_to": F.col("v").cast("date"), "expires": F.lit(None).cast("date")})
    assert sorted(r.id for r in rt.prefilter(own, {}).collect()) == [1, 5]
    assert [r.id for r in rt.postfilter(own, "2024-01-01").collect()] == [1]


def test_decompose(spark):
    df = spark.createDataFrame([(1, "投标人必须具备承装修试资质，且满足，业绩不少于三个类似工程；人员"), (2, ""), (3, None)], "id int, text string")
    got = [(r.id, r.sub_no, r.description, r.category) for r in rt.decompose(df, "id", "text").orderBy("id", "sub_no").collect()]
    assert got == [(1, 1, "投标人必须具备承装修试资质，且满足", "QUALIFICATION"), (1, 2, "业绩不少于三个类似工程，人员", "PERFORMANCE"), (2, 1, "", "GENERAL"), (3, 1, "", "GENERAL")]


def test_merge_keeps_first_place_and_last_score(spark):
    h = spark.createDataFrame([(1, 1, 10, 0.9, 1), (1, 1, 11, 0.8, 2), (1, 2, 10, 0.3, 1)], "q int, sub_no int, chunk_id int, score double, rank int")
    got = [(r.chunk_id, r.score, r.covers) for r in rt.merge_hits(h, ["q"]).orderBy("position").collect()]
    assert got == [(10, 0.3, [1, 2]), (11, 0.8, [1])]


def test_packing_skips_what_overflows(spark):
    df = spark.createDataFrame([(1, 1, 3.0, "a" * 50), (1, 2, 2.0, "b" * 60), (1, 3, 1.0, "c" * 40)], "query_id int, chunk_id int, bm25 double, text string")
    got = [(r.chunk_id, len(r.snippet)) for r in rt.pack_context(df, items=5, chars=100, snippet=80).orderBy("place").collect()]
    assert got == [(1, 50), (3, 40)]


def test_model_order(spark):
    h = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query_id int, chunk_id int, rank int")
    m = spark.createDataFrame([(1, 3, 1)], "query_id int, chunk_id int, place int")
    assert [r.chunk_id for r in rt.reorder(h, m, 5).orderBy("rank").collect()] == [3, 1, 2]
    assert one(spark, rt.ranked_ids(F.col("t")), 'text {"ranked_chunk_ids": ["a", " b "]} more') == ["a", "b"]
    assert one(spark, rt.ranked_ids(F.col("t")), "nothing") == []


def test_synonyms_and_expiry(spark):
    q = spark.createDataFrame([("主变 容量",)], "query string")
    s = spark.createDataFrame([("主变", "变压器"), ("主变", "容量")], "term string, alias string")
    assert rt.expand(q, s).first().expanded == "主变 容量 变压器"
    assert [one(spark, rt.expiry(F.col("t"), "2024-01-31"), x) for x in (None, "x", "2024-01-01", "2024-02-10", "2025-01-01")] == ["unknown", "unknown", "expired", "expiring_soon", "valid"]


def test_strength_and_requirements(spark):
    assert [one(spark, ex.strength(F.col("t")), x) for x in ("视为废标", "予以拒绝", "扣分处理", "建议")] == ["DISQUALIFY", "REJECT", "DEDUCT", "ADVISORY"]
    df = spark.createDataFrame([(1, "第一章 资格\n投标人必须具备资质。技术评分分值10分\f无关内容文字。不得偏离，详见第三章")], "id int, text string")
    got = [(r.requirement_id, r.page_no, r.anchor, r.is_must, r.score_weight, r.cross_refs) for r in ex.requirements(ex.sentences(df, "id"), "id").orderBy("requirement_id").collect()]
    assert got == [("REQ-0001", 1, "第一章 资格", True, None, []), ("REQ-0002", 1, "第一章 资格", False, 10.0, []), ("REQ-0003", 2, None, True, None, ["详见第三章"])]


def test_extractors(spark):
    text = "评分标准：技术评分分值30分。评标办法商务得分20分。满分50分"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    totals = df.select("id", ex.total_score("text").alias("total"))
    got = [(r.category, r.max_score, r.weight) for r in ex.scoring_items(ex.sentences(df, "id"), "id", totals).orderBy("item_id").collect()]
    assert got == [("technical", 30.0, 0.6), ("commercial", 20.0, 0.4)]
    p = spark.createDataFrame([(1, "项目经理须具备一级建造师，无在建工程，社保6个月，10年以上工作经验。项目经理另行说明的内容。安全员须持A类安全证书上岗")], "id int, text string")
    got = {r.role: (r.cert_required, r.no_active_project, r.social_security_months, r.min_experience_years) for r in ex.key_personnel(ex.sentences(p, "id"), "id").collect()}
    assert got == {"项目经理": ("一级建造师", True, 6, 10), "安全员": ("A类安全证", False, None, None)}
    c = ex.compliance_items(ex.sentences(spark.createDataFrame([(1, "未按要求密封的按废标处理。投标人必须提供资料说明")], "id int, text string"), "id"), "id")
    assert [(r.item_id, r.check_type) for r in c.orderBy("item_id").collect()] == [("CMP-001", "preliminary"), ("CMP-002", "detailed")]


def test_facts_and_conflicts(spark):
    a = ex.facts(spark.createDataFrame([(1, "项目名称：某工程\n工期：90天\n电压 110 kV\n投标保证金：5万元")], "id int, text string"), "id")
    got = {r.field: r.value for r in a.collect()}
    assert got["project_name"] == "某工程" and got["total_duration_days"] == "90" and got["voltage_level"] == "110kV" and float(got["bid_bond_amount"]) == 50000
    b = ex.facts(spark.createDataFrame([(1, "项目名称：另一工程")], "id int, text string"), "id")
    assert [tuple(r) for r in ex.fact_conflicts(a, b, "id").collect()] == [(1, "project_name", "某工程", "另一工程")]


def test_risk_and_conditions(spark):
    r = ex.risk_scan(spark.createDataFrame([(1, "未提供安全生产许可证的，按废标处理"), (2, "营业执照建议提供"), (3, "无关")], "id int, text string"), "id").collect()
    assert sorted((x.id, x.pattern_id, x.risk) for x in r) == [(1, "QUAL_SAFETY_LICENSE", "FATAL"), (2, "QUAL_BUSINESS_LICENSE", "WARN")]
    c = ex.conditions(spark.createDataFrame([(1, 1, "资质证书过期的废标。未按要求密封"), (1, 2, "未按要求密封")], "p int, n int, text string"), "p", "n", "text")
    assert [(x.condition_id, x.strength, x.category) for x in c.orderBy("condition_id").collect()] == [("DQ-001", "DISQUALIFY", "QUALIFICATION"), ("DQ-002", "REJECT", "FORMAT")]


def test_scorecard(spark):
    t = spark.createDataFrame([(1, 1, "| 名称 | 分值 | 说明 |\n| --- | --- | --- |\n| 方案 | 10分 | x |\n| 业绩 | 5 | y |")], "id int, table_no int, table_md string")
    assert [(r.item_no, r.name, r.score, r.total) for r in ex.scorecard(t, "id").orderBy("item_no").collect()] == [(1, "方案", 10.0, 15.0), (2, "业绩", 5.0, 15.0)]


@pytest.mark.parametrize("text,blocked", [("投标报价如下", True), ("单价：100元，合计：200元，费用", True), ("变压器容量 50MVA 电压 110kV", False), ("单元测试 100", False), ("施工方案 合计100元 费用", False), ("本工程报价 合计 5万元", True)])
def test_pricing(spark, text, blocked):
    assert gd.pricing_signals(spark.createDataFrame([(text,)], "text string")).first().blocked is blocked


def test_near_amount_is_exact(spark):
    import re

    for t in ("合计" + "x" * 18 + "12元", "合计" + "x" * 21 + "12元", "12元" + "y" * 17 + "合计", "12元" + "y" * 20 + "合计", "合计 合计 " + "z" * 30 + "合计 3元"):
        want = any(re.search(gd.MONEY, t[max(0, m.start() - 20) : m.end() + 20]) is not None for m in re.finditer("合计", t))
        assert one(spark, gd.near_amount(F.col("t"), "合计"), t) is want


def test_masks(spark):
    assert one(spark, gd.mask(F.col("t")), "联系 a.b@x.com 或 13812345678") == "联系 ***@*** 或 ***********"
    assert one(spark, gd.mask(F.col("t")), "项目经理 张三 13812345678") == "项目经理 张三 13812345678"
    assert one(spark, gd.mask(F.col("t"), exempt=None), "项目经理 13812345678") == "项目经理 ***********"
    assert one(spark, gd.mask(F.col("t")), "证 11010519491231002X 和 110105194912310021") == "证 ****************** 和 110105194912310021"
    assert one(spark, gd.strategy(F.col("t")), "容量: 50MW") == "容量: ***MW"
    assert one(spark, gd.strategy(F.col("t"), "allowlist", ("容量",)), "容量 50") == "容量 50"


def test_sanitize(spark):
    r = gd.sanitize(spark.createDataFrame([("投标报价",), ("mail a@b.co 容量 5",), (None,)], "text string")).collect()
    assert [(x.sanitized, x.warnings) for x in r] == [("BLOCKED_PRICING_CONTENT", ["pricing_blocked"]), ("mail ***@*** 容量 ***", ["pii_masked", "sensitive_strategy_applied:mask"]), ("", [])]


def test_frozen(spark):
    df = spark.createDataFrame([("d", "[FROZEN:a]x[/FROZEN] [FROZEN:b]y[/FROZEN] [FROZEN:b]z[/FROZEN]")], "doc string, text string")
    import hashlib

    want = spark.createDataFrame([("d", "a", hashlib.md5(b"x").hexdigest()), ("d", "c", "0")], "doc string, block string, signature string")
    assert sorted(tuple(r) for r in gd.frozen_check(df, "doc", "text", want).collect()) == [("d", "b", "DUPLICATE"), ("d", "c", "MISSING")]


def test_paths(spark):
    assert [one(spark, gd.safe_path(F.col("t")), x) for x in ("a/b.md", "../x", "/etc", "C:\\x", "a/../../b")] == [True, False, False, False, False]
    assert [one(spark, gd.safe_name(F.col("t")), x) for x in ("a-1.md", "..", "a/b")] == [True, False, False]
    assert [one(spark, gd.text_policy(F.col("t")), x) for x in ("<b>x</b>", "fine", "1.2 heading")] == ["markup", None, "manual_numbering"]
