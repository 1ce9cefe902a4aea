"""Rule extraction (D1-D31): documents to sentences once, then typed rows by projections with rules as parameters.

`sentences` is meant to be computed once and shared (persisted by the caller) by all extractors of a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx

SCORE = r"(?:评分|分值|得分)\D{0,5}(\d+(?:\.\d+)?)"
CROSS = r"((?:详见|参见|见|按照|依据|根据)\s*(?:第?[一二三四五六七八九十\d]+[章节条款]|附[录件表]\s*[A-Za-z\d一二三四五六七八九十]*|[A-Z]\.\d+(?:\.\d+)*))"
# Keyword lists of the domain.
DISQUALIFY = (
    "废标", "否决投标", "不予通过", "取消投标资格", "取消中标资格", "拒绝接收", "拒绝投标", "资格审查", "资质不符", "资格预审不合格", "无效投标", "投标无效", "不具备资格", "资质等级不满足", "证书过期", "许可证失效",
    "未取得安全生产许可证", "无承装修试资质", "技术不达标", "技术偏离", "实质性偏离", "重大偏差", "不满足技术要求", "技术参数不符", "未响应关键技术条款", "未提供施工组织设计", "方案缺失", "图纸缺失", "未提交调试方案", "未附带电作业方案",
    "报价超过最高限价", "低于成本价", "围标", "串标", "投标保证金不足", "未缴纳投标保证金", "未提供履约担保", "未按要求签署合同条款", "商务偏差", "合同条款实质性不响应", "未提供安全生产许可证", "安全方案缺失", "未编制专项安全方案",
    "未提供应急预案", "安全等级不满足", "缺少带电作业安全措施", "未提供高处作业方案", "未按要求密封", "逾期送达", "未按格式要求", "未加盖公章", "签章缺失", "授权委托书缺失", "投标文件份数不符", "电子签章无效", "未按招标文件要求编制",
)
BONUS = ("加分", "优先考虑", "优先", "扣减", "扣分", "罚款", "处罚")
SCORING = ("评分", "评审", "评标", "打分", "分值", "得分", "技术评分", "商务评分", "价格评分", "综合评分")
SCORE_KINDS: lx.Lexicon = (("technical", "技术"), ("commercial", "商务"), ("pricing", "价格|报价"), ("comprehensive", "综合"), ("qualification", "资信"), ("performance", "业绩"), ("proposal", "方案"), ("construction", "施工"), ("safety", "安全"), ("quality", "质量"), ("schedule", "工期|进度"))
PRELIMINARY = ("资格审查", "初审", "形式审查", "资质要求", "投标人资格", "投标人须", "投标人应", "投标人必须", "营业执照", "安全生产许可证", "承装修试", "资质等级", "注册资本", "投标保证金")
DETAILED = ("评审", "详细评审", "技术评审", "商务评审", "综合评分", "打分", "评委", "评标")
TECHNICAL = ("技术要求", "技术标准", "技术规范", "技术参数", "施工方案", "施工工艺", "施工方法", "质量标准", "验收标准", "试验要求", "设备参数", "材料要求", "工器具")
TECH_KINDS: lx.Lexicon = (("construction_method", "施工"), ("equipment", "设备"), ("material", "材料"), ("testing", "试验"), ("acceptance", "验收"), ("safety", "安全"), ("quality", "质量"), ("schedule", "工期"), ("commissioning", "调试"), ("relay_protection", "继电保护"), ("automation", "自动化"))
POWER = "变电站|输电线路|配电网|换流站|GIS|开关柜|变压器|互感器|断路器|隔离开关|避雷器|电缆|架空线|导线|继电保护|自动化|调度|SCADA|直流系统|接地装置|绝缘|耐压试验|交接试验|带电作业|铁塔|基础|杆塔|拉线|金具|绝缘子|电压等级|kV|kv|KV|额定容量|MVA|MW"
INSIGHTS = {
    "must": "必须|应当|不得|须|需|符合|满足|提交|提供",
    "scoring": "评分|分值|得分|评审|评分办法|评分标准|扣分",
    "bonus": "加分|优先|奖励|额外分|附加分|同等条件优先",
    "bidding": "投标|方案|技术|服务|实施|交付|工期|团队|资质|业绩|案例|保障",
    "risk": "废标|无效标|不予受理|拒绝|保证金|罚则|违约|扣分|否决|实质性偏离|重大偏差|取消资格|围标|串标|低于成本|安全事故|停工|返工|索赔|终止合同|解除合同|带电作业违规|误操作|越级跳闸|设备损坏",
}
PROJECTS = "(变电站|输电线路|配电网|电缆工程|架空线路|新能源|光伏|风电|换流站|充电站|储能|微电网|配网自动化)"
ROLES: lx.Lexicon = (("项目经理", "项目经理|项目负责人"), ("技术负责人", "技术负责人|技术总工|总工程师"), ("安全员", "安全员|安全负责人|专职安全[管生]"), ("质量员", "质量员|质量负责人|质检[员师]"), ("施工员", "施工员|现场负责"))
CERTIFICATES = "(一级建造师|二级建造师|注册[电气安全造价监理]+工程师|高级工程师|工程师|技师|高级技师|安全生产考核合格证书?|[ABC]类安全证|特种作业[操资][作质]证|电工[进资][网质]证|承装修试[一二三四五]级)"
CONDITIONS: Sequence[tuple[str, tuple[str, ...]]] = (
    ("QUALIFICATION", ("资质", "资格", "许可证", "证书", "营业执照", "承装修试", "安全生产许可证", "业绩", "人员")),
    ("TECHNICAL", ("技术", "方案", "施工组织", "图纸", "参数", "偏离", "偏差", "调试方案", "带电作业方案", "设计")),
    ("COMMERCIAL", ("报价", "限价", "保证金", "担保", "合同", "商务", "围标", "串标", "成本价")),
    ("SAFETY", ("安全", "安全方案", "安全生产", "应急", "消防", "高处作业", "带电作业安全")),
    ("FORMAT", ("密封", "格式", "签章", "公章", "份数", "逾期", "授权委托", "电子签章", "编制")),
)
SECTION_KINDS: Sequence[tuple[str, tuple[str, ...]]] = (
    ("commissioning_plan", ("调试方案", "调试")), ("live_work_plan", ("带电作业",)), ("heavy_equipment_plan", ("设备吊装", "大型设备")), ("cable_laying_plan", ("电缆敷设", "电缆")), ("gis_installation_plan", ("gis安装", "gis")), ("stringing_plan", ("架线施工", "架线")), ("tower_foundation_plan", ("铁塔基础", "杆塔基础")),
    ("grounding_plan", ("接地工程", "接地")), ("anti_pollution_plan", ("防污闪",)), ("technical_proposal", ("技术方案", "技术路线", "总体方案")), ("safety_plan", ("安全施工", "安全生产", "安全方案", "安全管理")), ("construction_plan", ("施工组织", "施工方案", "施工部署")), ("quality_plan", ("质量保证", "质量管理", "质量控制", "质量体系")),
    ("schedule_plan", ("进度计划", "工期保证")), ("environmental_plan", ("环境保护", "环保方案", "水土保持")), ("resource_plan", ("资源配置", "人员配置", "设备配置")), ("commercial_proposal", ("商务响应", "商务方案", "报价说明")),
)
REJECTION = "废标|否决|拒绝|无效|不予受理|不予通过|不得参与|取消资格|不具备|不予接受|不合格|按废标处理|视为无效|不予评审"
ADVICE = "酌情扣分|适当扣分|宜|建议|优先考虑|加分"
LINE = r"[:：]\s*([^\n\r]+)"
FACTS: lx.Lexicon = (
    ("project_name", f"(?:项目名称|工程名称){LINE}"), ("project_location", f"(?:工程地点|项目地点|建设地点){LINE}"), ("construction_unit", f"(?:建设单位|业主单位|发包人|招标人){LINE}"), ("supervision_unit", f"(?:监理单位|监理公司){LINE}"), ("design_unit", f"(?:设计单位|设计院){LINE}"),
    ("total_duration_days", r"(?:工期|总工期|计划工期)\s*[:：]?\s*(\d+)\s*天"), ("manager_name", r"(?:项目经理|项目负责人)[:：]\s*([一-龥A-Za-z·]{2,20})"), ("manager_certificate", r"(?:证书编号|证书号|执业证号)[:：]\s*([A-Za-z0-9\-]{3,40})"), ("voltage_level", r"(±?\d+(?:\.\d+)?\s*(?:kV|KV|kv)(?:\s*/\s*\d+(?:\.\d+)?\s*(?:kV|KV|kv))*|\d+(?:\.\d+)?\s*千伏)"),
    ("contract_amount", r"(?:合同金额|合同价|中标金额)[:：]?\s*([0-9]+(?:\.[0-9]+)?)"), ("quality_standard", f"(?:质量标准|质量等级|质量目标|质量要求){LINE}"), ("safety_level", f"(?:安全文明等级|安全目标|安全等级){LINE}"), ("subcontract_restriction", f"(?:分包限制|分包要求|禁止分包){LINE}"), ("milestone_nodes", f"(?:关键节点|里程碑|工期节点){LINE}"),
    ("bid_bond_amount", r"(?:投标保证金|保证金金额)[:：]?\s*([0-9]+(?:\.[0-9]+)?)\s*(?:万元|万)?"), ("performance_bond_ratio", r"(?:履约保证金|履约担保)[:：]?\s*([0-9]+(?:\.[0-9]+)?)\s*%"), ("rated_capacity", r"(?:额定容量|主变容量|装机容量)[:：]?\s*(\d+(?:\.\d+)?\s*(?:MVA|MW|kVA|kW|万千瓦))"), ("line_length", r"(?:线路长度|全长|路径长度)[:：]?\s*(\d+(?:\.\d+)?\s*(?:km|公里|千米|m|米))"),
    ("conductor_type", f"(?:导线型号|导线规格|导线截面|导线类型){LINE}"), ("tower_count", r"(?:杆塔数量|铁塔数量|杆塔总数|基数)[:：]?\s*(\d+)\s*(?:基|座)?"), ("substation_type", f"(?:变电站类型|站型|变电站形式){LINE}"), ("commissioning_deadline", f"(?:投运日期|投产日期|送电日期|并网日期){LINE}"), ("grid_connection_point", f"(?:接入点|并网点|接入系统|接入电网){LINE}"),
    ("seismic_fortification", r"(?:抗震设防|地震烈度|抗震等级)[:：]?\s*([^\n\r]+)"), ("pollution_level", r"(?:污秽等级|污区等级|外绝缘爬距|污染等级)[:：]?\s*([^\n\r]+)"), ("altitude", r"(?:海拔高度|海拔|平均海拔)[:：]?\s*(\d+(?:\.\d+)?\s*(?:m|米))"), ("design_wind_speed", r"(?:设计风速|基本风速|最大风速)[:：]?\s*(\d+(?:\.\d+)?\s*(?:m/s|米/秒))"),
    ("annual_thunder_days", r"(?:雷暴日|年平均雷暴日|雷电日数)[:：]?\s*(\d+)\s*(?:天|日|d)?"), ("owner_project_manager", r"(?:业主项目经理|甲方项目经理|建设单位项目经理)[:：]\s*([一-龥A-Za-z·]{2,20})"), ("construction_permit_no", r"(?:施工许可证号|施工许可证编号|建设工程施工许可证)[:：]\s*([A-Za-z0-9\-]+)"), ("epc_mode", f"(?:建设模式|承包模式|工程模式|EPC|总承包){LINE}"),
)
#: (id, category, risk, keywords, refinement or None)
RISKS = (
    ("QUAL_SAFETY_LICENSE", "safety_license", "FATAL", ("安全生产许可证",), None),
    ("QUAL_POWER_GENERAL", "qualification", "FATAL", ("电力工程施工总承包",), "电力工程施工总承包[一壹二贰三叁]级"),
    ("QUAL_ELECTRICAL_INSTALL", "qualification", "FATAL", ("电力设施安装", "承装承修承试"), "承装[（(]修[、,]试[）)].*?[一二三四五]级"),
    ("QUAL_BUSINESS_LICENSE", "business_license", "FATAL", ("营业执照",), None),
    ("QUAL_GENERAL", "qualification", "FATAL", ("资质等级", "资质要求", "资质证书"), None),
    ("PROC_BID_BOND", "bid_bond", "FATAL", ("投标保证金",), "投标保证金.*?(?:万元|元)"),
    ("PROC_BID_VALIDITY", "bid_validity", "HIGH", ("投标有效期",), r"投标有效期.*?\d+.*?天"),
    ("PROC_SEAL_SIGNATURE", "format_compliance", "FATAL", ("法定代表人签字", "加盖公章", "投标文件签章"), None),
    ("PERSON_CONSTRUCTOR", "personnel", "FATAL", ("一级建造师", "二级建造师"), "[一二]级建造师.*?(?:机电|电力|市政)"),
    ("PERSON_SPECIAL_OPS", "special_operator", "FATAL", ("特种作业", "操作证", "电工证"), "特种作业.*?(?:电工|高处|焊接|吊装)"),
    ("PERSON_SAFETY_OFFICER", "personnel", "HIGH", ("专职安全员", "安全生产管理人员"), None),
    ("POWER_VOLTAGE_PERF", "voltage_performance", "FATAL", ("电压等级",), r"(?:110|220|330|500|750|1000)\s*kV.*?(?:业绩|经验|施工)"),
    ("POWER_GRID_CONNECTION", "grid_connection", "HIGH", ("并网验收", "并网调试"), None),
    ("POWER_RELAY_PROTECTION", "relay_protection", "HIGH", ("继电保护", "保护整定"), None),
    ("POWER_LIVE_WORK", "live_work", "FATAL", ("带电作业",), None),
    ("POWER_FACILITY_ZONE", "facility_protection", "HIGH", ("电力设施保护区",), None),
    ("POWER_SUBSTATION", "substation", "HIGH", ("变电站", "变电所", "开关站"), "(?:变电站|变电所|开关站).*?(?:施工|安装|调试)"),
    ("POWER_TRANSMISSION", "transmission_line", "HIGH", ("架空线路", "输电线路", "电缆线路"), "(?:架空|输电|电缆)线路.*?(?:施工|架设|敷设)"),
    ("POWER_GROUNDING", "grounding", "HIGH", ("接地装置", "接地电阻", "接地网"), None),
    ("POWER_SAFETY_TOOLS", "safety_tools", "HIGH", ("安全工器具", "绝缘工具"), "(?:安全工器具|绝缘工具).*?检测"),
    ("POWER_COMMISSIONING", "commissioning", "HIGH", ("投运", "送电", "通电"), "(?:投运|送电|通电).*?(?:期限|日期|时间|节点)"),
    ("PERF_SIMILAR_PROJECT", "similar_performance", "HIGH", ("类似工程", "类似项目", "同类工程"), "(?:类似|同类)(?:工程|项目).*?(?:业绩|经验)"),
    ("PERF_CONTRACT_VALUE", "contract_performance", "HIGH", ("合同金额", "合同额"), r"合同(?:金额|额).*?\d+.*?万"),
    ("LEGAL_NO_BLACKLIST", "legal_compliance", "FATAL", ("失信被执行人", "黑名单", "行贿犯罪"), None),
    ("LEGAL_NO_LITIGATION", "legal_compliance", "HIGH", ("重大诉讼", "仲裁", "行政处罚"), None),
)


def strength(c: Column) -> Column:
    """DISQUALIFY, REJECT, DEDUCT or ADVISORY, by the first tier with a keyword."""
    return lx.first_match(c, lx.STRENGTHS, "ADVISORY")


def cross_references(c: Column) -> Column:
    """D7."""
    return F.transform(F.regexp_extract_all(tx.text(c), F.lit(CROSS), F.lit(1)), lambda x: F.trim(x))


def score_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, SCORE, 1), F.lit("")).cast("double")


def sentences(df: DataFrame, key: str, text: str = "text", least: int = 6, page_break: str = "\f", anchor: str = tx.ANCHOR) -> DataFrame:
    """(key, pos, page_no, content, anchor): pages, sentences of at least `least` characters and the last heading at or before each on its page."""
    pages = df.select(key, F.posexplode(F.filter(F.split(tx.text(text), page_break), lambda p: F.trim(p) != "")).alias("p", "page"))
    rows = pages.select(key, "p", F.posexplode(tx.sentences("page")).alias("s", "content")).where(F.length("content") >= least)
    own = rows.withColumn("h", F.when(tx.is_heading("content", anchor), F.substring("content", 1, 48)))
    w = W.partitionBy(key, "p").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    return own.select(key, (F.col("p") * 1_000_000 + F.col("s")).alias("pos"), (F.col("p") + 1).alias("page_no"), "content", F.last("h", ignorenulls=True).over(w).alias("anchor"))


def numbered(df: DataFrame, key: str, prefix: str, digits: int, name: str = "item_id") -> DataFrame:
    return df.withColumn(name, F.format_string(f"{prefix}-%0{digits}d", F.row_number().over(W.partitionBy(key).orderBy("pos"))))


def requirements(said: DataFrame, key: str, must: Sequence[str] = lx.MUST, more: Sequence[str] = (*DISQUALIFY, *BONUS)) -> DataFrame:
    """Sentences with a must word, another keyword or a score, numbered by document, with must flag, score and cross references."""
    c = F.col("content")
    is_must, score = lx.any_of(c, must), score_of(c)
    return numbered(said.where(is_must | lx.any_of(c, more) | score.isNotNull()), key, "REQ", 4, "requirement_id").select(key, "requirement_id", "pos", "page_no", "anchor", "content", is_must.alias("is_must"), score.alias("score_weight"), F.contains(c, F.lit("格式")).alias("format_required"), cross_references(c).alias("cross_refs"))


def line_insights(said: DataFrame, key: str, rules: dict[str, str] = INSIGHTS, base: dict[str, int] | None = None, power: str | None = POWER, default: bool = False) -> DataFrame:
    """(key, pos, category, content, anchor, importance): a row for each kind that a line is of. rules: patterns of must, scoring, bonus, bidding and risk.

    base: importances of bidding, scoring, must, bonus and risk, by default those for lines; with default, lines of no kind become bidding points of 50.
    """
    b = base or {"bidding": 55, "scoring": 60, "must": 75, "bonus": 70, "risk": 80}
    c = F.col("content")
    is_ = {k: c.rlike(p) for k, p in rules.items()}
    is_["bidding"] = is_["bidding"] | (F.contains(c, F.lit("要求")) & (F.length(c) >= 10))
    score = score_of(c)
    boost = F.when(c.rlike(power), 10).otherwise(0) if power else F.lit(0)
    one = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("category"), (value + boost).cast("int").alias("importance")))
    scored = is_["scoring"] | score.isNotNull()
    rows = [
        one(is_["bidding"], "BIDDING_POINTS", F.lit(b["bidding"]) + F.when(is_["must"], 15).otherwise(0)),
        one(scored, "SCORING_POINTS", F.lit(b["scoring"]) + F.least(F.coalesce(score, F.lit(0.0)).cast("int"), F.lit(30))),
        one(is_["must"], "COMPLIANCE_REQUIREMENTS", F.lit(b["must"])),
        one(is_["bonus"], "BONUS_POINTS", F.lit(b["bonus"])),
        one(is_["risk"], "RISK_ALERTS", F.lit(b["risk"])),
    ]
    if default:
        rows.append(one(~(is_["bidding"] | scored | is_["must"] | is_["bonus"] | is_["risk"]), "BIDDING_POINTS", F.lit(50)))
    return said.select(key, "pos", "content", "anchor", F.inline(F.array_compact(F.array(*rows))))


def best_insights(df: DataFrame, key: str) -> DataFrame:
    """One row per category and content, the most important, then the first."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key, "category", "content").orderBy(F.desc("importance"), F.asc("pos")))).where("__n = 1").drop("__n")


def insight_summary(df: DataFrame, key: str, sections: int = 12) -> DataFrame:
    """Counts by category and the first distinct sections in order."""
    total = df.groupBy(key).agg(F.count("*").alias("total_items"), F.slice(F.array_distinct(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "anchor"))), lambda x: x.anchor.isNotNull()), lambda x: x.anchor)), 1, sections).alias("key_sections"))
    counts = df.groupBy(key, "category").count().groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("category_counts"))
    return total.join(counts, key)


def scoring_items(said: DataFrame, key: str, totals: DataFrame | None = None, keywords: Sequence[str] = SCORING, kinds: lx.Lexicon = SCORE_KINDS) -> DataFrame:
    """Scored sentences, their kind and weight, score / total (totals: key, total; 100 where absent)."""
    c, score = F.col("content"), score_of(F.col("content"))
    own = numbered(said.where(lx.any_of(c, keywords) & score.isNotNull()), key, "SCR", 3).withColumn("max_score", score)
    own = own.join(totals, key, "left") if totals is not None else own.withColumn("total", F.lit(None).cast("double"))
    total = F.coalesce("total", F.lit(100.0))
    return own.select(key, "item_id", "pos", lx.first_match(c, kinds, "other").alias("category"), F.substring(c, 1, 300).alias("description"), "max_score", F.when(total > 0, F.col("max_score") / total).alias("weight"), "anchor")


def total_score(text: Column | str) -> Column:
    """The full mark that a text names."""
    return F.nullif(F.regexp_extract(tx.text(text), r"满分\D{0,5}(\d+(?:\.\d+)?)\s*分", 1), F.lit("")).cast("double")


def preliminary_items(said: DataFrame, key: str, disqualify: Sequence[str] = DISQUALIFY, must: Sequence[str] = lx.MUST, more: Sequence[str] = PRELIMINARY) -> DataFrame:
    """Candidate clauses with strength and whether failing one is fatal."""
    c = F.col("content")
    hard, kind = lx.any_of(c, disqualify), strength(F.col("content"))
    kept = said.where((F.length("content") >= 8) & (hard | lx.any_of(c, must) | lx.any_of(c, more)))
    return numbered(kept, key, "PRE", 3).select(key, "item_id", "pos", F.substring(c, 1, 500).alias("clause_text"), kind.alias("clause_strength"), (kind.isin("DISQUALIFY", "REJECT") | hard).alias("fatal_if_unmet"), cross_references(c).alias("cross_refs"))


def technical_requirements(said: DataFrame, key: str, keywords: Sequence[str] = TECHNICAL, power: str = POWER, must: Sequence[str] = lx.MUST, kinds: lx.Lexicon = TECH_KINDS) -> DataFrame:
    """Technical sentences, or must sentences about power works, with kind, voltage, type and how deviations are tracked."""
    c = F.col("content")
    is_must = lx.any_of(c, must)
    kept = said.where((F.length("content") >= 10) & (lx.any_of(c, keywords) | (c.rlike(power) & is_must)))
    volts = F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s*[kK][vV]", 1), F.lit(""))
    return numbered(kept, key, "TECH", 3, "req_id").select(key, "req_id", "pos", lx.first_match(c, kinds, "general").alias("category"), F.substring(c, 1, 500).alias("description"), is_must.alias("is_mandatory"), F.concat(volts, F.lit("kV")).alias("voltage_level"), F.nullif(F.regexp_extract(c, PROJECTS, 1), F.lit("")).alias("engineering_type"), F.when(is_must, "mandatory_response").otherwise("optional_response").alias("deviation_tracking"), "anchor")


def compliance_items(said: DataFrame, key: str, disqualify: Sequence[str] = DISQUALIFY, must: Sequence[str] = lx.MUST, detailed: Sequence[str] = DETAILED) -> DataFrame:
    """Clauses checked at the preliminary or the detailed stage."""
    c = F.col("content")
    hard, kind = lx.any_of(c, disqualify), strength(c)
    kept = said.where((F.length("content") >= 8) & (hard | lx.any_of(c, must) | lx.any_of(c, detailed)))
    return numbered(kept, key, "CMP", 3).select(key, "item_id", "pos", F.substring(c, 1, 500).alias("clause_text"), F.when(hard | kind.isin("DISQUALIFY", "REJECT"), "preliminary").otherwise("detailed").alias("check_type"), F.lit("PENDING").alias("status"), kind.alias("risk_note"))


def key_personnel(said: DataFrame, key: str, roles: lx.Lexicon = ROLES, certificates: str = CERTIFICATES) -> DataFrame:
    """Each role's first sentence with its certificate, months of social security, years of experience and whether other projects are ruled out."""
    c = F.col("content")
    found = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(r)) for r, p in roles]))
    own = said.where(F.length("content") >= 10).select(key, "pos", "content", F.explode(found).alias("role"))
    first = own.withColumn("__n", F.row_number().over(W.partitionBy(key, "role").orderBy("pos"))).where("__n = 1")
    number = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    return first.select(key, "role", F.nullif(F.regexp_extract(c, certificates, 1), F.lit("")).alias("cert_required"), c.rlike("无在建|不得.*在建|在建工程.*[为是].*[零0无]").alias("no_active_project"), number(r"社保\D{0,6}(\d+)\s*个?月").alias("social_security_months"), number(r"(\d+)\s*年.*(?:工作经验|从业经[历验]|工程经验)").alias("min_experience_years"), F.substring(c, 1, 300).alias("source_clause"))


def format_signature(said: DataFrame, key: str) -> DataFrame:
    """Copies, binding, and in order of first appearance the seals, signature pages and envelopes, and up to 20 format clauses."""
    c = F.col("content")
    get = lambda p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    paper = F.coalesce(get(r"正本\D{0,3}(\d+)\s*份"), get(r"(?:共|合计|一式)\D{0,3}(\d+)\s*份")).cast("int")
    disks = F.coalesce(get(r"电子[版本副]\D{0,3}(\d+)\s*[份套]"), get(r"U盘\D{0,3}(\d+)\s*[份个套]")).cast("int")
    seal, page, cover = "(公章|法[人定]代表.*签[字章]|授权代表.*签[字章]|骑缝章|财务章|合同章|投标专用章|电子签章|加盖.*章|盖章)", "(签字盖章页|法定代表人.*页|授权委托书|开标一览表|投标函)", "(密封|封装|信封|外包装|标[书]?袋|技术标.*商务标.*分[开别]密封)"
    form = lx.any_of(c, ("格式要求", "编排要求", "字体", "字号", "页码", "目录", "页眉", "页脚", "纸张", "A4", "A3", "份数", "装订", "密封"))
    rows = said.select(key, "pos", paper.alias("paper"), disks.alias("disks"), get("(胶装|装订|活页|骑马钉|线装|精装|平装|密封)").alias("binding"), *[F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias(n) for n, p in (("seals", seal), ("pages", page), ("covers", cover))], F.when(form, F.substring(c, 1, 200)).alias("clause"))
    first = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), F.col("pos")))
    ordered = lambda n: F.transform(F.array_sort(F.collect_list(F.struct("pos", n))), lambda x: x[n])
    return rows.groupBy(key).agg(first("paper").alias("paper_copies"), first("disks").alias("electronic_copies"), first("binding").alias("binding_method"), *[F.array_distinct(F.flatten(ordered(n))).alias(o) for n, o in (("seals", "seal_requirements"), ("pages", "signature_pages"), ("covers", "envelope_requirements"))], F.slice(F.array_compact(ordered("clause")), 1, 20).alias("format_clauses"))


def facts(df: DataFrame, key: str, text: str = "text", patterns: lx.Lexicon = FACTS) -> DataFrame:
    """(key, field, value) of each field's first match, trimmed; voltages without spaces, bonds in units."""
    t = tx.text(text)
    found = F.array(*[F.struct(F.lit(n).alias("field"), F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit("")).alias("value")) for n, p in patterns])
    own = df.select(key, F.inline(found)).where("value is not null")
    return own.withColumn("value", F.when(F.col("field") == "voltage_level", F.replace("value", F.lit(" "), F.lit(""))).when(F.col("field") == "bid_bond_amount", (F.try_to_number("value", F.lit("999999999999.999999")) * 10000).cast("double").cast("string")).otherwise(F.col("value")))


def merge_facts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a's facts, and b's where a has none."""
    return a.join(b.withColumnRenamed("value", "__b"), [key, "field"], "full_outer").select(key, "field", F.coalesce("value", "__b").alias("value"))


def fact_conflicts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Fields that both have with values that differ, trimmed."""
    return a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), [key, "field"]).where(F.trim("left") != F.trim("right")).select(key, "field", "left", "right")


def risk_scan(df: DataFrame, key: str, text: str = "text", patterns: Sequence[tuple] = RISKS, rejection: str = REJECTION, advice: str = ADVICE) -> DataFrame:
    """(key, pattern_id, category, risk, start, clause): patterns whose keyword the text has, refined by their regex; advice nearby makes it WARN, else rejection FATAL."""
    t = tx.text(text)
    rows = []
    for name, category, risk, keywords, regex in patterns:
        first = F.coalesce(*[F.nullif(F.instr(t, F.lit(k)), F.lit(0)) for k in keywords])
        fine = F.nullif(F.regexp_instr(t, F.lit(regex)), F.lit(0)) if regex else F.lit(None).cast("int")
        clause = F.coalesce(F.nullif(F.regexp_extract(t, regex, 0), F.lit("")) if regex else F.lit(None).cast("string"), F.trim(F.substring(t, F.greatest(first - 60, F.lit(1)), F.least(first - 1, F.lit(60)) + 60)))
        at = F.coalesce(fine, first)
        around = F.substring(t, F.greatest(at - 100, F.lit(1)), F.least(at - 1, F.lit(100)) + 200)
        graded = F.when(around.rlike(advice), "WARN").when(around.rlike(rejection), "FATAL").otherwise(risk)
        rows.append(F.when(first.isNotNull(), F.struct(F.lit(name).alias("pattern_id"), F.lit(category).alias("category"), graded.alias("risk"), (at - 1).alias("start"), F.substring(clause, 1, 300).alias("clause"))))
    return df.select(key, F.inline(F.array_compact(F.array(*rows))))


def deviations(df: DataFrame, category: str = "category", mandatory: str = "is_mandatory", commercial: Sequence[str] = ("commercial", "pricing", "schedule")) -> DataFrame:
    """Which table a requirement goes to, and the risk of deviating from it."""
    return df.withColumns({"table": F.when(F.col(category).isin(*commercial), "commercial").otherwise("technical"), "deviation_risk": F.when(F.col(mandatory), "high").otherwise("low")})


def blueprint(items: DataFrame, technical: DataFrame, key: str, big: float = 15) -> DataFrame:
    """Two P00 tasks for each document, a P01 (score of at least `big`) or P02 task per scored item, and one P01 task for its mandatory technical requirements."""
    keys = items.select(key).unionByName(technical.select(key)).distinct()
    fixed = keys.select(key, F.inline(F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(s).alias("source")) for p, s in (("P00", "qualification"), ("P00", "format"))])))
    scored = items.select(key, F.when(F.col("max_score") >= big, "P01").otherwise("P02").alias("priority"), F.col("item_id").alias("source"))
    must = technical.where("is_mandatory").select(key, F.lit("P01").alias("priority"), F.lit("technical").alias("source")).distinct()
    return fixed.unionByName(scored).unionByName(must).withColumn("task_no", F.row_number().over(W.partitionBy(key).orderBy("priority", "source")))


def scorecard(tables: DataFrame, key: str, table: str = "table_md", skip: int = 2) -> DataFrame:
    """(key, item_no, name, score) of the rows below each table's header: the first cell, and the second's digits; and the document's total."""
    rows = tables.select(key, "table_no", F.posexplode(tx.table_rows(table)).alias("r", "cells")).where((F.col("r") >= skip) & (F.size("cells") >= 2))
    digits = F.try_to_number(F.nullif(F.regexp_replace(F.get("cells", F.lit(1)), r"[^0-9.]", ""), F.lit("")), F.lit("999999999.999999")).cast("double")
    own = rows.select(key, F.row_number().over(W.partitionBy(key).orderBy("table_no", "r")).alias("item_no"), F.get("cells", F.lit(0)).alias("name"), F.coalesce(digits, F.lit(0.0)).alias("score"))
    return own.withColumn("total", F.sum("score").over(W.partitionBy(key)))


def conditions(df: DataFrame, key: str, order: str, text: str, keywords: Sequence[str] = DISQUALIFY, kinds: Sequence[tuple[str, tuple[str, ...]]] = CONDITIONS, strong: str = "废标|否决投标|取消投标资格|取消中标资格|无效投标|投标无效") -> DataFrame:
    """Distinct sentences with a keyword, in order, with strength and the kind that has most of its words (ties: declaration order; none: the last kind)."""
    said = df.select(key, order, F.posexplode(tx.sentences(text)).alias("s", "content")).where(lx.any_of(F.col("content"), keywords))
    first = said.withColumn("__n", F.row_number().over(W.partitionBy(key, "content").orderBy(order, "s"))).where("__n = 1")
    hits = [F.struct(F.size(lx.all_hits(F.col("content"), w)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, w) in enumerate(kinds)]
    best = F.greatest(*hits)
    n = F.row_number().over(W.partitionBy(key).orderBy(order, "s"))
    return first.select(key, F.format_string("DQ-%03d", n).alias("condition_id"), "content", F.when(F.col("content").rlike(strong), "DISQUALIFY").otherwise("REJECT").alias("strength"), F.when(best.n > 0, best.k).otherwise(kinds[-1][0]).alias("category"))


def condition_coverage(conditions: DataFrame, sections: DataFrame, key: str, text: str = "text", words: str = "words", kind_words: str = "kind_words", window: int = 30) -> DataFrame:
    """Each condition (with its own and its kind's words) against its document's sections: covered by any own word, else by two of the kind's; with a snippet."""
    met = conditions.join(sections, key)
    t = tx.text(text)
    own = F.filter(F.col(words), lambda w: F.contains(t, w))
    kind = F.filter(F.col(kind_words), lambda w: F.contains(t, w))
    hit = F.when(F.size(own) > 0, F.get(own, F.lit(0))).when(F.size(kind) >= 2, F.get(kind, F.lit(0)))
    at = F.instr(t, hit)
    return met.withColumns({"covered": hit.isNotNull(), "snippet": F.when(hit.isNotNull(), F.substring(t, F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)) + F.length(hit) + window))})


def coverage_metrics(df: DataFrame, key: str, condition: str = "condition_id") -> DataFrame:
    """Share of conditions that any section covers (1 if there are none), how many are missing, and how many of those disqualify."""
    one = df.groupBy(key, condition).agg(F.bool_or("covered").alias("c"), F.first("strength").alias("s"))
    return one.groupBy(key).agg(F.round(F.coalesce(F.avg(F.col("c").cast("int")), F.lit(1.0)), 4).alias("rate"), F.count_if(~F.col("c")).alias("missing"), F.count_if(~F.col("c") & (F.col("s") == "DISQUALIFY")).alias("fatal_missing"))


def section_route(df: DataFrame, title: str, weight: str, critical: Sequence[str], most: float = 0.7) -> DataFrame:
    """Sections that are critical by weight or title get the strong plan."""
    hot = (F.coalesce(F.col(weight), F.lit(0.0)) >= most) | lx.any_of(F.lower(tx.text(title)), critical)
    return df.withColumns({"critical": hot, "plan": F.when(hot, "strong").otherwise("default")})


def section_kind(title: Column, text: Column, kinds: Sequence[tuple[str, Sequence[str]]] = SECTION_KINDS, default: str | None = None) -> Column:
    """The first kind with a keyword in the title, else in the text; case does not count."""
    out = F.lit(default)
    for c in (text, title):
        for name, words in reversed(list(kinds)):
            out = F.when(lx.any_of(F.lower(tx.text(c)), words), F.lit(name)).otherwise(out)
    return out


def outline(df: DataFrame, key: str, code: str = "requirement_id", default: str = "general") -> DataFrame:
    """Requirements by anchor, sections numbered by first appearance."""
    g = df.groupBy(key, F.coalesce(F.nullif(F.trim("anchor"), F.lit("")), F.lit(default)).alias("title")).agg(F.min("pos").alias("p"), F.transform(F.array_sort(F.collect_list(F.struct("pos", code))), lambda x: x[code]).alias("codes"))
    return g.select(key, F.format_string("S-%03d", F.row_number().over(W.partitionBy(key).orderBy("p"))).alias("section_id"), "title", "codes")


def above_fact(c: Column, fact: Column, pattern: str = r"(\d+(?:\.\d+)?)\s*[kK][vV]") -> Column:
    """The numbers a text names that are over the fact."""
    return F.filter(F.transform(F.regexp_extract_all(tx.text(c), F.lit(pattern), F.lit(1)), lambda x: x.cast("double")), lambda v: v > fact)


def unknown_references(c: Column, known: Column, pattern: str = r"((?:GB|DL|JGJ|NB|IEC|IEEE|Q/GDW)(?:/T)?\s*[-/]?\s*\d{3,6}(?:[-—.]\d{2,4})?)") -> Column:
    """Standards a text refers to that are not in known; separators do not count."""
    bare = lambda x: F.regexp_replace(F.upper(x), r"[\s\-—/.]", "")
    return F.filter(F.array_distinct(F.regexp_extract_all(tx.text(c), F.lit(pattern), F.lit(1))), lambda r: ~F.exists(known, lambda k: F.contains(bare(k), bare(r)) | F.contains(bare(r), bare(k))))


def dispatch(model: DataFrame, rules: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, status): rows of the model where there are any, else of the rules, else NEED_HUMAN_INPUT."""
    a, b = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((model, "m"), (rules, "r")))
    return docs.select(key).join(a, key, "left").join(b, key, "left").select(key, F.when(F.col("m"), "MODEL").when(F.col("r"), "RULES").otherwise("NEED_HUMAN_INPUT").alias("status"))


def payload_rows(df: DataFrame, key: str, items: str) -> DataFrame:
    """Rows of an array of (code, text), default codes by place, without empty texts."""
    own = df.select(key, F.posexplode(items).alias("i", "x"))
    return own.select(key, F.coalesce(F.nullif(F.trim("x.code"), F.lit("")), F.format_string("REQ-%04d", F.col("i") + 1)).alias("code"), F.trim("x.text").alias("text")).where("text <> ''")
