"""Rules held as data, and compiled to expressions.

A lexicon is a sequence of (name, pattern) in order of priority; a keyword list is a sequence of strings. Domain lexicons are for
Chinese tender documents; each operator takes its lexicon as a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Lexicon = Sequence[tuple[str, str]]

# The domain's rules. The first rule that matches wins.
SECTION_TYPES: Lexicon = (
    ("报价说明", "报价|价格|金额|清单计价"), ("进度计划", "进度|工期|里程碑|节点计划"), ("安全文明施工", "安全|文明施工|应急"), ("质量保证", "质量|质保|检验"),
    ("施工组织", "施工组织|施工方案|工艺|资源配置"), ("资质文件", "资质|资格|证书"), ("业绩材料", "业绩|案例|类似项目"), ("合同条款响应", "合同|条款|偏差|响应|废标|否决|合规"),
    ("商务部分", "商务|投标函|服务承诺"), ("技术方案", "技术|参数|方案"),
)
DISCIPLINES: Lexicon = (("电气", "电力|电气|变电|输电|配电"), ("土建", "土建|建筑|地基|混凝土|砌筑|路基"), ("暖通", "暖通|空调|通风"), ("给排水", "给排水|管网|污水|供水"), ("通信", "通信|信号|弱电|网络"), ("结构", "钢结构|结构设计|受力"))
PHASES: Lexicon = (("竣工资料", "竣工|移交|归档资料"), ("施工组织设计", "施工组织|施工方案"), ("施工规范", "施工规范|验收规范|国家标准"), ("通用规范", "通用规范|行业通则"))
TABLE_TYPES: Lexicon = (("人员简历", "姓名|职务|证书|年龄"), ("设备清单", "设备|规格|型号|数量"), ("业绩", "业绩|合同金额|完工"), ("进度计划", "工期|进度|计划"), ("技术参数对照", "参数|对照|指标"), ("报价", "报价|金额|单价|总价"), ("制度流程", "制度|流程|职责"))
SCORE, COMPLIANCE, HARD, LOCAL = "评分|得分|分值|加分|扣分", "必须|应当|不得|否决|废标|强制|不响应", "废标|否决|强制|不得", "本项目|本工程|本标段|具体地址|具体业主"
REUSABLE = ("安全文明施工", "质量保证", "施工组织", "技术方案")
QUOTES = "评分|得分|分值|必须|否决|废标|响应|条款"
TOPICS = ("评分标准", "技术评分点", "工期得分", "业绩加分", "人员得分")
STRENGTHS: Lexicon = (
    ("DISQUALIFY", "废标|否决投标|取消投标资格|取消中标资格|无效投标|投标无效|不予通过|拒绝投标"),
    ("REJECT", "拒绝|不予受理|不予接收|实质性偏离|重大偏差|不具备资格|资质不符"),
    ("DEDUCT", "扣分|扣减|罚款|处罚|违约金|每延误|每日罚|逾期罚"),
)
SUB_REQUIREMENTS: Lexicon = (("QUALIFICATION", "资质|资格|许可证|承装修试|等级"), ("PERFORMANCE", "业绩|案例|类似工程|合同"), ("TECH_PARAM", "参数|容量|电压|截面|型号|规格|kV|MVA|MW"), ("PERSONNEL", "人员|项目经理|建造师|工程师|持证"), ("MUST", "必须|应当|不得|须|严禁"))
MUST = ("必须", "应当", "不得", "需", "必须满足")
CONTINUATIONS = ("且", "并", "及", "以及", "同时", "另外")
PROJECT_TYPES: Lexicon = (("新建", "新建"), ("改造", "改造"), ("扩建", "扩建"), ("业扩配电", "业扩"), ("改造", "技改|迁改"), ("扩建", "增容"))
EQUIPMENT = ("变压器", "开关柜", "电缆", "断路器", "隔离开关", "互感器", "电容器", "避雷器", "母线", "GIS", "充电桩", "箱变", "环网柜", "配电柜", "接地装置", "电抗器", "刀闸", "熔断器", "继电保护", "无功补偿")
REGIONS = ("北京", "天津", "上海", "重庆", "河北", "山西", "辽宁", "吉林", "黑龙江", "江苏", "浙江", "安徽", "福建", "江西", "山东", "河南", "湖北", "湖南", "广东", "海南", "四川", "贵州", "云南", "陕西", "甘肃", "青海", "台湾", "内蒙古", "广西", "西藏", "宁夏", "新疆")
VOLTAGES = (10, 20, 35, 66, 110, 220, 330, 500, 750, 1000)

#: Rules for the synthetic corpus, whose texts have none of the domain's words.
CORPUS_TYPES: Lexicon = (("license", "(?i)licen[sc]e"), ("secret", "(?i)(token|password|key) ?[=:]"), ("contact", "@|555-"), ("table", "\\|"), ("junk", "###|%%%|&&&|\\$\\$\\$"), ("german", " der | die | und "), ("french", " les | des | est "), ("spanish", " los | que | del "))


def first_match(c: Column, lexicon: Lexicon, default: str | None) -> Column:
    """The name of the first rule whose pattern the text contains."""
    out = F.lit(default)
    for name, pattern in reversed(list(lexicon)):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def any_of(c: Column, keywords: Sequence[str]) -> Column:
    """Does the text contain any keyword?"""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(c, F.lit(k))
    return out


def all_hits(c: Column, keywords: Sequence[str]) -> Column:
    """The keywords that the text contains, in the lexicon's order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(c, k))
