"""Guards and redaction."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx

# Words and patterns of the price and personal-data guards.
HARD = ("投标报价", "报价表")
CONTEXT = ("单价", "合计", "税率", "含税", "不含税", "RMB", "¥", "元")
PRICING = ("单价", "合计", "总价", "金额", "报价", "费用", "造价", "预算", "结算", "措施费", "安措费", "调试费", "检测费", "监理费", "设计费", "勘察费", "临时用电费", "大型机具费")
NOT_MONEY = ("元件", "元素", "单元", "元旦", "元器件", "元年", "多元", "元数据")
TECHNICAL = ("施工方案", "施工组织", "安全施工", "安全方案", "安全管理", "安全生产", "质量保证", "质量管理", "质量控制", "质量体系", "环境保护", "环保方案", "水土保持", "进度计划", "工期保证", "资源配置", "技术方案", "技术路线", "调试方案", "带电作业", "应急预案", "文明施工", "职业健康")
AMOUNT = r"(?:¥|RMB|CNY)\s*\d+(?:[,，]\d{3})*(?:\.\d+)?|\d+(?:[,，]\d{3})*(?:\.\d+)?\s*(?:元|万元)"
MONEY = r"¥\s*\d|\d+(?:[,，]\d{3})*(?:\.\d+)?\s*(?:元|万元)|(?:RMB|CNY)\s*\d+(?:[,，]\d{3})*(?:\.\d+)?"
UNITS = r"\d+(?:\.\d+)?\s*(?:kV|KV|kv|MVA|MW|kW|kVA|kA|Hz|mm²|mm2|m/s|℃|Ω|MΩ)"
NUMBER = r"\d+(?:\.\d+)?"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9._%+-])"
# An address whatever stands beside it. Its name is a whole run of characters, or what the match before left of one, so no run is tried from each of its places.
ANY_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
ID_CARD = r"\b(\d{17}[\dXx])\b"
PERSONNEL = "项目经理|项目负责人|技术负责人|安全员|质量员|施工员|总工程师|副总工程师|专职安全员|总监理工程师|注册建造师|注册监理工程师|注册造价工程师|注册电气工程师"
ID_WEIGHTS, ID_CHECKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"
PARAMETER = r"([A-Za-z一-鿿]{1,12}\s*[:：]?\s*\d+(?:\.\d+)?\s*(?:ms|s|GB|TB|MB/s|Gbps|%|QPS|TPS|MHz|kW|℃)?)"


def near_amount(c: Column, keyword: str, money: str = MONEY, window: int = 20) -> Column:
    """Does any occurrence of the keyword have an amount within `window` characters? Exact: the text around each occurrence is cut out and searched."""
    if not keyword:
        return F.lit(False)
    parts = F.split(c, f"\\Q{keyword}\\E")
    # beyond so many parts, even if all are empty, the keywords between them fill the window
    m = window // len(keyword) + 1
    tail = lambda s: F.substring(s, F.greatest(F.length(s) - window + 1, F.lit(1)), F.lit(window))
    joined = lambda i, n: F.array_join(F.slice(parts, i, n), keyword)
    first = lambda i: F.greatest(i - m, F.lit(1))
    around = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(tail(joined(first(i), i - first(i) + 1)), F.lit(keyword), F.substring(joined(i + 1, F.lit(m + 1)), 1, window)))
    return (F.size(parts) > 1) & F.exists(around, lambda s: s.rlike(money))


def digit_density(c: Column, units: str = UNITS) -> Column:
    """(numbers without those with units, tokens, dense): at least ten and over .3 of the tokens (Han characters and word runs)."""
    numbers = F.regexp_count(F.regexp_replace(c, units, ""), F.lit(NUMBER))
    tokens = F.greatest(F.length(tx.cjk(c)) + F.regexp_count(c, F.lit(r"[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*")), F.lit(1))
    return F.struct(numbers.alias("numbers"), tokens.alias("tokens"), ((numbers >= 10) & (numbers / tokens > 0.3)).alias("dense"))


def pricing_signals(df: DataFrame, text: str = "text", hard: Sequence[str] = HARD, context: Sequence[str] = CONTEXT, pricing: Sequence[str] = PRICING, technical: Sequence[str] = TECHNICAL, amount: str = AMOUNT, money: str = MONEY) -> DataFrame:
    """hard_hit, near (keywords beside an amount), amount_hit, dense, and blocked: hard words alone; else two signals, or three if the text's head is technical."""
    c = tx.text(text)
    use = lambda k: ~lx.any_of(c, NOT_MONEY) if k == "元" else F.lit(True)
    near = F.array_compact(F.array(*[F.when(use(k) & F.contains(c, F.lit(k)) & near_amount(c, k, money), F.lit(k)) for k in context])) if context else F.array().cast("array<string>")
    own = df.withColumns({"hard_hit": lx.any_of(c, hard), "near": near, "amount_hit": c.rlike(amount) & lx.any_of(c, pricing), "dense": digit_density(c).dense})
    signals = (F.size("near") > 0).cast("int") + F.col("amount_hit").cast("int") + F.col("dense").cast("int")
    return own.withColumn("blocked", F.col("hard_hit") | (signals >= F.when(lx.any_of(F.substring(c, 1, 200), technical), 3).otherwise(2)))


def mask_ids(c: Column) -> Column:
    """E5: eighteen-digit identity numbers with a right checksum become stars."""
    def right(x: Column) -> Column:
        total = sum((F.substring(x, i + 1, 1).cast("int") * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
        return F.substring(F.lit(ID_CHECKS), (total % 11) + 1, F.lit(1)) == F.upper(F.substring(x, 18, 1))

    found = F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(ID_CARD), F.lit(1))), right)
    return F.aggregate(found, c, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"\b"), x, F.lit(r"\b")), F.lit("*" * 18)))


def mask_addresses(c: Column) -> Column:
    """E4's addresses alone, each of them: also one that runs on into other characters, which mask() leaves."""
    return F.regexp_replace(c, ANY_EMAIL, "***@***")


def mask(c: Column, exempt: str | None = PERSONNEL, window: int = 60) -> Column:
    """E-mail addresses, phones and identity numbers masked.

    With exempt, addresses and phones are kept where the text has an exempting word within `window` characters; as the exemption depends on
    offsets, it takes an Arrow-batched function. A phone's offset is that in the text whose addresses are masked already, looked up
    in the original: so after a masked address the window is off by the change in length. With exempt None all is built in.
    """
    if exempt is None:
        return mask_ids(F.regexp_replace(F.regexp_replace(tx.text(c), EMAIL, "***@***"), PHONE, "*" * 11))
    return mask_ids(_masked(exempt, window)(tx.text(c)))


def _masked(exempt: str, window: int):

    email, phone, keep = re.compile(EMAIL), re.compile(PHONE), re.compile(exempt)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            def near(m: re.Match, stars: str) -> str:
                return m[0] if keep.search(text, max(0, m.start() - window), min(len(text), m.start() + window)) else stars

            out = email.sub(lambda m: near(m, "***@***"), text) if "@" in text else text
            return phone.sub(lambda m: near(m, "*" * 11), out)

        return texts.map(one)

    return masked


def strategy(c: Column, kind: str = "mask", allowed: Sequence[str] = ()) -> Column:
    """Technical parameters: their numbers masked, kept where they hold an allowed word, or left to be filled in."""
    if kind == "local_fill":
        return F.regexp_replace(c, PARAMETER, "[LOCAL_FILL_REQUIRED]")
    head = r"[A-Za-z一-鿿]{1,12}\s*[:：]?\s*"
    if kind == "allowlist" and allowed:
        # a mark parts the number of an allowed segment from its name, so that the mask does not see it
        c = F.regexp_replace(c, rf"([A-Za-z一-鿿]*(?:{'|'.join(map(re.escape, allowed))})[A-Za-z一-鿿]*\s*[:：]?\s*)(?=\d)", "$1\u0001")
    return F.replace(F.regexp_replace(c, rf"({head})\d+(?:\.\d+)?", "$1***"), F.lit("\u0001"), F.lit(""))


def sanitize(df: DataFrame, text: str = "text", outbound: bool = True, kind: str = "mask", allowed: Sequence[str] = ()) -> DataFrame:
    """Sanitized, pricing_blocked and warnings; blocked texts are replaced, others masked and, going out, their parameters treated."""
    own = pricing_signals(df, text).withColumn("__m", mask(F.col(text)))
    masked = F.col("__m")
    treated = strategy(masked, kind, allowed) if outbound else masked
    warn = F.array_compact(F.array(F.when(F.col("blocked"), "pricing_blocked"), F.when(~F.col("blocked") & (masked != tx.text(text)), "pii_masked" if outbound else "pii_masked_inbound"), F.when(~F.col("blocked") & (treated != masked), f"sensitive_strategy_applied:{kind}")))
    return own.select(*df.columns, F.when(F.col("blocked"), "BLOCKED_PRICING_CONTENT").otherwise(treated).alias("sanitized"), F.col("blocked").alias("pricing_blocked"), warn.alias("warnings"))


def frozen_check(df: DataFrame, key: str, text: str, expected: DataFrame) -> DataFrame:
    """(key, block, issue): frozen blocks that are duplicated, missing or changed; expected has key, block and signature."""
    found = df.select(key, F.inline(tx.frozen(text))).select(key, F.col("key").alias("block"), "signature")
    twice = found.groupBy(key, "block").count().where("count > 1").select(key, "block", F.lit("DUPLICATE").alias("issue"))
    one = found.groupBy(key, "block").agg(F.first("signature").alias("got"))
    other = expected.join(one, [key, "block"], "left").where(~F.col("got").eqNullSafe(F.col("signature"))).select(key, "block", F.when(F.col("got").isNull(), "MISSING").otherwise("CHANGED").alias("issue"))
    return twice.unionByName(other)


def text_policy(c: Column) -> Column:
    """Why a text may not go into a rendered document: markup, page break, manual numbering; null if it may."""
    return F.when(c.rlike(r"<[A-Za-z/][^>]*>"), "markup").when(c.rlike(r"\f|\\page|\[PAGE_?BREAK\]"), "page_break").when(c.rlike(r"^\s*(?:第[一二三四五六七八九十0-9]+[章节]|\d+(?:\.\d+)+\s)"), "manual_numbering")


def safe_name(c: Column) -> Column:
    """Is an identifier safe as a file name?"""
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~F.contains(c, F.lit(".."))


def safe_path(c: Column) -> Column:
    """Does a relative path stay inside its folder?"""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    return ~c.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..") & (F.trim(c) != "")
