"""Matching, scoring and gating."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx
from quarry.operators.fuzzy import best_team
from quarry.operators.retrieval import expiry
from quarry.operators.relational import latest


def coverage(requirement: Column, section: Column) -> Column:
    """(supported, confidence): shared words from .4 on; else a Han phrase; else two Han pairs; else .15 shared words with 120 characters."""
    r, s = tx.text(requirement), tx.text(section)
    own = F.array_distinct(tx.tokens(r))
    share = F.when(F.size(own) > 0, F.size(F.array_intersect(own, tx.tokens(s))) / F.size(own)).otherwise(0.0)
    han = tx.cjk(r)
    phrase = F.exists(F.regexp_extract_all(r, F.lit("[一-鿿]{2,8}"), F.lit(0)), lambda p: F.contains(s, p))
    pairs = (F.length(han) >= 4) & (F.size(F.filter(tx.bigrams(han), lambda p: F.contains(s, p))) >= 2)
    sure = F.when(F.trim(s) == "", 0.0).when(share >= 0.4, F.least(F.lit(0.9), 0.55 + share * 0.5)).when(phrase, 0.65).when(pairs, 0.6).when((F.length(F.trim(s)) >= 120) & (share >= 0.15), 0.55).otherwise(0.0)
    return F.struct((sure > 0).alias("supported"), F.round(sure, 4).alias("confidence"))


def simulated_score(requirements: DataFrame, sections: DataFrame, reports: DataFrame, project: str = "project_id") -> DataFrame:
    """each requirement's status and points.

    requirements: project, code, weight, text; sections: project, section_key, codes, content, created_at (the last section that names a code has it); reports:
    project, section_key, status, issues (array of struct(code, description)), created_at (the latest counts).
    """
    held = sections.select(project, "section_key", "content", "created_at", F.explode("codes").alias("code"))
    own = latest(held, [project, "code"], [F.desc("created_at"), F.desc("section_key")]).drop("created_at")
    last = latest(reports, [project, "section_key"], [F.desc("created_at")]).select(project, "section_key", F.col("status").alias("r_status"), "issues")
    both = requirements.join(own, [project, "code"], "left").join(last, [project, "section_key"], "left")
    hit = F.filter("issues", lambda i: i.code == F.col("code"))
    status = F.when(F.col("section_key").isNull(), "UNPLANNED").when(F.col("r_status").isNull(), "UNREVIEWED").when(F.col("r_status") == "PASS", "PASS").when(F.exists("issues", lambda i: i.code == "PARSE_ERROR"), "ERROR").when(F.size(hit) > 0, "FAIL").otherwise("PASS")
    weight = F.coalesce(F.col("weight"), F.lit(0.0))
    cover = coverage(F.col("text"), F.col("content"))
    return both.select(project, "code", "section_key", weight.alias("weight"), status.alias("status"), F.when(status == "PASS", weight).otherwise(0.0).alias("score"), F.when(status == "FAIL", F.get(hit, F.lit(0)).description).alias("reason"), F.when(status == "UNREVIEWED", cover.confidence).alias("confidence"))


def score_totals(scored: DataFrame, project: str = "project_id") -> DataFrame:
    """points, possible points and percentage of each project."""
    return scored.groupBy(project).agg(F.round(F.sum("score"), 4).alias("total"), F.round(F.sum("weight"), 4).alias("possible"), F.round(F.coalesce(F.try_divide(F.sum("score"), F.sum("weight")), F.lit(0.0)) * 100, 2).alias("percent"))


def score_points(points: DataFrame) -> DataFrame:
    """points (item_id, max_score, point_id, weight, cov, evi, spec, risk, negative_deviation, arithmetic_conflict) with their score and the reason for a deduction."""
    weight = F.greatest(F.col("weight").cast("double"), F.lit(0.0))
    raw = 0.55 * F.col("cov") + 0.25 * F.col("evi") + 0.20 * F.col("spec") - 0.50 * F.col("risk")
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    hard = F.when(F.col("negative_deviation"), "negative_deviation").when(F.col("arithmetic_conflict"), "arithmetic_conflict")
    return points.select("*", F.when(hard.isNotNull(), 0.0).otherwise(weight * unit).alias("point_score"), F.coalesce(hard, F.when((unit <= 0) & (weight > 0), "normalized_clamped_to_zero")).alias("deduction"), weight.alias("deducted"))


def score_items(points: DataFrame) -> DataFrame:
    """each item's score, at most its max_score, and what that took off."""
    one = score_points(points).groupBy("item_id").agg(F.sum("point_score").alias("s"), F.max("max_score").alias("max_score"), F.count("deduction").alias("deductions"))
    return one.select("item_id", F.round(F.least("s", "max_score"), 6).alias("score"), F.round(F.greatest(F.col("s") - F.col("max_score"), F.lit(0.0)), 6).alias("clamped"), "deductions")


def redline(parameters: DataFrame, key: str) -> DataFrame:
    """findings for provided values below the required ones (P0); rows (key, rule_id, severity, message)."""
    bad = parameters.where(F.col("provided_value") < F.col("required_value"))
    return bad.select(key, F.lit("PARAM-BELOW").alias("rule_id"), F.lit("P0").alias("severity"), F.concat_ws(" ", "parameter_name", F.col("provided_value").cast("string"), F.lit("<"), F.col("required_value").cast("string")).alias("message"))


def redline_status(subjects: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """BLOCKED with a P0 finding, NEED_FIX with a P1, else PASS."""
    worst = findings.groupBy(key).agg(F.min("severity").alias("worst"), F.count("*").alias("findings"))
    return subjects.select(key).distinct().join(worst, key, "left").select(key, F.when(F.col("worst") == "P0", "BLOCKED").when(F.col("worst") == "P1", "NEED_FIX").otherwise("PASS").alias("status"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def readiness(required: DataFrame, provided: DataFrame, key: str, document: str = "document") -> DataFrame:
    """each key's missing documents, sorted."""
    gone = required.select(key, document).distinct().join(provided.select(key, document).distinct(), [key, document], "left_anti")
    return gone.groupBy(key).agg(F.array_sort(F.collect_set(document)).alias("missing"))


def duration_findings(df: DataFrame, key: str, start: str = "start_date", end: str = "completion_date", committed: str = "committed_days", least: str = "min_days") -> DataFrame:
    """(key, issue): dates that don't parse, are reversed, don't match the committed days, or leave fewer or more days than asked for."""
    day = lambda c: F.try_to_timestamp(F.col(c).cast("string"), F.lit("yyyy-MM-dd")).cast("date")
    bad = F.lit(False)
    for c in (start, end):
        bad = bad | (F.col(c).isNotNull() & day(c).isNull())
    span = F.datediff(day(end), day(start))
    days = F.coalesce(F.col(committed), span)
    found = F.array(F.when(bad, "INVALID_DATE"), F.when(span < 0, "REVERSED"), F.when((span >= 0) & (F.col(committed) != span), "MISMATCH"), F.when(days > F.col(least), "OVER_REQUIRED"))
    return df.select(key, F.explode(F.array_compact(found)).alias("issue"))


def full_review(requirements: DataFrame, sections: DataFrame, project: str = "project_id") -> DataFrame:
    """codes, missing codes, coverage and score (coverage in percent) of each project."""
    have = sections.select(project, F.explode("codes").alias("code")).groupBy(project).agg(F.collect_set("code").alias("have"))
    need = requirements.groupBy(project).agg(F.array_sort(F.collect_set("code")).alias("need"))
    both = need.join(have, project, "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    share = F.size(F.array_intersect("need", "have")) / F.size("need")
    return both.select(project, F.size("need").alias("codes"), F.array_sort(F.array_except("need", "have")).alias("missing"), F.round(share, 4).alias("coverage"), F.round(share * 100, 2).alias("score"))


def triage(df: DataFrame, status: str = "status", severities: str = "severities", inconsistencies: Column | None = None, coverage_col: str = "coverage") -> DataFrame:
    """REWRITE, REVIEW or PASS."""
    c, has = F.coalesce(F.col(coverage_col), F.lit(1.0)), lambda s: F.coalesce(F.exists(severities, lambda x: F.lower(x) == s), F.lit(False))
    odd = F.coalesce(inconsistencies if inconsistencies is not None else F.lit(0), F.lit(0)) > 0
    st = F.upper(F.coalesce(F.col(status), F.lit("")))
    return df.withColumn("tier", F.when((st == "FAIL") | has("high") | (c < 0.75), "REWRITE").when(has("medium") | odd | (st == "WARN") | (c < 0.90), "REVIEW").otherwise("PASS"))


def candidates(pool: DataFrame, roles: DataFrame, project: str = "project_id") -> DataFrame:
    """F8: (project, slot, role, asset, score): people of the pool who hold the role, with enough months and, where asked, no active project.

    pool: project, asset_id, roles (array), months, active, match_score; roles: project, slot, role, min_months, no_active.
    """
    met = roles.join(pool.select(project, "asset_id", F.explode(F.array_distinct("roles")).alias("role"), "months", "active", "match_score"), [project, "role"])
    return met.where((F.coalesce("months", F.lit(0)) >= F.coalesce("min_months", F.lit(0))) & ~(F.col("no_active") & (F.coalesce("active", F.lit(0)) > 0))).select(project, "slot", "role", "asset_id", F.coalesce("match_score", F.lit(0.0)).alias("score"))


def team(found: DataFrame, roles: DataFrame, project: str = "project_id") -> DataFrame:
    """(project, slot, role, asset_id, score), asset_id null for roles that stay open. A project's slots and people are few; projects are the parallelism."""
    options = found.groupBy(project, "slot").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("asset_id").cast("long").alias("asset_id")))).alias("options"))
    asked = roles.select(project, "slot", "role").join(options, [project, "slot"], "left")

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("slot")
        given = {int(s): [(-o["o"], o["asset_id"]) for o in x] if x is not None else [] for s, x in zip(b["slot"], b["options"], strict=True)}
        got = best_team([int(s) for s in b["slot"]], given)
        return pd.DataFrame({project: b[project], "slot": b["slot"], "role": b["role"], "asset_id": pd.array([got.get(int(s), (None,))[0] for s in b["slot"]], dtype="Int64"), "score": [got[int(s)][1] if int(s) in got else 0.0 for s in b["slot"]]})

    kinds = dict(roles.dtypes)
    return asked.groupBy(project).applyInPandas(solve, f"{project} {kinds[project]}, slot {kinds['slot']}, role string, asset_id long, score double")


def staff_checks(pool: DataFrame, subjects: DataFrame, key: str, least_months: int = 6) -> DataFrame:
    """findings for conflicts (active projects), too few months, missing authorisation and empty pools; pool: key, active, months, authorized."""
    def one(cond: Column, rule: str, severity: str) -> DataFrame:
        return pool.where(cond).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "n")

    none = subjects.select(key).distinct().join(pool, key, "left_anti").select(key, F.lit("POOL-EMPTY").alias("rule_id"), F.lit("P1").alias("severity"), F.lit(0).cast("long").alias("n"))
    return one(F.col("active") > 0, "STAFF-CONFLICT", "P0").unionByName(one(F.coalesce("months", F.lit(0)) < least_months, "STAFF-MONTHS", "P1")).unionByName(one(~F.coalesce("authorized", F.lit(False)), "AUTH-MISSING", "P0")).unionByName(none)


def override(base: DataFrame, addenda: DataFrame, code: str = "clause_code", text: str = "clause_text") -> DataFrame:
    """clauses with their latest addendum's text where there is one, and the clauses only addenda have. addenda: code, text, issued."""
    norm = F.upper(F.regexp_replace(code, r"\s+", ""))
    last = latest(addenda.withColumn("__c", norm), ["__c"], [F.desc("issued")]).select("__c", F.col(text).alias("__t"))
    return base.withColumn("__c", norm).join(last, "__c", "full_outer").select(F.col("__c").alias(code), F.coalesce("__t", text).alias(text), F.col("__t").isNotNull().alias("overridden"))


def stale_chapters(addenda: DataFrame, chapters: DataFrame, impacted: str = "impacted", chapter: str = "chapter", version: str = "version") -> DataFrame:
    """chapters' latest versions, stale where an addendum names the chapter."""
    hit = addenda.select(F.explode(F.array_distinct(impacted)).alias(chapter)).distinct().withColumn("__hit", F.lit(True))
    return latest(chapters, [chapter], [F.desc(version)]).join(hit, chapter, "left").select("*", F.coalesce("__hit", F.lit(False)).alias("stale")).drop("__hit")


def gates(df: DataFrame, least: float = 0.95) -> DataFrame:
    """status and reason from evidence_count, unsupported_count, mapped, total and must."""
    share = F.when(F.col("total") > 0, F.col("mapped") / F.col("total")).otherwise(0.0)
    reason = F.when(F.col("evidence_count") == 0, "missing_evidence_ids").when(F.col("unsupported_count") > 0, "unsupported_sentences").when(share < least, "coverage_below_threshold").when(F.col("must") & (share < 1), "must_clause_coverage_insufficient")
    return df.withColumns({"coverage": F.when(F.col("evidence_count") == 0, 0.0).when(F.col("unsupported_count") > 0, 0.0).otherwise(F.round(share, 4)), "reason": reason, "status": F.when(reason.isNull(), "SUPPORTED").otherwise("NEED_HUMAN_INPUT")})


def missing_numbers(requirement: Column, generated: Column) -> Column:
    """numbers with units that the requirement has and the text has not."""
    own = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(tx.text(c), F.lit(r"(\d+(?:\.\d+)?\s*(?:kV|KV|MVA|MW|kW|mm2|mm²|m/s|℃|天|日|基|台|套|km|米|m))"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", "")))
    return F.array_except(own(requirement), own(generated))


def missing_elements(expected: Column, generated: Column) -> Column:
    """expected elements that the text does not name."""
    t = F.lower(tx.text(generated))
    return F.filter(expected, lambda e: ~F.contains(t, F.lower(e)))


def profile_chain(policies: DataFrame, defaults: DataFrame, project: str, task: str) -> DataFrame:
    """(project, task, place, provider, model): the project's chain, or the default, each provider and model once, in order. chain: array of struct(provider, model)."""
    both = policies.join(defaults.select(task, F.col("chain").alias("__d")), task, "full_outer")
    return both.select(project, task, F.posexplode(F.array_distinct(F.coalesce(F.when(F.size("chain") > 0, F.col("chain")), F.col("__d")))).alias("place", "p")).select(project, task, "place", "p.provider", "p.model")


def vote(reports: DataFrame, key: str) -> DataFrame:
    """majority status (ties: the better one), the best report (quality, status, first), distinct issues and mean coverage. reports: key, idx, status, quality, coverage, issues."""
    status = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    rank = F.when(status == "PASS", 3).when(status == "WARN", 2).when(status == "FAIL", 1).otherwise(0)
    own = reports.withColumns({"__s": status, "__r": rank})
    counts = own.where("__s <> ''").groupBy(key, "__s", "__r").count().groupBy(key).agg(F.max_by("__s", F.struct("count", "__r")).alias("status"))
    rest = own.groupBy(key).agg(F.max_by("idx", F.struct(F.col("quality"), F.col("__r"), -F.col("idx"))).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"), F.round(F.avg("coverage"), 4).alias("coverage"))
    return rest.join(counts, key, "left").select(key, F.coalesce("status", F.lit("FAIL")).alias("status"), "best", "issues", "coverage")


def compliance_quality(status: Column, cover: Column, issues: Column, missing: Column, risks: Column) -> Column:
    """F16."""
    points = F.when(F.upper(status) == "PASS", 22.0).when(F.upper(status) == "WARN", 12.0).when(F.upper(status) == "FAIL", 0.0).otherwise(6.0)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cover, F.lit(0.0))))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), unit * 78 + points - F.least(F.lit(36.0), issues * 4.0 + missing * 3.0 + risks))), 2)


def knowledge_quality(completeness: Column, days: Column, reliability: Column) -> Column:
    """recency halves in a year."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (0.40 * unit(completeness) + 0.30 * F.exp(-0.693 * F.greatest(days, F.lit(0)) / 365) + 0.30 * unit(reliability)))), 2)


expiry_status = expiry  # F18


def review_sample(df: DataFrame, key: str, ratio: float = 0.15) -> DataFrame:
    """rows for manual review, about that share, the same ones each time."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(max(0.0, min(1.0, ratio)) * 10_000))


def fatal_gate(items: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """blocked where fatal items need a kind of asset (needs) that the key has none of; reasons sorted. assets: key, kind."""
    have = assets.select(key, F.col("kind").alias("needs")).distinct()
    gone = items.where("fatal").select(key, "needs").distinct().join(have, [key, "needs"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("needs")).alias("reasons"))
    return items.select(key).distinct().join(gone, key, "left").select(key, F.col("reasons").isNotNull().alias("blocked"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def foreign_assets(used: DataFrame, pool: DataFrame, project: str, asset: str) -> DataFrame:
    """assets a project uses that are not its own; none means isolation holds."""
    return used.select(project, asset).distinct().join(pool.select(project, asset), [project, asset], "left_anti")


def requirement_strength(c: Column, must: Sequence[str] = lx.MUST) -> Column:
    """F22."""
    return F.when(lx.any_of(c, must), "MUST").when(c.rlike(lx.SCORE), "SCORE").when(F.contains(c, F.lit("格式")), "FORMAT").otherwise("OTHER")


def profile_score(cases: DataFrame, key: str, least: float = 80.0) -> DataFrame:
    """weighted share of passed cases in percent, and whether it qualifies."""
    w = F.col("weight")
    share = F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("passed"), w).otherwise(0.0)), F.sum(w)), F.lit(0.0)) * 100, 2)
    return cases.groupBy(key).agg(share.alias("score")).withColumn("qualified", F.col("score") >= least)


def unbound(used: Column, allowed: Column) -> Column:
    """evidence ids that a block may not use."""
    return F.array_except(used, allowed)


def repaired_json(c: Column) -> Column:
    """the outermost braces of a model's answer without fences and trailing commas."""
    inner = F.regexp_extract(F.regexp_replace(tx.text(c), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), r"(?s)\{.*\}", 0)
    return F.nullif(F.regexp_replace(inner, r",\s*([}\]])", "$1"), F.lit(""))


def parsed_answer(c: Column, schema: str, other: str | None = None, convert=None) -> Column:
    """a repaired answer by its schema, or by another one, converted."""
    own = F.from_json(repaired_json(c), schema)
    return own if other is None else F.coalesce(own, convert(F.from_json(repaired_json(c), other)))


def generation_status(binding: Column, expired: Column, conflict: Column, disqualified: Column, status: Column) -> Column:
    """what stands in the way, in this order, else the given status."""
    need = F.lit("NEED_HUMAN_INPUT")
    return F.struct(F.when(binding | expired | conflict | disqualified, need).otherwise(status).alias("status"), F.when(binding, "binding").when(expired, "expired").when(conflict, "conflict").when(disqualified, "disqualify").alias("cause"))


def token_limits(df: DataFrame, caps: DataFrame, kind: str = "section_type", tokens: str = "tokens", default: int = 2000, hard: float = 1.5) -> DataFrame:
    """over the type's cap is a warning, over `hard` times it is cut."""
    cap = F.coalesce("cap", F.lit(default))
    return df.join(caps, kind, "left").withColumn("limit_status", F.when(F.col(tokens) > cap * hard, "TRUNCATE").when(F.col(tokens) > cap, "WARN").otherwise("OK"))


def lock_scorecard(df: DataFrame, project: str, requested: str, approved: str, locked: str) -> DataFrame:
    """the lock's result: project mismatch, approval needed, already locked, or locked."""
    return df.withColumn("lock_result", F.when(F.col(project) != F.col(requested), "PROJECT_MISMATCH").when(F.col(locked), "ALREADY_LOCKED").when(~F.col(approved), "APPROVAL_REQUIRED").otherwise("LOCKED"))


def admit_override(requests: DataFrame, findings: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """overrides are admitted where there is a P0 finding and an audit row."""
    p0 = findings.where("severity = 'P0'").select(key).distinct().withColumn("__p", F.lit(True))
    au = audits.select(key).distinct().withColumn("__a", F.lit(True))
    return requests.join(p0, key, "left").join(au, key, "left").withColumn("admitted", F.coalesce(F.col("__p") & F.col("__a"), F.lit(False))).drop("__p", "__a")


def content_or(generated: Column, blocks: Column, fallback: Column) -> Column:
    """the generated text, else the blocks' texts, else the fallback."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(generated), blank(F.array_join(F.filter(blocks, lambda b: F.trim(b) != ""), "\n\n")), fallback)
