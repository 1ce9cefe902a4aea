"""Blocks, sections, labels and versions.

A document's blocks and sections are rows; what depends on their order is a window over the document. A document is the unit that
must fit a task, as it is read as one text anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx


def paragraph_blocks(df: DataFrame, key: Sequence[str], text: str = "text", separator: str = r"\n{2,}") -> DataFrame:
    """B1: blocks (key, block_no, content, char_start, char_end, block_type, heading); offsets run over the blocks, one apart."""
    parts = df.select(*key, F.posexplode(tx.pieces(text, separator)).alias("block_no", "content"))
    before = W.partitionBy(*key).orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0))
    first = F.trim(F.regexp_extract("content", r"^\s*([^\n]*)", 1))
    return parts.select(*key, "block_no", "content", start.alias("char_start"), (start + F.length("content")).alias("char_end"), F.when(tx.looks_like_table("content"), "TABLE").otherwise("PARA").alias("block_type"), F.when(tx.is_heading(first), F.substring(first, 1, 48)).alias("heading"))


def carry_anchor(df: DataFrame, key: Sequence[str], order: Sequence[str], heading: str = "heading", default: str | None = None) -> DataFrame:
    """B2: anchor, the last heading at or before a row of the same key."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("anchor", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(default)))


def sections(blocks: DataFrame, key: Sequence[str], order: str = "block_no", anchor: str = "anchor", page: str | None = None, default: str = "untitled") -> DataFrame:
    """Blocks with the section they are in: a new one begins where the anchor changes. Adds section_id, block_id, first and last page."""
    own = F.coalesce(F.nullif(F.trim(anchor), F.lit("")), F.lit(default))
    w = W.partitionBy(*key).orderBy(order)
    kept = blocks.where(F.trim(tx.text("content")) != "").withColumn("anchor", own)
    new = (F.col("anchor") != F.lag("anchor").over(w)) | F.lag("anchor").over(w).isNull()
    n = kept.withColumn("__new", new.cast("int")).withColumn("__s", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    each = W.partitionBy(*key, "block_type").orderBy(order)
    in_section = W.partitionBy(*key, "__s")
    number = F.col(page) if page else F.lit(1)
    kind = F.when(F.col("block_type") == "TABLE", "T").otherwise("B")
    return n.select(*[c for c in kept.columns], F.format_string("S%03d", "__s").alias("section_id"), F.concat(kind, F.format_string("%03d", F.row_number().over(each))).alias("block_id"), F.min(number).over(in_section).alias("page_start"), F.max(number).over(in_section).alias("page_end"))


def sectionize(df: DataFrame, key: str, text: str = "text", anchor: str = tx.ANCHOR, preamble: str = "preamble") -> DataFrame:
    """(key, section_no, anchor, title, content): breaks are numbered headings and Markdown headings of level 1 and 2; lines before
    the first are the preamble; sections without content are dropped. A text with any line that is not blank has a section, so none needs to
    be taken whole; a null or blank one has none."""
    lines = df.select(key, F.posexplode(F.split(tx.text(text), "\n")).alias("line_no", "line"))
    stripped = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    marks = F.length(F.regexp_extract(stripped, r"^(#{1,6})\s+\S", 1))
    title = F.trim(F.regexp_replace(stripped, r"^#{1,6}\s+", ""))
    numbered = stripped.rlike(anchor)
    breaks = (stripped != "") & (numbered | ((marks >= 1) & (marks <= 2)))
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    opened = F.when(breaks, F.struct(F.substring(stripped, 1, 64).alias("anchor"), F.substring(F.when(marks > 0, title).otherwise(stripped), 1, 64).alias("title")))
    grouped = lines.select(key, "line_no", "line", F.sum(breaks.cast("int")).over(w).alias("n"), F.last(opened, ignorenulls=True).over(w).alias("o"))
    joined = grouped.groupBy(key, "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("content"), F.first("o", ignorenulls=True).alias("o"))
    body = F.regexp_replace("content", r"^\s+|\s+$", "")
    found = joined.select(key, "n", F.coalesce("o.anchor", F.lit(preamble)).alias("anchor"), F.coalesce("o.title", F.lit(preamble)).alias("title"), body.alias("content")).where("content <> ''")
    return found.select(key, (F.row_number().over(W.partitionBy(key).orderBy("n")) - 1).alias("section_no"), "anchor", "title", "content")


def table_islands(df: DataFrame, key: str, text: str = "text", least: int = 2) -> DataFrame:
    """(key, table_no, first_line, rows, table_md) of runs of at least `least` lines with a pipe."""
    lines = df.select(key, F.posexplode(F.split(tx.text(text), "\n")).alias("line_no", "line")).where(F.contains("line", F.lit("|")))
    island = F.col("line_no") - F.row_number().over(W.partitionBy(key).orderBy("line_no"))
    runs = lines.withColumn("i", island).groupBy(key, "i").agg(F.min("line_no").alias("first_line"), F.count("*").alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x.line)), "\n").alias("table_md")).where(F.col("rows") >= least)
    return runs.select(key, F.row_number().over(W.partitionBy(key).orderBy("first_line")).alias("table_no"), "first_line", "rows", "table_md")


def table_summary(df: DataFrame, text: str = "table_md", types: lx.Lexicon = lx.TABLE_TYPES, default: str = "其他", most: int = 12) -> DataFrame:
    """table_type, key_columns (the first row's cells) and row_estimate (rows below it)."""
    rows = tx.table_rows(text)
    return df.withColumns({"table_type": lx.first_match(tx.text(text), types, default), "key_columns": F.slice(F.filter(F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")), lambda c: c != ""), 1, most), "row_estimate": F.greatest(F.size(rows) - 1, F.lit(0))})


def labels(df: DataFrame, title: str, text: str, types: lx.Lexicon = lx.SECTION_TYPES, disciplines: lx.Lexicon = lx.DISCIPLINES, phases: lx.Lexicon = lx.PHASES, hint: str | None = None) -> DataFrame:
    """section_type, discipline, project_phase, flags for score and compliance items, risk level and reusability."""
    body = tx.text(text)
    scope = F.concat_ws("\n", tx.text(title), body)
    hinted = F.concat_ws("\n", body, tx.text(hint)) if hint else body
    score, rules = hinted.rlike(lx.SCORE), hinted.rlike(lx.COMPLIANCE)
    kind = lx.first_match(F.concat_ws("\n", tx.text(title), hinted), types, "其他")
    risk = F.when(rules & body.rlike(lx.HARD), "high").when(rules, "medium").when(score, "low").otherwise("none")
    return df.withColumns({"section_type": kind, "discipline": lx.first_match(scope, disciplines, "综合"), "project_phase": lx.first_match(scope, phases, "投标文件"), "contains_score_items": score, "contains_compliance_items": rules, "risk_level": risk, "reusability": F.when(body.rlike(lx.LOCAL), "low").when(kind.isin(*lx.REUSABLE), "high").otherwise("medium")})


def topics(c: Column | str, names: Sequence[str] = lx.TOPICS, most: int = 10) -> Column:
    """Topics whose first two characters the text contains."""
    t = tx.text(c)
    return F.slice(F.filter(F.array(*[F.lit(x) for x in names]), lambda x: F.contains(t, F.substring(x, 1, 2))), 1, most)


def frequent_keywords(df: DataFrame, key: str, text: str = "text", stop: Sequence[str] = (), k: int = 8, pattern: str = r"[\p{L}\p{N}_]{2,}") -> DataFrame:
    """Each document's k most frequent words without stop words; ties go to the earlier first appearance."""
    own = df.select(key, F.posexplode(F.regexp_extract_all(F.lower(tx.text(text)), F.lit(pattern), F.lit(0))).alias("pos", "word"))
    if stop:
        own = own.where(~F.col("word").isin(list(stop)))
    counts = own.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "pos"))).where(F.col("rank") <= k).select(key, "rank", "word", "n")


def enhance(df: DataFrame, title: str, text: str, keywords: Column, most: int = 160) -> DataFrame:
    """Summary (cut with dots) and confidence, .85 with keywords and .70 without."""
    flat = F.trim(F.replace(F.regexp_replace(tx.text(text), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")))
    return df.withColumns({"summary": F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat), "confidence": F.when(F.size(keywords) > 0, 0.85).otherwise(0.70)})


def merge_meta(df: DataFrame, text: str, least: int = 200, note: str = "信息不足", most: int = 600) -> DataFrame:
    """Short sections are marked as insufficient, with confidence at most .5."""
    short = F.length(F.trim(tx.text(text))) < least
    summary = F.substring(F.when(short, F.trim(F.concat_ws(" ", "summary", F.lit(note)))).otherwise(F.col("summary")), 1, most)
    return df.withColumns({"summary": summary, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(short, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence"))))})


def risk_review(df: DataFrame, text: str, strong: float = 0.75, quote: str = lx.QUOTES, most: int = 3, length: int = 80) -> DataFrame:
    """Sections to review, with up to three quotes; confidence up by .08 with quotes and down by .2 without."""
    high = F.col("risk_level") == "high"
    own = F.slice(F.transform(F.filter(tx.sentences(text), lambda s: s.rlike(quote)), lambda s: F.substring(s, 1, length)), 1, most)
    head = F.substring(F.trim(tx.text(text)), 1, length)
    quotes = F.when((F.size(own) == 0) & high & (head != ""), F.array(head)).otherwise(own)
    needs = F.col("contains_compliance_items") | high | (F.col("contains_score_items") & (F.col("confidence") < strong))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.when(F.size(quotes) > 0, 0.08).otherwise(-0.2)))
    return df.where(needs).select("*", quotes.alias("quotes"), F.round(moved, 4).alias("review_confidence"), (F.col("contains_compliance_items") | F.col("risk_level").isin("high", "medium")).alias("is_compliance_critical"))


def merge_sections(structure: DataFrame, meta: DataFrame, risk: DataFrame, key: Sequence[str]) -> DataFrame:
    """Structure with its meta and risk rows where there are any."""
    return structure.join(meta, list(key), "left").join(risk, list(key), "left")


def exceptions(df: DataFrame, key: Sequence[str], low: float = 0.6, most_pages: int = 20) -> DataFrame:
    """(key, issue, detail, action) rows; df has confidence, page_start, page_end and empty_tables (an array of ids)."""
    pages = F.greatest(F.lit(1), F.col("page_end") - F.col("page_start") + 1)
    one = lambda issue, detail, action: F.struct(F.lit(issue).alias("issue"), detail.alias("detail"), F.lit(action).alias("action"))
    found = F.concat(
        F.array_compact(F.array(F.when(F.col("confidence") < low, one("LOW_CONFIDENCE", F.format_string("confidence=%.2f", F.col("confidence").cast("double")), "HUMAN_REVIEW")), F.when(pages > most_pages, one("SECTION_TOO_LONG", F.concat(F.lit("pages="), pages.cast("string")), "REPARSE_OR_SPLIT")))),
        F.transform(F.coalesce("empty_tables", F.array().cast("array<string>")), lambda t: one("TABLE_EMPTY", F.concat(F.lit("table_id="), t), "REEXTRACT_TABLE")),
    )
    return df.select(*key, F.inline(found))


def section_texts(blocks: DataFrame, key: Sequence[str], order: str = "block_no") -> DataFrame:
    """Each section's text, tables as rows joined by pipes."""
    said = F.when(F.col("block_type") == "TABLE", F.array_join(F.transform(tx.table_rows("content"), lambda r: F.array_join(r, " | ")), "\n")).otherwise(F.col("content"))
    return blocks.select(*key, F.col(order).alias("__o"), said.alias("__t")).where(F.trim("__t") != "").groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__t"))), lambda x: x["__t"]), "\n").alias("text"))


def metadata(df: DataFrame, text: str = "text", head: int = 8000) -> DataFrame:
    """voltage_level_kv (the first known one, else the first), project_type, core_equipment and region from the first `head` characters."""
    t = F.substring(tx.text(text), 1, head)
    volts = F.transform(F.regexp_extract_all(t, F.lit(r"(\d{1,9}(?:\.\d+)?)\s*[kK][vV]"), F.lit(1)), lambda x: x.cast("double").cast("int"))
    known = F.filter(volts, lambda v: v.isin(*lx.VOLTAGES))
    return df.withColumns({"voltage_level_kv": F.coalesce(F.get(known, F.lit(0)), F.get(volts, F.lit(0))), "project_type": lx.first_match(t, lx.PROJECT_TYPES, None), "core_equipment": lx.all_hits(t, lx.EQUIPMENT), "region": F.nullif(F.regexp_extract(t, "|".join(lx.REGIONS), 0), F.lit(""))})


def fill_gaps(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """a's fields, and b's where a's are null, zero or empty."""
    x, y = a.alias("a"), b.alias("b")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "[]")
    return x.join(y, key, "left").select(key, *[F.when(empty(f"a.{f}"), F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in fields])


STANDARD = r"(?i)(GB|GB/T|DL|DL/T|JGJ|JB|NB|NB/T|SL|YD|HJ|CJJ|JT|Q/GDW|CECS|IEEE|IEC)\s*[-/]?\s*(\d{3,6})"


def standards(df: DataFrame, text: str = "text", head: int = 2000, within: int = 30) -> DataFrame:
    """standard_code, the first in the text's head, and version_year, a year within the next characters."""
    t = F.substring(tx.text(text), 1, head)
    code = F.concat(F.regexp_extract(t, STANDARD, 1), F.regexp_extract(t, STANDARD, 2))
    rest = F.regexp_extract(t, rf"(?s){STANDARD}(.{{0,{within}}})", 3)
    year = F.nullif(F.regexp_extract(rest, r"[-—./\s]*((?:19|20)\d{2})\b", 1), F.lit(""))
    return df.withColumns({"standard_code": F.nullif(F.upper(F.replace(code, F.lit(" "), F.lit(""))), F.lit("")), "version_year": year.cast("int")})


def supersede(df: DataFrame, code: str, year: str, status: str = "status", active: str = "active") -> DataFrame:
    """Status deprecated for active versions older than their code's latest, and is_latest."""
    top = F.max(F.when(F.col(status) == active, F.col(year))).over(W.partitionBy(code))
    return df.withColumns({"is_latest": F.col(year) >= F.coalesce(top, F.col(year)), status: F.when((F.col(status) == active) & (F.col(year) < top), "deprecated").otherwise(F.col(status))})


def lifecycle_valid(expiration: Column, valid_to: Column, as_of: str) -> Column:
    """Neither date is before as_of."""
    day = F.lit(as_of).cast("date")
    return ~(F.coalesce(expiration < day, F.lit(False)) | F.coalesce(valid_to < day, F.lit(False)))
