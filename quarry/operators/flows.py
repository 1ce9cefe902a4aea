"""Compositions of operators that a user starts as one: upload, analysis, multi-query retrieval, reuse of stored results.

Each takes DataFrames of many documents, so one plan serves a whole batch; rows carry their document in every key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx
from quarry.operators import chunking as ch
from quarry.operators import extract as ex
from quarry.operators import guard as gd
from quarry.operators import retrieval as rt
from quarry.operators import structure as sx


class Ingested(NamedTuple):
    documents: DataFrame
    sections: DataFrame
    chunks: DataFrame


def ingest(
    docs: DataFrame,
    key: str,
    as_of: str,
    text: str = "text",
    separator: str = r"\n{2,}",
    heading: Callable[[Column], Column] | None = None,
    guard: Callable[[DataFrame, str], DataFrame] = gd.pricing_signals,
    types: lx.Lexicon = lx.SECTION_TYPES,
    tokens: tuple[int, int, int] = (800, 1200, 120),
    expires: str | None = None,
) -> Ingested:
    """Documents with their metadata, lifecycle and whether prices block them; of the others, labelled sections and chunk records.

    Documents whose date `expires` is before as_of are kept and marked, as are blocked ones; null and empty texts have no sections.
    """
    judged = guard(docs, text).withColumn("lifecycle", rt.expiry(F.col(expires), as_of) if expires else F.lit("unknown"))
    documents = sx.metadata(judged, text)
    is_heading = heading or (lambda c: F.when(tx.is_heading(c), F.substring(c, 1, 48)))
    open_ = documents.where("not blocked").select(key, text)
    blocks = sx.paragraph_blocks(open_, [key], text, separator).withColumn("heading", is_heading(F.col("content")))
    kind = F.when(tx.is_markdown_table("content"), "TABLE").otherwise("PARAGRAPH")
    placed = sx.sections(sx.carry_anchor(blocks.withColumn("block_type", kind), [key], ["block_no"]), [key])
    at = [key, "section_id"]
    title = placed.groupBy(*at).agg(F.min_by("anchor", "block_no").alias("title"))
    sections = sx.labels(sx.section_texts(placed, at).join(title, at), "title", "text", types)
    cut = ch.greedy_chunks(placed, at, "block_no", F.col("block_no"), "content", *tokens)
    chunks = ch.chunk_records(cut.join(sections.select(*at, "section_type", "risk_level"), at), key, "section_id", F.lit("text"), "chunk_no")
    return Ingested(documents, sections, chunks)


# Importances of parsed requirements.
REQUIREMENT_BASE = {"bidding": 58, "scoring": 60, "must": 75, "bonus": 70, "risk": 80}


def requirement_insights(requirements: DataFrame, key: str, rules: dict[str, str] = ex.INSIGHTS, base: dict[str, int] | None = None, power: str | None = ex.POWER) -> DataFrame:
    """Insights of parsed requirements: base scores of their own, asking for a format is bidding, and a row for those of no kind."""
    rules = rules | {"bidding": f"{rules['bidding']}|格式"}
    return ex.line_insights(requirements, key, rules, base or REQUIREMENT_BASE, power, default=True)


class Analysed(NamedTuple):
    documents: DataFrame
    requirements: DataFrame
    insights: DataFrame
    summary: DataFrame


def analyse(docs: DataFrame, key: str, text: str = "text", guard: Callable[[DataFrame, str], DataFrame] = gd.pricing_signals, rules: dict[str, str] = ex.INSIGHTS, power: str | None = ex.POWER, must: Sequence[str] = lx.MUST, more: Sequence[str] | None = None) -> Analysed:
    """Pages (parted by form feeds) past the guard; their requirements, insights of lines and of requirements, and a summary a document."""
    judged = guard(docs, text)
    said = ex.sentences(judged.where("not blocked"), key, text)
    found = ex.requirements(said, key, must) if more is None else ex.requirements(said, key, must, more)
    lines = ex.line_insights(said, key, rules, power=power)
    insights = ex.best_insights(lines.unionByName(requirement_insights(found, key, rules, power=power).select(*lines.columns)), key)
    return Analysed(judged, found, insights, ex.insight_summary(insights, key))


def retrieve_parts(requirements: DataFrame, chunks: DataFrame, key: str, text: str, as_of: str, k: int = 5, rewrite: Callable[[Column], Column] = tx.squash, **parts) -> DataFrame:
    """C20: every requirement's parts (C18), rewritten by the seam, searched as one batch (C16) and merged (C21): key, chunk_id, position, score, covers.

    parts: arguments of retrieval.decompose.
    """
    subs = rt.decompose(requirements, key, text, **parts)
    asked = subs.select(key, "sub_no", F.concat_ws("#", F.col(key).cast("string"), F.col("sub_no").cast("string")).alias("query_id"), rewrite(F.col("description")).alias("query"))
    hits = rt.search(asked.select("query_id", "query"), chunks, as_of, k).join(asked.select(key, "sub_no", "query_id"), "query_id")
    return rt.merge_hits(hits, [key])


def reuse(work: DataFrame, keys: Sequence[str], make: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """What `make` gives for work, by keys (such as outline, section, gate), from the table at `path` where it is stored already; what was missing is made and added.

    A key is made once however often work repeats it; a run that stops before its write leaves nothing, and is made anew. Rows carry the
    run that made them: where two runs at once made a key, all read the rows of the same one of them. Keys may be null.
    """
    spark = work.sparkSession
    one = work.dropDuplicates(list(keys))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        one = _meet(one, spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    make(one).withColumn("__run", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    first = stored.groupBy(*keys).agg(F.min("__run").alias("__first"))
    return _meet(_meet(stored, first, keys, "inner").where("__run = __first").drop("__run", "__first"), work.select(*keys).distinct(), keys, "left_semi")


def _meet(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join in which null keys are equal; a's key columns stay."""
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [a[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])
