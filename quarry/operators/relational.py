"""Relational queries (R1-R30): scoped joins, filtered counts, lists with clamped limits, upserts, change sets.

Operators take DataFrames and return DataFrames; the reference date is always a parameter. Lists have a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp(n: int, most: int, least: int = 1) -> int:
    return max(least, min(int(n), most))


def scoped(docs: DataFrame, sources: DataFrame, project: object = None, tag: str | None = None, source_key: str = "source_id", project_col: str = "project_id", tag_col: str = "tag") -> DataFrame:
    """Docs, joined to their sources only where a project is asked for, and filtered by tag only where one is."""
    if project is not None:
        docs = docs.join(sources.where(F.col(project_col) == F.lit(project)).select(source_key), source_key, "left_semi")
    return docs if tag is None else docs.where(F.col(tag_col) == F.lit(tag))


def quality_totals(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", quality: str = "quality", tags: str = "tags", low: float = 60.0, tag: str = "PRICING_RELATED", approximate: bool = False) -> DataFrame:
    """R2-R5 in one pass: distinct documents, chunks, their mean quality, how many are below low, how many carry the tag."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    q = F.col(quality).cast("double")
    return docs.select(key).join(chunks, key, "left").agg(distinct(key).alias("docs"), F.count(quality).alias("chunks"), F.round(F.avg(q), 4).alias("avg_quality"), F.count_if(q < low).alias("low_quality"), F.count_if(F.array_contains(tags, tag)).alias("tagged"))


def with_counts(docs: DataFrame, parts: DataFrame, key: str, part: str, newest: str, keep: Sequence[str], limit: int = 50, most: int = 200) -> DataFrame:
    """Docs with the number of their parts (0 too), newest first."""
    counts = parts.groupBy(key).agg(F.count(part).alias("parts"))
    return docs.join(counts, key, "left").select(key, *keep, F.coalesce("parts", F.lit(0)).cast("long").alias("parts")).orderBy(F.desc(newest), F.asc(key)).limit(clamp(limit, most))


def listing(df: DataFrame, order: Sequence[Column], where: Column | None = None, limit: int = 50, most: int = 200) -> DataFrame:
    """An optional filter, an order and a clamped limit."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(clamp(limit, most))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def valid_assets(df: DataFrame, kinds: Sequence[str], as_of: str, kind: str = "doc_type", until: str = "valid_to", more: Column | None = None) -> DataFrame:
    """Kinds still valid after as_of, the longest valid first."""
    out = df.where(F.col(kind).isin(list(kinds)) & (F.col(until) > F.lit(as_of).cast("date")))
    return (out if more is None else out.where(more)).orderBy(F.desc(until), F.xxhash64(*df.columns))


def asset_pool(df: DataFrame, project: object, owners: Sequence[str] | None = None, asset_type: str | None = None) -> DataFrame:
    """A project's assets, by owner and by a field of their JSON metadata, compared trimmed and in lower case."""
    out = df.where(F.col("project_id") == F.lit(project))
    if owners:
        out = out.where(F.col("ownership_role").isin(list(owners)))
    return out if asset_type is None else out.where(F.lower(F.trim(F.get_json_object("metadata", "$.asset_type"))) == asset_type.strip().lower())


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """The number that a key's next version gets."""
    return df.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base with the rows of changes put in place of those of equal keys, and the rest added. Keys are not null, and unique on each side."""
    a, b, out = base.alias("a"), changes.alias("b"), []
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    there = F.col(f"b.{keys[0]}").isNotNull()
    for c in base.columns:
        out.append(F.coalesce(f"a.{c}", f"b.{c}").alias(c) if c in keys else F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) if c in changes.columns else F.col(f"a.{c}"))
    return a.join(b, on, "full_outer").select(*out)


def update_where(df: DataFrame, ids: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Rows whose key is in ids get new values; the others stay."""
    hit = F.col("__hit").isNotNull()
    marked = df.join(ids.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return marked.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def not_expired(df: DataFrame, as_of: str, until: str = "expires", status: str = "status", active: str = "active") -> DataFrame:
    """Active, and without expiry or not before as_of."""
    return df.where((F.col(status) == active) & (F.col(until).isNull() | (F.col(until) >= F.lit(as_of).cast("date"))))


def active_versions(df: DataFrame, code: str, value: object, year: str, status: str = "status", active: str = "active") -> DataFrame:
    """A code's active versions, latest year first."""
    return df.where((F.col(code) == F.lit(value)) & (F.col(status) == active)).orderBy(F.desc(year), F.xxhash64(*df.columns))


def insert_missing(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new, once per key, whose key base does not have."""
    return new.dropDuplicates(list(keys)).join(base.select(*keys).distinct(), list(keys), "left_anti")


def by_codes(sections: DataFrame, requirements: DataFrame, codes: str, code: str) -> DataFrame:
    """Each section with the requirements that its array of codes names, once each."""
    return sections.withColumn(code, F.explode(F.array_distinct(codes))).join(requirements, code)


def validated(df: DataFrame, results: Sequence[str] = ("WON", "LOST"), result: str = "result", date: str = "date", project: str = "project") -> DataFrame:
    """The rows with normalised result, project (blank: null) and date, and `error`, null for accepted rows."""
    norm, when = F.upper(F.trim(F.col(result))), F.nullif(F.trim(F.col(date)), F.lit(""))
    day = F.try_to_timestamp(when, F.lit("yyyy-MM-dd")).cast("date")
    error = F.when(~F.coalesce(norm.isin(list(results)), F.lit(False)), "bad result").when(when.isNotNull() & day.isNull(), "bad date")
    return df.select("*", norm.alias("result_norm"), day.alias("date_norm"), F.nullif(F.trim(F.col(project)), F.lit("")).alias("project_norm"), error.alias("error"))


def evidence_row(df: DataFrame, template: str, columns: Sequence[str], missing: str = "unknown") -> DataFrame:
    """A formatted text per record; empty fields as `missing`."""
    return df.withColumn("evidence", F.format_string(template, *[F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(missing)) for c in columns]))


def call_log(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Rows ready to append: the prompt's sha256 instead of the prompt."""
    return df.withColumn("prompt_sha256", F.sha2(F.col(prompt), 256)).drop(prompt)


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """For each key of either side, the sorted names of the fields that differ (null equals null)."""
    a, b = old.alias("a"), new.alias("b")
    names = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), names.alias("changed")).where(F.size("changed") > 0)
