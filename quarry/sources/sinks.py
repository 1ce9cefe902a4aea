"""Sinks (S11-S17, S21): JSON, CSV, Markdown, keyed upserts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """JSON lines, in folders by the given columns."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S12."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def point_id(doc: Column, chunk: Column) -> Column:
    """The same id for the same document and chunk, shaped like a uuid."""
    h = F.sha1(F.encode(F.concat_ws(":", doc.cast("string"), chunk.cast("string")), "UTF-8"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def upserted(base: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of both, the latest by key."""
    both = base.unionByName(new, allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version), F.xxhash64(*both.columns)))).where("__n = 1").drop("__n")


def markdown_table(rows: Column) -> Column:
    """Rows (array of arrays) as a table, ragged ones padded; the first row is the header."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), wide)), F.lit(1), wide), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))
    body = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(rows), F.lit(1)))), "\n")).otherwise("")


def enhanced_markdown(sections: DataFrame, doc: str, order: str, title: str, meta: Sequence[str], text: str) -> DataFrame:
    """(doc, markdown): front matter and per section its heading, metadata and text, in order."""
    head = F.concat_ws("\n", *[F.concat_ws(": ", F.lit(f"- {m}"), F.col(m).cast("string")) for m in meta])
    one = F.concat_ws("\n", F.concat(F.lit("## "), F.col(title)), head, F.lit(""), tx.text(text))
    return sections.groupBy(doc).agg(F.concat_ws("\n\n", F.concat(F.lit("---\ndoc: "), F.first(F.col(doc).cast("string")), F.lit("\n---")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("s")))), lambda x: x.s), "\n\n")).alias("markdown"))


def asset_markdown(assets: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], empty: str = "none") -> DataFrame:
    """(key, markdown): a table of the key's assets, sorted; missing cells as `empty`."""
    cells = F.array(*[F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(empty)) for c in columns])
    own = assets.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("__c")))), lambda x: x["__c"]).alias("r"))
    return own.select(key, markdown_table(F.concat(F.array(F.array(*[F.lit(c) for c in columns])), F.col("r"))).alias("markdown"))


def document_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Blocks that may be rendered, and the others' reasons (see guard.text_policy)."""
    from quarry.operators.guard import text_policy

    return blocks.withColumn("reject_reason", text_policy(tx.text(text)))


def header_union(tables: DataFrame, key: str, row: str) -> DataFrame:
    """The sorted union of the columns of a key's rows (maps)."""
    return tables.select(key, F.explode(F.map_keys(row)).alias("h")).groupBy(key).agg(F.array_sort(F.collect_set("h")).alias("headers"))


def import_report(steps: DataFrame, key: str) -> DataFrame:
    """(key, report): steps, durations and files as JSON."""
    one = F.struct("no", "step", "status", F.round(F.col("ended").cast("double") - F.col("started").cast("double"), 3).alias("seconds"), "file")
    return steps.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("steps"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.array_sort(F.collect_set("file")).alias("files"))).alias("report"))


def chunk_rows(df: DataFrame, locator: Sequence[str], text: str = "text") -> DataFrame:
    """Chunks with their locator as one metadata column."""
    return df.select("chunk_id", F.col(text).alias("text"), F.to_json(F.struct(*locator)).alias("metadata"))
