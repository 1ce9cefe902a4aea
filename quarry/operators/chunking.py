"""Token-bounded chunks (B19-B26): greedy buffers of blocks, tables split under their header, chunk records.

"Start anew when full" cannot be a window: each section's ordered blocks are folded with aggregate(), a table's rows with an Arrow-batched
function, inside one row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx

# Words of a parameter table's header.
PARAMETER_WORDS = ("型号", "容量", "电压", "参数", "规格", "额定", "功率", "电流", "阻抗", "频率")
_CHUNKS = "array<struct<text:string,first:int,last:int>>"


def greedy_fold(blocks: Column, least: int, most: int, overlap: int = 0) -> Column:
    """Chunks (text, first and last page) of an ordered array of structs (page, text): blocks gather until they have `least` words, never
    over `most`; a longer block is sliced by itself."""
    if overlap >= most:
        raise ValueError("overlap must be less than most")
    zero = F.struct(F.array().cast(_CHUNKS).alias("done"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<int>").alias("pages"), F.lit(0).alias("n"))

    def flushed(acc: Column) -> Column:
        one = F.struct(F.array_join(acc.parts, "\n\n").alias("text"), F.array_min(acc.pages).alias("first"), F.array_max(acc.pages).alias("last"))
        return F.when(F.size(acc.parts) > 0, F.concat(acc.done, F.array(one))).otherwise(acc.done)

    def buffer(done: Column, parts: Column, pages: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), parts.alias("parts"), pages.alias("pages"), n.alias("n"))

    none, no_pages = F.array().cast("array<string>"), F.array().cast("array<int>")

    def step(acc: Column, b: Column) -> Column:
        said, n, page = b.text, b.n, b.page
        sliced = F.transform(tx.slices(said, most, overlap), lambda t: F.struct(t.alias("text"), page.alias("first"), page.alias("last")))
        full = (acc.n > 0) & (acc.n + n > most)
        parts = F.when(full, F.array(said)).otherwise(F.concat(acc.parts, F.array(said)))
        pages = F.when(full, F.array(page)).otherwise(F.concat(acc.pages, F.array(page)))
        done, total = F.when(full, flushed(acc)).otherwise(acc.done), F.when(full, n).otherwise(acc.n + n)
        kept = buffer(done, parts, pages, total)
        return F.when(said == "", acc).when(n > most, buffer(F.concat(flushed(acc), sliced), none, no_pages, F.lit(0))).when(total >= least, buffer(flushed(kept), none, no_pages, F.lit(0))).otherwise(kept)

    clean = F.transform(blocks, lambda b: F.struct(b.page.cast("int").alias("page"), F.regexp_replace(tx.text(b.text), r"^\s+|\s+$", "").alias("text")))
    counted = F.transform(clean, lambda b: F.struct(b.page.alias("page"), b.text.alias("text"), tx.word_count(b.text).alias("n")))
    return F.aggregate(counted, zero, step, flushed)


def greedy_chunks(df: DataFrame, key: Sequence[str], order: str, page: Column, text: str, least: int = 800, most: int = 1200, overlap: int = 0) -> DataFrame:
    """(key, chunk_no, text, page_marker, tokens) of each key's blocks in order."""
    rows = df.select(*key, F.col(order).alias("__o"), page.cast("int").alias("page"), F.col(text).alias("text"))
    each = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__o", "page", "text"))).alias("b"))
    chunks = each.select(*key, F.posexplode(greedy_fold(F.col("b"), least, most, overlap)).alias("chunk_no", "c"))
    marker = F.when(F.col("c.first") == F.col("c.last"), F.col("c.first").cast("string")).otherwise(F.concat_ws("-", F.col("c.first").cast("string"), F.col("c.last").cast("string")))
    return chunks.select(*key, "chunk_no", F.col("c.text").alias("text"), marker.alias("page_marker"), tx.word_count("c.text").alias("tokens"))


def table_header(table: Column | str) -> Column:
    """The first row's cells, if it begins with a pipe."""
    first = F.trim(F.substring_index(F.trim(tx.text(table)), "\n", 1))
    cells = F.filter(F.transform(F.split(F.regexp_replace(first, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(F.startswith(first, F.lit("|")), cells).otherwise(F.array().cast("array<string>"))


def is_parameter_table(table: Column | str, words: Sequence[str] = PARAMETER_WORDS) -> Column:
    """B23."""
    return lx.any_of(F.array_join(table_header(table), ""), words)


def split_table(table: Column | str, most: int) -> Column:
    """The table's rows in groups of at most `most` words with the header, which begins each; one row at least in each.

    Which characters beyond ASCII are a word's is asked of Spark's own rule, as Python's tables are of another Unicode version.
    """
    t = F.btrim(tx.text(table), F.lit(" \t\n\u000b\f\r"))
    return F.coalesce(_grouped(most)(t, F.regexp_replace(t, r"[\x00-\x7F]+|[^\p{L}\p{N}]+", "")), F.array(tx.text(table)))


def _grouped(most: int):

    # Java's $ stands before a last line end too, of which a line can hold these
    rule = re.compile("\\|[-:| ]+\\|[\r\u0085\u2028\u2029]?")
    ascii_word = np.array([chr(i).isalnum() or chr(i) == "_" for i in range(128)] + [False])

    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    @F.pandas_udf("array<string>")
    def grouped(tables: pd.Series, letters: pd.Series) -> pd.Series:
        def one(table: str, beyond: str) -> list[str] | None:
            lines = table.split("\n")
            at = next((i for i, x in enumerate(lines) if i and rule.fullmatch(x.strip(" "))), None)
            if at is None:
                return None
            said = points(table + "\n")
            word = ascii_word[np.minimum(said, 128)]
            if beyond:
                high = np.flatnonzero(said > 127)
                word[high] = np.isin(said[high], np.unique(points(beyond)))
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            upto = np.cumsum(begins)[said == ord("\n")]
            head, budget = "\n".join(lines[: at + 1]), max(1, most - int(upto[at]))
            rows = [x.strip(" ") for x in lines[at + 1 :]]
            full = np.array([x != "" for x in rows], bool)
            rows, total = [x for x in rows if x], upto[at + 1 :][full]
            out, first = [], 0
            while first < len(rows):
                before = total[first - 1] if first else upto[at]
                last = max(first + 1, int(np.searchsorted(total, before + budget, "right")))
                out.append("\n".join([head, *rows[first:last]]))
                first = last
            return out or None

        return pd.Series([one(*x) for x in zip(tables, letters, strict=True)], dtype=object)

    return grouped


def chunk_records(df: DataFrame, doc: str, section: str, kind: Column, index: str, text: str = "text", confidence: Column | None = None, context: Column | None = None) -> DataFrame:
    """chunk_id (document, section, kind, number, digest), parent_id, quality (confidence in percent, 0 to 100) and parent_context."""
    digest = F.substring(F.sha1(F.encode(tx.text(text), "UTF-8")), 1, 12)
    head = F.substring(F.col(doc).cast("string"), 1, 8)
    quality = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.lit(None).cast("double") if confidence is None else confidence, F.lit(0.6)) * 100))
    return df.withColumns({"chunk_id": F.concat_ws("-", head, F.col(section).cast("string"), kind, F.col(index).cast("string"), digest), "parent_id": F.concat_ws("-", head, F.col(section).cast("string")), "quality": quality, "parent_context": F.lit(None).cast("string") if context is None else context})


def fallback_chunks(blocks: DataFrame, text: str = "content", least: int = 200) -> DataFrame:
    """A chunk for each block of at least `least` characters."""
    return blocks.where(F.length(F.trim(tx.text(text))) >= least)


def feedback_chunks(df: DataFrame, outline: str, section: str, text: str) -> DataFrame:
    """Numbered paragraphs with ids."""
    parts = df.select(outline, section, F.posexplode(tx.split_paragraphs(text)).alias("__i", "text")).where("text <> ''")
    n = F.col("__i") + 1
    return parts.select(outline, section, n.alias("paragraph_no"), "text", F.concat_ws("-", F.lit("fb"), F.substring(F.col(outline).cast("string"), 1, 8), F.col(section).cast("string"), n.cast("string"), F.substring(F.sha1(F.encode("text", "UTF-8")), 1, 10)).alias("chunk_id"))
