"""Scalar text functions: tokens, sentences, anchors, blocks, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[。；;\n]+"
# How numbered headings begin.
ANCHOR = r"^\s*(?:第?[一二三四五六七八九十0-9]+[章节条款、.]|\d+(?:\.\d+)+)"


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def words(c: Column | str) -> Column:
    """Word runs, as they are."""
    return F.regexp_extract_all(text(c), F.lit(WORD), F.lit(0))


def tokens(c: Column | str) -> Column:
    """Word runs in lower case."""
    return words(F.lower(text(c)))


def word_count(c: Column | str) -> Column:
    """B19."""
    return F.regexp_count(text(c), F.lit(WORD))


def pieces(c: Column | str, separator: str) -> Column:
    """The trimmed, non-empty parts between separators."""
    return F.filter(F.transform(F.split(text(c), separator), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def sentences(c: Column | str) -> Column:
    return pieces(c, SENTENCE_END)


def squash(c: Column | str) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def squeezed(c: Column | str) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(text(c), r"\s+", ""))


def is_heading(c: Column | str, pattern: str = ANCHOR) -> Column:
    return text(c).rlike(pattern)


def looks_like_table(c: Column | str) -> Column:
    """A row between pipes, or two lines with tabs, or two of three or more wide columns."""
    lines = pieces(c, "\n")
    wide = lambda x: F.size(F.filter(F.split(x, r"\s{2,}"), lambda p: p != "")) >= 3
    return F.exists(lines, lambda x: x.rlike(r"\|.+\|")) | (F.size(F.filter(lines, lambda x: F.contains(x, F.lit("\t")))) >= 2) | (F.size(F.filter(lines, wide)) >= 2)


def is_markdown_table(c: Column | str) -> Column:
    """Pipes in the first two lines, the second a separator."""
    lines = F.split(text(c), "\n")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    return F.coalesce(F.contains(first, F.lit("|")) & F.contains(second, F.lit("|")) & second.rlike(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"), F.lit(False))


def paragraph_type(c: Column | str, style: Column | None = None) -> Column:
    """TITLE by style, LIST by style or bullet, else PARA."""
    s = F.lower(F.coalesce(style, F.lit(""))) if style is not None else F.lit("")
    return F.when(s.rlike(r"^(heading|title|标题)"), "TITLE").when(s.rlike("list|bullet|number|编号|项目符号") | text(c).rlike(r"^\s*([-*•]|\d+[.)、])\s+"), "LIST").otherwise("PARA")


def table_rows(c: Column | str) -> Column:
    """Cells of each line: between pipes, else tabs, else two or more spaces; lines without any cell are dropped."""
    trim = lambda a: F.transform(a, lambda x: F.trim(x))
    wide = lambda x: F.filter(trim(F.split(x, r"\s{2,}")), lambda p: p != "")
    row = lambda x: F.when(F.contains(x, F.lit("|")), trim(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))).when(F.contains(x, F.lit("\t")), trim(F.split(x, "\t"))).otherwise(wide(x))
    return F.filter(F.transform(pieces(c, "\n"), row), lambda r: F.exists(r, lambda p: p != ""))


def cjk(c: Column | str) -> Column:
    """The Han characters, joined."""
    return F.regexp_replace(text(c), "[^一-鿿]", "")


def bigrams(c: Column) -> Column:
    """Neighbouring pairs of characters."""
    n = F.length(c)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def ordered_keywords(c: Column | str, fallback: Column | None = None, most: int = 20, least: int = 3, pad: str = "keyword") -> Column:
    """Han runs of two or more and word runs of three or more letters, in order of first appearance, then the fallbacks; padded to `least`."""
    found = F.regexp_extract_all(text(c), F.lit("[一-鿿]{2,}|[A-Za-z0-9_]{3,}"), F.lit(0))
    if fallback is not None:
        found = F.concat(found, F.filter(F.transform(fallback, lambda x: F.trim(x)), lambda x: F.length(x) >= 2))
    own = F.slice(F.array_distinct(found), 1, most)
    more = F.transform(F.sequence(F.lit(1), F.lit(least)), lambda i: F.concat(F.lit(pad), i.cast("string")))
    return F.when(F.size(own) >= least, own).otherwise(F.concat(own, F.slice(more, F.size(own) + 1, least)))


def slices(c: Column | str, size: int, overlap: int = 0) -> Column:
    """Runs of `size` words joined by spaces, each `size - overlap` further; the last may lie within the one before."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be less than size")
    own = words(c)
    starts = F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(step)))
    return F.transform(starts, lambda i: F.array_join(F.slice(own, i, F.lit(size)), " "))


def split_paragraphs(c: Column | str) -> Column:
    """Paragraphs between blank lines; if there is one only, as it is."""
    by_line = pieces(c, r"\n{2,}")
    by_end = pieces(c, "[。；;]")
    return F.when(F.size(by_line) > 0, by_line).when(F.size(by_end) > 0, by_end).otherwise(F.array(F.trim(text(c))))


def numbering(c: Column | str) -> Column:
    """A heading's number, or null."""
    return F.nullif(F.regexp_extract(text(c), "^\\s*(第[一二三四五六七八九十百0-9]+[章节条款])", 1), F.lit(""))


def frozen(c: Column | str) -> Column:
    """(key, md5 of the trimmed body) of each [FROZEN:key] … [/FROZEN] block."""
    block = r"(?s)\[FROZEN:([^\]]+)\](.*?)\[/FROZEN\]"
    return F.arrays_zip(F.regexp_extract_all(text(c), F.lit(block), F.lit(1)).alias("key"), F.transform(F.regexp_extract_all(text(c), F.lit(block), F.lit(2)), lambda b: F.md5(F.trim(b))).alias("signature"))
