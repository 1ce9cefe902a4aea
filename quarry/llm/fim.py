"""Fill-in-middle transformation by a byte automaton.

A text's units are its runs of ASCII letters and each other code point. One table says, for a state and a byte, the next state and what
the transition counts: a unit that starts, a code point that starts (continuation bytes of UTF-8 start neither), a sentinel that ends. The
state is the longest beginning of a sentinel that was just read, and whether the last byte was a letter; it depends on the last few
bytes only, so strips of a text are scanned side by side, each after a short run-up. The first scan only counts, a strip at a time; two unit numbers are
drawn from a hash of the id, and a second pass scans the strips that hold them for their places. Python returns numbers; texts are cut and joined by Spark.

Defined results: null texts are empty; empty texts and those that hold a sentinel are plain; a null id is hashed as an empty string;
repeated rows and ties get equal results; texts of any length are scanned whole, in groups of bounded bytes; other columns of df stay
only if kept, so no name clashes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a strip, and of the texts that are scanned at once (a longer text is alone).
STRIP, GROUP = 256, 4_000_000
#: Fields of a transition's value: next state in the low byte, then units, code points and sentinels.
UNIT, CHAR, HIT, FIELD = 8, 24, 40, 0xFFFF


@cache
def automaton(sentinels: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """The table (state * 256 + byte -> value; state 0 is the start) and how many bytes fix a state."""
    marks = [s.encode() for s in sentinels]
    letters = set(range(65, 91)) | set(range(97, 123))

    def longest(read: bytes) -> bytes:
        while not any(m.startswith(read) and read != m for m in marks):
            read = read[1:]
        return read

    number, states, rows = {(b"", False): 0}, [(b"", False)], []
    for begun, in_run in states:  # grows as states are found
        row = []
        for b in range(256):
            read, letter = begun + bytes([b]), b in letters
            new = (longest(read), letter)
            if new not in number:
                number[new] = len(states)
                states.append(new)
            more = 0x80 <= b < 0xC0
            row.append(number[new] | int(not (more or letter and in_run)) << UNIT | int(not more) << CHAR | int(any(read.endswith(m) for m in marks)) << HIT)
        rows.append(row)
    return np.array(rows, np.int64).ravel(), max(1, max(map(len, marks), default=1) - 1)


def _run(data: np.ndarray, start: np.ndarray, end: np.ndarray, floor: np.ndarray, table: np.ndarray, span: int, each) -> None:
    """Scans strips [start, end) of data side by side, longest first (they must be sorted so); each(j, m, values) gets the transitions at byte j of the first m strips."""
    state = np.zeros(len(start), np.int64)
    for j in range(span, 0, -1):  # the run-up, not before the text's start
        ok = start - j >= floor
        state[ok] = table[state[ok] << 8 | data[start[ok] - j]] & 0xFF
    length = end - start
    active = len(start) - np.searchsorted(length[::-1], np.arange(int(length[0]) if len(length) else 0), "right")
    for j, m in enumerate(active.tolist()):
        v = table[state[:m] << 8 | data[start[:m] + j]]
        state[:m] = v & 0xFF
        each(j, m, v)


def cuts(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray, sentinels: tuple[str, ...] = SENTINELS) -> np.ndarray:
    """For texts that lie end to end in data: columns units, sentinels, and code points up to the smaller and the larger of units h1 % (n + 1) and h2 % (n + 1)."""
    table, span = automaton(sentinels)
    texts, starts = len(ends), np.concatenate([[0], ends[:-1]]).astype(np.int64)
    strips = np.maximum(1, -(-(ends - starts) // STRIP))
    owner = np.repeat(np.arange(texts), strips)
    first = np.cumsum(strips) - strips
    a = starts[owner] + (np.arange(len(owner)) - first[owner]) * STRIP
    b = np.minimum(a + STRIP, ends[owner])
    order = np.argsort(a - b, kind="stable")
    total = np.zeros(len(owner), np.int64)

    def count(j: int, m: int, v: np.ndarray) -> None:
        total[:m] += v >> UNIT  # a strip has fewer bytes than a field counts

    _run(data, a[order], b[order], starts[owner][order], table, span, count)
    counted = np.empty_like(total)
    counted[order] = total
    units, chars, hits = (counted >> s & FIELD for s in (0, CHAR - UNIT, HIT - UNIT))
    n, all_chars, all_hits = (np.add.reduceat(x, first) for x in (units, chars, hits))
    before = np.cumsum(units) - units
    chars_before = np.cumsum(chars) - chars
    out = np.stack([n, all_hits, all_chars, all_chars], axis=1)
    at = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], axis=1), axis=1)
    text, which = np.nonzero(at < n[:, None])  # a cut at n is the end
    goal = before[first[text]] + at[text, which]
    strip = np.searchsorted(before, goal, "right") - 1
    order = np.argsort(a[strip] - b[strip], kind="stable")
    strip, goal, text, which = strip[order], goal[order] - before[strip[order]], text[order], which[order]
    unit, char = np.zeros(len(strip), np.int64), chars_before[strip] - chars_before[first[text]]

    def locate(j: int, m: int, v: np.ndarray) -> None:
        new = v >> UNIT & FIELD
        hit = np.flatnonzero((new > 0) & (unit[:m] == goal[:m]))
        out[text[hit], 2 + which[hit]] = char[hit]
        unit[:m] += new
        char[:m] += v >> CHAR & FIELD

    _run(data, a[strip], b[strip], starts[text], table, span, locate)
    return out


def _udf(sentinels: tuple[str, ...]):
    @F.arrow_udf("struct<n: bigint, hits: bigint, prefix: int, both: int>")
    def scan(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        held, size, found, a = [], 0, [], 0
        x, y = h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
        for i, t in enumerate(text):
            held.append(t.as_py().encode())
            size += len(held[-1])
            if size >= GROUP or i == len(text) - 1:
                found.append(cuts(np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]), x[a : i + 1], y[a : i + 1], sentinels))
                held, size, a = [], 0, i + 1
        c = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.StructArray.from_arrays([pa.array(c[:, i], k) for i, k in enumerate(kinds)], ["n", "hits", "prefix", "both"])

    return scan


def fill_in_middle(df: DataFrame, plain: int = 10, spm: int = 20, seed: str = "1", sentinels: tuple[str, ...] = SENTINELS, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output, and the columns to keep.

    plain: percent of texts left as they are; spm: percent of the others with the suffix first. A sentinel's first character may stand nowhere
    else in a sentinel, so that text and marks together make no other mark.
    """
    if any(c in s[1:] for c in {s[:1] for s in sentinels} for s in sentinels) or "" in sentinels or len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ, and the first character of one may stand nowhere else in them")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long")
    own = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"), h.alias("__h"), *keep)
    cut = own.withColumn("__c", _udf(sentinels)("__t", group(0), group(1)))
    form = F.when((F.col("__t") == "") | (F.col("__c.hits") > 0) | (group(2) % 100 >= 100 - plain), "plain").when(group(3) % 100 < spm, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    p, both, t = F.col("__c.prefix"), F.col("__c.both"), F.col("__t")
    prefix, middle, suffix = F.substr(t, F.lit(1), p), F.substr(t, p + 1, both - p), F.substr(t, both + 1)
    mark_p, mark_s, mark_m = map(F.lit, sentinels)
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(mark_p, prefix, mark_s, suffix, mark_m, middle)).otherwise(F.concat(mark_s, suffix, mark_p, prefix, mark_m, middle))
    cutting = lambda c: F.when(F.col("form") != "plain", c).cast("long")
    return cut.select("doc_id", F.col("__c.n").alias("n"), "form", cutting(p).alias("prefix_chars"), cutting(both - p).alias("middle_chars"), output.alias("output"), *keep)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The exact text, from output and form alone: parts hold no sentinel, so each mark stands once and cuts the output."""
    o, (p, s, m) = F.col(output), sentinels
    cut = lambda c, mark, side: F.substring_index(c, mark, side)
    middle = cut(o, m, -1)
    psm = F.concat(cut(cut(o, s, 1), p, -1), middle, cut(cut(o, s, -1), m, 1))
    spm = F.concat(cut(cut(o, p, -1), m, 1), middle, cut(cut(o, p, 1), s, -1))
    return F.when(F.col(form) == "plain", o).when(F.col(form) == "psm", psm).otherwise(spm)
