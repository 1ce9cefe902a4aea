"""Substring dedup with suffix automata of reference shards.

A word goes if a window of `window` words over it has a word sequence that also starts earlier (in a document of smaller id, or
earlier in the same one). Windows are judged on the input. Words are runs of characters other than ASCII white space.

1. Each window is routed by its minimizer, the least hash among its runs of GRAM words; equal windows have equal minimizers.
   Neighbouring windows that share one travel together as a stretch: minimizer, place, count.
2. Minimizers that occur once are done: none of their windows can repeat. This is all that hashes decide.
3. The words of the other stretches are read back. Of stretches with the same words in a task only the first goes on; the others
   repeat it. The rest are the reference as well as the stream: they are dealt by minimizer into shards, where all equal windows are,
   and pass in order of (doc, start) by the shard's suffix automaton: its matching statistics tell which windows it has seen, and
   what is new to it is added. Shards are dealt, not broadcast, as the reference grows with the input.
4. Places and their repeated windows are gathered by document, and the covered words removed.

A minimizer with over HOT stretches would be a large shard: its stretches go as single windows, each dealt by a hash of its words, so
that a shard again holds little but equal windows, of which each task has sent one. Two windows of one hash only share a shard: words decide.

Defined results: null text has no words; rows without id lose nothing and count for nothing; rows of one id are one document and do
not repeat each other at equal places (if their texts differ, what is removed at a place of one is removed at it of all); texts shorter than the window lose nothing; other columns may be carried along (keep).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop, process_cache, settle

GRAM, HOT, SHARD = 6, 2000, 60_000
#: Bytes of words that a task compares before it sends what it has.
TOGETHER = 32_000_000
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of _Q modulo 2^64, from 1 on, and of its inverse."""
    known = process_cache("powers")
    if len(known.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _Q), ("down", pow(_Q, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            known[name] = np.cumprod(p)
    return known["up"], known["down"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of some bytes starts, and its hash: a polynomial of its bytes, freed of its place, and its length."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)])
    return starts, _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def stretches(docs: Sequence[int], texts: list[bytes], window: int) -> list[np.ndarray]:
    """h (the minimizer), doc, start, n of every stretch of some documents."""
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    at_byte, x = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    sizes = np.diff(np.searchsorted(at_byte, begins))
    ends = np.cumsum(sizes)
    wide = len(x) - window + 1
    if wide <= 0:
        return [np.zeros(0, np.int64)] * 4
    gram = np.zeros(len(x) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        gram = gram * np.uint64(_P) + x[j : len(x) - GRAM + 1 + j]
    gram = _mix(gram)
    # the leftmost least gram of each window
    least, at, have, want = gram, np.arange(len(gram)), 1, window - GRAM + 1
    while have < want:
        s = min(have, want - have)
        less = least[s:] < least[:-s]
        least, at, have = np.where(less, least[s:], least[:-s]), np.where(less, at[s:], at[:-s]), have + s
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(np.arange(wide) + window <= ends[owner[:wide]])
    if not len(inside):
        return [np.zeros(0, np.int64)] * 4
    own = owner[inside]
    new = np.flatnonzero((np.diff(at[inside], prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
    first, n = inside[new], np.diff(new, append=len(inside))
    own = owner[first]
    return [least[first].view(np.int64), np.asarray(docs, np.int64)[own], first - (ends - sizes)[own], n]


def _stretch_rows(df: DataFrame, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h, at, start, n = stretches(range(len(docs)), texts, window)
            doc, t = np.array(docs, np.int64)[at], np.array(which, np.int32)[at]
            docs.clear()
            which.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc), pa.array(t), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "doc", "t", "start", "n"])

        docs: list[int] = []
        which: list[int] = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            for doc, t, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = (said.as_py() or "").encode()
                if len(own) >= 2 * window - 1:
                    docs.append(doc)
                    which.append(t)
                    texts.append(own)
                    size += len(own)
                    if size > 1_000_000:
                        yield out()
                        size = 0
        if docs:
            yield out()

    return df.mapInArrow(find, "h long, doc long, t int, start int, n int")


class Automaton:
    """A suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, p: int, word: str, q: int) -> int:
        k = len(self.length)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = k
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = k
            p = self.link[p]
        return k

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
                continue
            p, last = last, len(self.length)
            self.next.append({})
            self.length.append(self.length[p] + 1)
            self.link.append(0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)

    def statistics(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest run that ends with it and is in the automaton."""
        v, n, out, step, link, length = 0, 0, [], self.next, self.link, self.length
        for word in words:
            while v and word not in step[v]:
                v = link[v]
                n = length[v]
            if word in step[v]:
                v = step[v][word]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def _texts(docs: DataFrame, need: DataFrame, window: int) -> DataFrame:
    """route, doc, start, n and the words (said) of each stretch asked for; those that repeat an earlier one of the same task have no words.

    Stretches of hot minimizers go as single windows.
    """
    kinds = [("route", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("said", pa.string())]

    def firsts(held: dict) -> Iterator[tuple]:
        for (h, hot, said), places in held.items():
            first = min(places)
            for doc, s, n in places:
                if (doc, s) != first[:2]:
                    yield h, doc, s, n, None
            doc, s, n = first
            if hot:
                own = said.split(" ")
                for j in range(n):
                    part = " ".join(own[j : j + window])
                    yield xxhash.xxh64_intdigest(part) - 2**63, doc, s + j, 1, part
            else:
                yield h, doc, s, n, said

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        rows = firsts(held)
        while part := list(islice(rows, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool, str], list[tuple[int, int, int]]] = {}
        size = 0
        for b in batches:
            for doc, t, said, want in zip(b.column("doc").to_pylist(), b.column("t").to_pylist(), b.column("__text"), b.column("want"), strict=True):
                own = [w.decode() for w in (said.as_py() or "").encode().split()]
                for w in want.as_py():
                    s, n = w["start"], w["n"]
                    if w["t"] != t or s + n + window - 1 > len(own):
                        continue  # a stretch of another text of this id
                    words = " ".join(own[s : s + n + window - 1])
                    at = held.setdefault((w["h"], w["hot"], words), [])
                    at.append((doc, s, n))
                    size += len(words) if len(at) == 1 else 50
                if size > TOGETHER:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    return docs.join(need, "doc").select("doc", "t", "__text", "want").mapInArrow(read, "route long, doc long, start int, n int, said string")


def _seen(reference: DataFrame, window: int) -> DataFrame:
    """doc, start and mask: which of the stretch's windows (bit 0 the first) an earlier stretch has."""
    dealt = reference.repartition("route").sortWithinPartitions("route", "doc", "start")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, route, at = Automaton(), None, None
        known: set[str] = set()
        new: list[str] = []
        for b in batches:
            out = []
            for r, doc, start, n, said in zip(*[b.column(k).to_pylist() for k in ("route", "doc", "start", "n", "said")], strict=True):
                if (r, doc, start) != at:  # rows of one id and place do not repeat each other
                    for x in new:
                        shard.add(x.split(" "))
                    known.update(new)
                    new = []
                if r != route:
                    route, known = r, set()
                    if len(shard.length) > SHARD:
                        shard = Automaton()
                at, full = (r, doc, start), (1 << n) - 1
                if said in known:
                    out.append((doc, start, full))
                    continue
                mask = sum(1 << i for i, m in enumerate(shard.statistics(said.split(" "))[window - 1 :]) if m >= window)
                if mask != full:
                    new.append(said)
                if mask:
                    out.append((doc, start, mask))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc", "start", "mask"])

    return dealt.mapInArrow(stream, "doc long, start int, mask long")


def remove_repeats(df: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), spaced: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept and the columns of keep, for every row.

    kept is the words left, joined by one space; with spaced, the text without the removed words and the white space after them.
    """
    base = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("__text"), *[F.col(k).alias(f"k_{k}") for k in keep])
    known = base.where("doc is not null")
    which = F.hash("__text").alias("t")  # tells texts of one id apart
    rows = _stretch_rows(known.select("doc", which, "__text"), window)
    # counted with map-side sums and joined, not windowed: a minimizer that most documents share is then split over tasks
    names = settle(rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "minimizers")  # apart from the join, whose sides can be split only if both are dealt for it
    left = settle(rows.join(names, "h").select("h", "doc", "t", "start", "n", (F.col("k") > HOT).alias("hot")), "stretches")
    drop(names)
    need = left.groupBy("doc").agg(F.collect_set(F.struct("start", "n", "h", "hot", "t")).alias("want"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartition(n, "doc")
    reference = settle(_texts(dealt.select("doc", which, "__text"), need, window), "reference")
    drop(left)
    decided = reference.where("said is null").select("doc", "start", F.expr("shiftleft(1L, n) - 1L").alias("mask"))
    flags = decided.unionByName(_seen(reference.where("said is not null"), window)).groupBy("doc").agg(F.collect_list(F.struct("start", "mask")).alias("flags"))
    both = dealt.join(flags, "doc", "left").unionByName(base.where("doc is null").withColumn("flags", F.lit(None).cast("array<struct<start:int,mask:bigint>>")))
    names = [f"k_{k}" for k in keep]
    one = both.select("doc", "__text", "flags", *names)
    schema = both.select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("__text").alias("kept"), *names).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, gone, kept = [], [], []
            for said, flags in zip(b.column("__text"), b.column("flags"), strict=True):
                t = said.as_py()
                data = (t or "").encode()
                words = data.split()
                counts.append(len(words))
                f = flags.as_py()
                if not f:
                    gone.append(0)
                    kept.append(t if spaced else b" ".join(words).decode())
                    continue
                edge = np.zeros(len(words) + window + 1, np.int64)
                for x in f:
                    for j in range(x["mask"].bit_length()):
                        if x["mask"] >> j & 1 and x["start"] + j + window <= len(words):
                            edge[x["start"] + j] += 1
                            edge[x["start"] + j + window] -= 1
                stays = np.cumsum(edge)[: len(words)] == 0
                gone.append(len(words) - int(stays.sum()))
                if spaced:
                    at = [m.start() for m in _WORD.finditer(data)] + [len(data)]
                    kept.append(b"".join([data[: at[0]], *[data[at[i] : at[i + 1]] for i in np.flatnonzero(stays).tolist()]]).decode())
                else:
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *[b.column(k) for k in names]], ["doc_id", "n_words", "n_removed", "kept", *names])

    return one.mapInArrow(cut, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))
