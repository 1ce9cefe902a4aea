"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is cut into a ring of segments. If two fingerprints differ in at most `most` bits, some segment starts a
chain in which the first l segments differ in at most l/m of `most` bits together, for every l (the pigeonring principle). For
most = 3 and five segments these budgets are 0, 1, 1, 2, 3: the first segment is equal, and so is one of the next two. That gives
ten index keys of 25 or 26 bits; only pairs that meet under a key and pass the chain's budgets get the full Hamming check.

Only distinct fingerprints are compared: a group of copies is one. Within a key a task finds a spanning forest of the links, never
all pairs; a key with very many fingerprints is cut up by the rest of its bits, of which one of four parts must be equal.

Defined results: null and empty texts have fingerprint zero and are linked like any other; null ids are kept, and a group of null
ids only has a null component; repeated rows and ties link as equal fingerprints do; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, drop, settle, words
from quarry.llm.jaccard import described, links as prefix_links

WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints under one key beyond which the key is cut up.
LARGE = 4096


def shingles(own: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k consecutive words joined by spaces, as unsigned integers; of all words if there are fewer; none without words."""
    if not own:
        return np.zeros(0, np.uint64)
    h, joined = xxhash.xxh64_intdigest, b" ".join(own)
    if len(own) <= k:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A fingerprint for each of the runs that hashes is cut into: bit set if set in over half of the run."""
    out = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return out
    lane = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)  # eight counters of a byte in each word
    cuts, owner, at = [], [], 0
    for i, n in enumerate(sizes):
        for c in range(at, at + n, 255):
            cuts.append(c)
            owner.append(i)
        at += n
    part = np.add.reduceat(lane, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    total = np.add.reduceat(part, first, axis=0)
    have = np.asarray(owner)[first]
    bits = total * 2 > np.asarray(sizes)[have][:, None]
    out[have] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _batched(texts: pa.Array, bytes_each: int = 1 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= bytes_each:
            yield held
            held, size = [], 0
    if held:
        yield held


def fingerprints(df: DataFrame, k: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for texts in _batched(b.column(1)):
                each = [shingles(words(t), k) for t in texts]
                out.append(majority(np.concatenate(each), [len(x) for x in each]))
            fp = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return one.mapInArrow(find, "doc_id long, fp long")


def segments(fp: np.ndarray) -> np.ndarray:
    """The ring's segments, a column each."""
    at, out = 0, []
    for w in WIDTHS:
        out.append((fp >> np.uint64(at)) & np.uint64((1 << w) - 1))
        at += w
    return np.stack(out, axis=-1)


def chain(x: np.ndarray, start: int, most: int) -> np.ndarray:
    """Of differences x: does the chain from segment `start` stay within its budgets?"""
    s, total, ok, m = segments(x), 0, True, len(WIDTHS)
    for length in range(1, m + 1):
        total = total + np.bitwise_count(s[..., (start + length - 1) % m]).astype(np.int64)
        ok = ok & (total <= length * most // m)
    return ok


def forest(fp: np.ndarray, start: int, most: int = 3) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of indexes, of the links among fingerprints that meet under a key of segment start."""
    if len(fp) > LARGE:
        x, out = fp, []
        for part in range(4):  # of 64 bits, 16 each: three differences leave one part equal
            own = (x >> np.uint64(16 * part)) & np.uint64(0xFFFF)
            order = np.argsort(own, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                if 1 < len(run):
                    out += [(int(run[a]), int(run[b])) for a, b in _grow(x[run], start, most)]
        return out
    return _grow(fp, start, most)


def _grow(fp: np.ndarray, start: int, most: int) -> list[tuple[int, int]]:
    rest, out = np.arange(len(fp)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            i = front.pop()
            x = fp[rest] ^ fp[i]
            near = chain(x, start, most)
            near[near] = np.bitwise_count(x[near]) <= most
            if near.any():
                hit = rest[near].tolist()
                out += [(i, j) for j in hit]
                front += hit
                rest = rest[~near]
    return out


def links(distinct: DataFrame, fp: str = "fp", most: int = 3) -> DataFrame:
    """Pairs (a, b) of the column's values that connect all values linked at `most` (at most 3) or fewer differing bits."""
    if most > 3:
        raise ValueError("the index keys are for three bits at most")
    at = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    seg = [F.shiftrightunsigned(F.col(fp), at[i]).bitwiseAND(F.lit((1 << w) - 1)) for i, w in enumerate(WIDTHS)]
    m = len(WIDTHS)
    # a key: which start, which of the next two segments is equal, and both segments' bits
    keys = F.array(*[F.lit((2 * i + j) << 26) + F.shiftleft(seg[i], 13) + seg[(i + 1 + j) % m] for i in range(m) for j in range(2)])
    index = distinct.select(F.col(fp).alias("fp"), F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in _and_end(batches):
            if b is not None:
                now = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
                if not len(now[0]):
                    continue
                held.append(now)
                if now[0][-1] == held[0][0][0]:
                    continue  # one key still goes on: joined once, when it ends
            key, fps = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            done = len(key) if b is None else int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            held = [(key[done:], fps[done:])] if done < len(key) else []
            key, fps = key[:done], fps[:done]
            cuts = np.flatnonzero(np.diff(key, prepend=-1))
            sizes = np.diff(cuts, append=len(key))
            a, c = [], []
            for s, n in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                own = fps[s : s + n]
                for i, j in forest(own, int(key[s]) >> 27, most):
                    a.append(own[i])
                    c.append(own[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (a, c)], ["a", "b"])

    return index.mapInArrow(meet, "a long, b long")


def near_duplicates(df: DataFrame, k: int = 3, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest id reachable by links) of every row."""
    fps = settle(fingerprints(df, k, doc_id, text), "fingerprints")
    first = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    roots = components(links(first, "fp", most))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by shingle sets: SimHash of parts of a document.

#: Shingles aimed at in a part, parts indexed of each fineness, bits of the whole fingerprints that may differ (at similarity 0.8 some
#: 14 do; 26 of 64 lets even unlike texts pass often, so that the chain costs no links).
PART, PARTS, LOOSE = 5, 32, 26
#: Members of a part's group up to which all pairs are tried at once.
SMALL = 24


def sketches(df: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (of all distinct shingles), whole (a 128-bit name of the set), hashes (the set, 32 bits each, sorted) and parts of every row with words.

    Shingles are dealt by hash over 2^f and 2^(f+1) parts (small sets: 2^(f+2), too), f such that a part has about PART of them, and a
    part's SimHash is indexed. Two sets of similarity 0.8 share a fineness and, but for one pair in many thousands, an equal part.
    """
    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            rows = []
            for doc, said in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.unique(shingles(words(said.as_py() or ""), k))
                if not len(x):
                    continue
                keys, fine = [], max(0, (len(x) // PART).bit_length() - 1)
                for f in (fine, fine + 1, fine + 2)[: 3 if len(x) < 128 else 2]:
                    part = (x >> np.uint64(40)) & np.uint64((1 << f) - 1)
                    order = np.argsort(part, kind="stable")
                    own = part[order]
                    cuts = np.flatnonzero(np.diff(own, prepend=np.uint64(2**63)))[:PARTS]
                    ends = np.append(cuts[1:], np.searchsorted(own, own[cuts[-1]], "right"))
                    sim = majority(x[order][: ends[-1]], np.diff(np.append(cuts, ends[-1])).tolist())
                    # the key says which fineness and part
                    keys += [((sim * np.uint64(0x9E3779B97F4A7C15)) ^ (own[cuts] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(f))).view(np.int64)]
                rows.append((doc, int(majority(x, [len(x)]).view(np.int64)[0]), xxhash.xxh3_128_digest(x.tobytes()), np.unique((x >> np.uint64(32)).astype(np.uint32)).astype("<u4").tobytes(), np.concatenate(keys)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "fp", "whole", "hashes", "parts"])

    return one.mapInArrow(sketch, "doc_id long, fp long, whole binary, hashes binary, parts array<long>")


def _candidates(index: DataFrame) -> DataFrame:
    """Of index (key, doc_id, fp), two kinds of rows (a, b, key, fp).

    Pairs a, b of ids that meet under a key and whose whole fingerprints pass the chain's budgets for LOOSE bits: all of them in groups
    of up to SMALL; in larger ones each with the first and with the one before it in order of fingerprints. And the members of these
    larger groups, with b null.
    """
    near = index.repartition("key").sortWithinPartitions("key", "doc_id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for b in _and_end(batches):
            now = left if b is None else [np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(left, ("key", "doc_id", "fp"), strict=True)]
            key = now[0]
            done = len(key) if b is None or not len(key) else int(np.searchsorted(key, key[-1]))
            left = [x[done:] for x in now]
            key, doc, fp = now[0][:done], now[1][:done], now[2][:done].view(np.uint64)
            cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(cuts, append=len(key))
            found, large = [], []
            for s, n in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                if n <= SMALL:
                    i, j = np.triu_indices(n, 1)
                else:
                    order = np.argsort(fp[s : s + n], kind="stable")
                    i, j = np.concatenate([np.zeros(n - 1, np.int64), order[:-1]]), np.concatenate([np.arange(1, n), order[1:]])
                    large.append(np.arange(s, s + n))
                x = fp[s + i] ^ fp[s + j]
                ok = np.zeros(len(x), bool)
                for start in range(len(WIDTHS)):
                    ok |= chain(x, start, LOOSE)
                found.append(np.stack([doc[s + i[ok]], doc[s + j[ok]]]))
            p, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            m = np.concatenate(large) if large else np.zeros(0, np.int64)
            gone = np.arange(len(p) + len(m)) >= len(p)
            cols = [np.concatenate([np.minimum(p, q), doc[m]]), np.concatenate([np.maximum(p, q), doc[m]]), np.concatenate([p, key[m]]), np.concatenate([p, fp[m].view(np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64(), mask=gone), pa.array(cols[2], pa.int64(), mask=~gone), pa.array(cols[3], pa.int64(), mask=~gone)], ["a", "b", "key", "fp"])

    return near.mapInArrow(meet, "a long, b long, key long, fp long")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of at least that."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(judge, "a long, b long")


def near_groups(df: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, group_id): group_id is the smallest id of the row's group, its own if it is alone; rows without words have none.

    Groups are connected by pairs whose sets of k-word shingles have at least that Jaccard similarity. Equal sets are one node.
    Candidates share the SimHash of a part and pass the pigeonring chain; each is then checked exactly. In a part's group of over
    SMALL documents each is tried with the group's first and with its neighbour in order of fingerprints; members of such groups that are in
    different components after that are joined exactly, by adaptive prefixes of their sets, so a part that unlike documents share costs no more
    than the rare shingles they share.
    """
    own = settle(sketches(df, k, doc_id, text), "sketches")
    # settled apart from the join below, so that a hot set's side of it can be split
    named = settle(own.groupBy("whole").agg(F.min("doc_id").alias("rep")), "named")
    members = settle(own.select("doc_id", "whole").join(named, "whole").select("doc_id", "rep"), "members")
    one = own.join(named.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    index = one.select("doc_id", "fp", F.explode(F.array_distinct("parts")).alias("key"))
    sets = own.select("doc_id", "hashes")
    met = settle(_candidates(index), "met")
    crowd = met.where("b is null").select("key", F.col("a").alias("doc_id"))
    pairs = settle(met.where("a <> b").select("a", "b").distinct(), "pairs")
    need = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    few_sets = settle(sets.join(need, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets")
    found = settle(_similar(pairs, few_sets, similarity), "fit")
    drop(few_sets, pairs)
    roots = components(found)
    # members of large groups that are in different components still: all their links, by exact prefixes of their sets
    left = crowd.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = settle(left.join(mixed, "key", "left_semi").select("doc_id").distinct(), "left")
    if not rest.isEmpty():
        crowd_sets = settle(sets.join(rest, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "hashes"), "sets")
        nodes = settle(described(crowd_sets, round(100 * similarity), "<u4"), "nodes")
        _, roots = prefix_links(nodes, round(100 * similarity), lambda need: crowd_sets.join(need, "node"), found, roots, ("few", "all"), "<u4")
    group = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return group.select("doc_id", F.coalesce("root", "rep").alias("group_id"))
