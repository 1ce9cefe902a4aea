"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets of n and more tokens with a Jaccard similarity of t share at least r = ceil(t n) of them. In one order of all tokens, rare
first, their first l common tokens lie among the first n - r + l tokens of each: the l-prefix. So a document may choose any l, and a pair
is a candidate if it shares min(l, l') tokens of the prefixes of that length. A longer prefix reads more postings, but asks for more shared
tokens before a pair is verified; each document takes the l of least estimated cost, from the exact lengths of the lists its tokens are in.

Equal sets are one node. Nodes are linked in rounds. The first two only save work: each node tries a few partners of its longest list,
then of every list that still holds different components, and what is similar is joined. In the last, all pairs of a list that
are in different components (and fit by size and by a parity sketch, which bounds the difference from below) are counted, and verified on whole
sets where they share enough. Large lists are dealt into cells, the members of a list's largest component once each.

The order puts the most frequent shingles last: of shingles that repeat within a batch of documents, counted over all documents, the LATE most
frequent, which is a bounded broadcast. Any order gives the same result.

Shingles are told apart by 64-bit hashes, sets by 128-bit ones. Defined results: null and empty texts and those without words have no
shingles and are linked with nothing; fewer words than a shingle has are one shingle; rows of one id are judged by their texts; null ids are
kept, and a component of null ids only has a null name; repeated rows and ties link as equal sets do; very long texts are read whole; other
columns of df are not read, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, drop, settle, words

#: Most frequent shingles that come last in the order; longest multi-match; members up to which a list is one cell; members of a cell.
LATE, MOST, SMALL, CELL = 100_000, 4, 32, 2048
#: Parities of the fine sketch, by which the last round compares, and of the wide one, of sets of more than NARROW tokens; of 256 parities
#: those that may differ for a pair to be tried early (unlike texts: some 128).
FINE, WIDE, NARROW, NEAR = 1024, 2048, 500, 100
#: Routes that the cells of large lists of the same first member are dealt over.
PARTS = 8
#: Needed documents up to which their ids are broadcast (some 15 MB).
FEW = 200_000
#: Postings that cost as much as the verification of a pair, and of a hundred shingles of it.
PAIR, HUNDRED = 8, 4


class Hashes(dict):
    """XXH64 of words; it lives as long as a batch."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, known: Hashes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted: sums of its words' hashes times odd numbers, one for each place, mixed. Fewer words than k are one shingle."""
    own = words(text or "")
    if not own:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
    odd = _mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    if len(w) < k:
        return _mixed(np.array([(w * odd[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    total = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        total += w[j : len(w) - k + 1 + j] * odd[j]
    return np.unique(_mixed(total))


def _parities(x: np.ndarray, bits: int) -> bytes:
    """For each of so many classes of tokens, whether an odd number of the set is in it."""
    return np.packbits((np.bincount((x >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _prefix(x: np.ndarray, size: int, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first tokens of a sorted set in the order of all: by hash, and the late ones after all others by their places."""
    early: list[np.ndarray] = []
    late: list[tuple[np.ndarray, np.ndarray]] = []
    at, found, step = 0, 0, 2 * size + 16
    while at < len(x) and found < size:
        part = x[at : at + step]
        i = np.minimum(np.searchsorted(last, part), len(last) - 1)
        is_late = last[i] == part
        early.append(part[~is_late])
        late.append((part[is_late], place[i[is_late]]))
        at, found, step = at + step, found + len(early[-1]), 4 * step
    head = np.concatenate(early)[:size] if early else x[:0]
    if len(head) < size and late:
        token, order = (np.concatenate(c) for c in zip(*late, strict=True))
        head = np.concatenate([head, token[np.argsort(order)]])[:size]
    return head


def _late(df: DataFrame, sets: Callable[[pa.RecordBatch], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that come last, sorted, and their places among each other (from 1, by frequency): those that several sets of a batch have, counted over all batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets(b)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["token", "n"])

    counts = df.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "token").limit(LATE).collect()  # bounded: 100,000 numbers
    if not found:  # one that no set has
        return np.zeros(1, np.uint64), np.zeros(1, np.int64)
    token = np.array([r.token for r in found], np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], len(token) - order


def _least(n: np.ndarray | int, percent: int):
    """Tokens that a set of n shares at least with a similar one that is no smaller."""
    return -(-n * percent // 100)


def _described(x: np.ndarray, percent: int, last: np.ndarray, place: np.ndarray) -> tuple:
    """Of a sorted set: n, sketch, fine, wide (for large sets) and prefix."""
    n = len(x)
    return n, _parities(x, 256), _parities(x, FINE), _parities(x, WIDE) if n > NARROW else None, _prefix(x, n - _least(n, percent) + MOST, last, place).view(np.int64)


DESCRIBED = ("n", "sketch", "fine", "wide", "prefix")
DESCRIBED_KINDS = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
DESCRIBED_SCHEMA = "n long, sketch binary, fine binary, wide binary, prefix array<long>"


def _rows(df: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, hi and lo (a name of the set), n, sketch (256 parities), fine (more of them), wide (more still, for large sets) and prefix of every row."""

    def sets(b: pa.RecordBatch) -> list[np.ndarray]:
        known = Hashes()
        return [shingle_set(t.as_py(), k, known) for t in b.column(1)]

    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    late = df.sparkSession.sparkContext.broadcast(_late(one, sets))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in sets(b):
                name = xxhash.xxh3_128_digest(x.tobytes())
                rows.append((int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True), *_described(x, percent, *late.value)))
            cols = list(zip(*rows, strict=True)) or [()] * (2 + len(DESCRIBED))
            kinds = (pa.int64(), pa.int64(), *DESCRIBED_KINDS)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "hi", "lo", *DESCRIBED])

    return one.mapInArrow(read, f"doc_id long, hi long, lo long, {DESCRIBED_SCHEMA}")


def _postings(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(token, node, level) of each node's prefix of its chosen length, and (node, need, favourite): its l and the longest list it is in."""
    r = F.expr(f"(n * {percent} + 99) div 100")
    place = nodes.select("node", "n", r.alias("r"), F.posexplode("prefix").alias("p", "token"))
    # the l-prefix ends at place n - r + l, and l may not exceed r
    every = place.select("token", "node", F.greatest(F.lit(1), F.col("p") + 1 - F.col("n") + F.col("r")).cast("int").alias("level"), "n", "r").where("level <= r")
    lengths = every.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    held = settle(every.join(lengths, "token"), "held")
    reads = [F.sum(F.when(F.col("level") <= length, F.col("c") - 1).otherwise(0)).alias(f"s{length}") for length in range(1, MOST + 1)]
    sums = held.groupBy("node").agg(F.first("n").alias("n"), F.first("r").alias("r"), *reads, F.max(F.struct(F.when(F.col("level") == 1, F.col("c")).otherwise(0).alias("c"), "token")).alias("f"))
    # of s postings at most s / l documents can share l tokens
    cost = [F.struct((F.col(f"s{m}") * (1 + (PAIR + HUNDRED * F.col("n") / 100) / m)).alias("cost"), F.lit(m).alias("m")) for m in range(1, MOST + 1)]
    may = F.filter(F.array(*cost), lambda x: x["m"] <= F.col("r"))
    chosen = settle(sums.select("node", F.array_min(may)["m"].alias("need"), F.col("f.token").alias("favourite"), F.col("f.c").alias("others")), "chosen")
    kept = settle(held.join(chosen.select("node", "need"), "node").where("level <= need").select("token", "node", "level"), "postings")
    drop(held)
    return kept, chosen


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of complete routes, and so of complete cells; batches are sorted by route."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        route = b.column("route").to_numpy()
        if held and route[-1] == held[0].column("route")[0].as_py():
            held.append(b)  # one route still goes on
            continue
        done = int(np.searchsorted(route, route[-1]))
        if held or done:
            yield pa.Table.from_batches([*held, b.slice(0, done)])
        held = [b.slice(done)]
    if held:
        yield pa.Table.from_batches(held)


def allowed(both: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that similar sets of together so many may have apart: shared >= percent * (both - shared) / 100."""
    return both - 2 * -(-percent * both // (100 + percent))


class Members:
    """The members of cells as arrays, in order of cell and size."""

    def __init__(self, t: pa.Table, percent: int):
        cell, n = t.column("cell").to_numpy(), t.column("n").to_numpy()
        order = np.lexsort((t.column("lead").to_numpy(), n, cell))
        self.percent, self.cell, self.n = percent, cell[order], n[order]
        self.node, self.root, self.need, self.level, self.side = (t.column(c).to_numpy()[order] for c in ("node", "root", "need", "level", "side"))
        self.sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(n), -1)[order]
        self.folded = np.bitwise_xor.reduce(self.sketch.reshape(len(n), -1, 4), axis=1)  # 256 parities: every class is one of the finer ones together

    def fits(self, i: np.ndarray, j: np.ndarray, most: int | None = None) -> np.ndarray:
        """May these pairs be links that are not known? The parities that differ are at most the tokens that one of two sets has; most: of 256 parities."""
        a, b = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = (self.cell[i] == self.cell[j]) & (self.root[i] != self.root[j]) & (100 * a >= self.percent * b)
        for sketch in (self.folded, self.sketch)[: self.sketch.shape[1] // 4]:
            at = np.flatnonzero(ok)
            apart = np.bitwise_count(sketch[i[at]] ^ sketch[j[at]]).sum(axis=1, dtype=np.int64)
            may = allowed(self.n[i[at]] + self.n[j[at]], self.percent)
            ok[at] = apart <= (may if most is None else np.minimum(most, may))
        return ok

    def pairs(self, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        a, b, need = np.minimum(self.node[i], self.node[j]), np.maximum(self.node[i], self.node[j]), np.minimum(self.need[i], self.need[j]).astype(np.int32)
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))[: len(a)])
        shared = np.diff(first, append=len(a)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (a[first], b[first], need[first], shared)], ["a", "b", "need", "shared"])


def _few(m: Members) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each member with the next two by size, and with its cell's first."""
    every, out = np.arange(len(m.cell)), []
    start = np.searchsorted(m.cell, m.cell)
    for i, j in ((every[:-1], every[1:]), (every[:-2], every[2:]), (start, every)):
        ok = m.fits(i, j, NEAR)
        out.append((i[ok], j[ok]))
    return out


def _all(m: Members) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a cell that fit: of different sides, where it has two. Both members must hold the token within the pair's need."""
    out = []
    cuts = np.flatnonzero(np.diff(m.cell, prepend=m.cell[0] - 1)) if len(m.cell) else np.zeros(0, np.int64)
    sizes = np.diff(cuts, append=len(m.cell))
    end = np.repeat(cuts + sizes, sizes)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        need = np.minimum(m.need[i], m.need[j])
        ok = (m.level[i] <= need) & (m.level[j] <= need) & ((m.side[i] != m.side[j]) | (m.side[i] == 2))
        i, j = i[ok], j[ok]
        ok = m.fits(i, j)
        out.append((i[ok], j[ok]))

    small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
    for d in range(1, SMALL):  # members are in order of size, cells in a row: d places on is the same cell or none
        small = small[small + d < end[small]]
        if not len(small):
            break
        keep(small, small + d)
    for s, n in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        reach = s + np.searchsorted(m.n[s : s + n] * m.percent, m.n[s : s + n] * 100, "right")
        for i, stop in zip(range(s, s + n), reach.tolist(), strict=True):
            j = np.arange(i + 1, stop)
            if len(j):
                keep(np.full(len(j), i), j)
    return out


def _candidates(cells: DataFrame, percent: int, full: bool) -> DataFrame:
    """Pairs (a, b, need) of nodes in the same cell, and in how many cells of a route: a few for each, or all. cells: route, cell, node, root, n, sketch, need, level, side."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _complete(batches):
            m = Members(t, percent)
            yield m.pairs(_all(m) if full else _few(m))

    lead = F.xxhash64("sketch").alias("lead")
    return cells.select("*", lead).repartition("route").sortWithinPartitions("route").mapInArrow(meet, "a long, b long, need int, shared int")


def _sets(df: DataFrame, nodes: DataFrame, need: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(node, hashes) of the needed nodes, from the texts of the documents they are named after."""
    want = settle(nodes.join(need, "node").select("node", "hi", "lo", "rep"), "want")
    fit = F.broadcast if want.count() <= FEW else lambda x: x  # beyond, texts and sets are shuffled
    ids = fit(want.select(F.col("rep").alias("__id")).distinct())
    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    some = one.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = Hashes()
            each = [shingle_set(t.as_py(), k, known).tobytes() for t in b.column(0)]
            names = [xxhash.xxh3_128_digest(x) for x in each]
            hi, lo = (pa.array([int.from_bytes(x[s], "big", signed=True) for x in names], pa.int64()) for s in (slice(0, 8), slice(8, 16)))
            yield pa.RecordBatch.from_arrays([hi, lo, pa.array(each, pa.binary())], ["hi", "lo", "hashes"])

    made = some.mapInArrow(read, "hi long, lo long, hashes binary")
    return made.join(fit(want.select("node", "hi", "lo")), ["hi", "lo"]).select("node", "hashes").dropDuplicates(["node"])


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide sketches do not exclude them."""
    own = lambda to: nodes.select(F.col("node").alias(to), F.struct("n", "wide").alias(f"w{to}"))

    @F.arrow_udf("boolean")
    def fit(x: pa.Array, y: pa.Array) -> pa.Array:
        none = bytes(WIDE // 8)
        p, q = (np.frombuffer(b"".join(v or none for v in c.field("wide").to_pylist()), np.uint64).reshape(len(c), -1) for c in (x, y))
        both = x.field("n").to_numpy() + y.field("n").to_numpy()
        return pa.array(np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= allowed(both, percent))

    met = pairs.join(own("a"), "a").join(own("b"), "b")
    large = F.col("wa.wide").isNotNull() & F.col("wb.wide").isNotNull()
    return met.where(~large | fit("wa", "wb")).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """The pairs that are similar, in whole sets: 100 * shared >= percent * all."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), kind) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(judge, "a long, b long")


def _cells(postings: DataFrame) -> DataFrame:
    """Of postings (token, node, root, ...): lists of up to SMALL are a cell; larger ones are dealt.

    The members of a list's largest component (side 0) are dealt once, by hash, over cells of about CELL, and meet all others (side 1) in
    each; the others meet each other in cells of two blocks (side 0 and 1) or of one (side 2).

    Near copies meet in many lists. Cells of lists whose member of least hash is the same one go one route, where a pair's cells are counted
    before they are shuffled; large ones go PARTS routes, so that a large group is not one task.
    """
    own = postings.groupBy("token", "root").agg(F.count("*").alias("c"), F.min(F.xxhash64("node")).alias("first"))
    lists = own.groupBy("token").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.min("first").alias("first"))
    dealt = postings.join(lists, "token").withColumn("big", F.col("root") == F.col("top.root")).withColumn("h", F.xxhash64("node"))
    k, k2 = F.ceil(F.col("top.c") / CELL), F.ceil((F.col("m") - F.col("top.c")) / CELL)
    part = lambda tag: F.pmod(F.xxhash64("token"), F.lit(PARTS if tag else 1))
    one = lambda tag, i, j, side: F.struct(F.xxhash64("first", F.lit(tag), k, k2, i, j, part(tag)).alias("route"), F.xxhash64("token", F.lit(tag), i, j).alias("cell"), side.cast("int").alias("side"))
    zero, mine, other = F.lit(0).cast("long"), F.pmod("h", k), F.pmod("h", k2)
    upto = lambda n: F.sequence(zero, n - 1)
    alone = F.array(one(0, zero, zero, F.lit(2)))
    large = F.array(one(1, mine, zero, F.lit(0)))
    cross = F.transform(upto(k), lambda i: one(1, i, zero, F.lit(1)))
    among = F.transform(upto(k2), lambda i: one(2, F.least(i, other), F.greatest(i, other), F.when(i == other, 2).when(i > other, 0).otherwise(1)))
    places = F.when(F.col("m") <= SMALL, alone).when(F.col("big"), large).otherwise(F.concat(cross, among))
    return dealt.select(*[c for c in postings.columns if c != "token"], F.inline(places))


def links(nodes: DataFrame, percent: int, sets_of: Callable[[DataFrame], DataFrame], found: DataFrame | None = None, roots: DataFrame | None = None, turns: tuple[str, ...] = ("favourite", "few", "all"), kind: str = "<u8") -> tuple[DataFrame | None, DataFrame | None]:
    """Pairs (a, b) of similar nodes, which connect all that such pairs connect, and the components (node, root) they make; found and roots: what is known before.

    nodes: node, n, sketch, fine, wide, prefix; sets_of gives (node, hashes) of the nodes it is given.
    """
    postings, chosen = _postings(nodes, percent)
    traits = settle(nodes.select("node", "n", "sketch", "fine").join(chosen, "node"), "traits")

    def rooted() -> DataFrame:
        """Postings of lists that hold different components, with the list's length."""
        own = postings.withColumn("root", F.col("node")) if roots is None else postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = own.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x < y").select("token", "m")
        return own.join(mixed, "token")

    def few(df: DataFrame, size: str) -> DataFrame:
        """A long list goes in blocks by hash: rows are few then, and what they miss the last round finds."""
        return df.withColumns({"cell": F.xxhash64("token", F.pmod(F.xxhash64("node"), F.ceil(F.greatest(F.col(size), F.lit(1)) / CELL))), "side": F.lit(2)}).withColumn("route", F.col("cell")).drop("token", size)

    for turn in turns:
        if turn == "favourite":
            cells = few(traits.select(F.col("favourite").alias("token"), "others", "node").withColumns({"level": F.lit(1), "root": F.col("node")}), "others")
        else:
            cells = few(rooted(), "m") if turn == "few" else _cells(settle(rooted().drop("m"), "mixed"))
        sketch = F.col("fine" if turn == "all" else "sketch").alias("sketch")
        met = _candidates(cells.join(traits.select("node", "n", sketch, "need"), "node"), percent, turn == "all")
        enough = met.groupBy("a", "b", "need").agg(F.sum("shared").alias("shared")).where("shared >= need") if turn == "all" else met.select("a", "b").distinct()
        may = settle(enough.select("a", "b"), "met")
        pairs = settle(_possible(may, nodes, percent), "pairs")
        need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = settle(sets_of(need), "sets")
        fit = settle(_similar(pairs, sets, percent, kind), "fit")
        drop(sets, pairs, may)
        if fit.isEmpty():
            continue
        found = fit if found is None else found.unionByName(fit)
        roots = components(found).select("node", "root")
    return found, roots


def described(sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """What links() takes of sets (node, hashes: sorted numbers of that kind)."""

    def read_sets(b: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), kind).astype(np.uint64) for x in b.column(1)]

    late = sets.sparkSession.sparkContext.broadcast(_late(sets.select("node", "hashes"), read_sets))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(_described(x, percent, *late.value) for x in read_sets(b)), strict=True)) or [()] * len(DESCRIBED)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, DESCRIBED_KINDS, strict=True)]], ["node", *DESCRIBED])

    return sets.select("node", "hashes").mapInArrow(read, f"node long, {DESCRIBED_SCHEMA}")


def similar_groups(df: DataFrame, k: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links, itself included) of every row."""
    rows = settle(_rows(df, k, percent, doc_id, text), "rows")
    first = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in DESCRIBED[1:]])
    nodes = settle(first.withColumn("node", F.monotonically_increasing_id()), "nodes")
    _, roots = links(nodes, percent, lambda need: _sets(df, nodes, need, k, doc_id, text))
    tied = nodes.select("node", "hi", "lo", "rep")
    tied = tied.withColumn("root", F.col("node")) if roots is None else tied.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = tied.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = settle(tied.join(least, "root").select("hi", "lo", "component_id"), "components")
    out = rows.select("doc_id", "hi", "lo", "n").join(named, ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
