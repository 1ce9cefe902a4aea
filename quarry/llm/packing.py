"""Best-fit packing by hierarchical residual rounds.

Documents become pieces of at most `size` tokens. A piece of exactly `size` is a sequence of its own. The others are packed by
best fit, longest first, within each partition; bins filled to `size - slack` or more are emitted, and the rest go up a tree
as items: eight partitions' bins meet in one, are packed again, and so on until a task holds all that is left, or about
`per_task` bins. A bin carries its members, at most `size` of them, so no round needs to look back at the documents.

Defined results: null text is empty (its only token is the end mark); repeated rows are packed each; null doc_id is kept; texts of any
length and content are encoded whole (millions of spaces or of one letter, too); strings of the file's added tokens get their ids, as
the library's encode gives them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle
from quarry.llm.tokens import ByteBPE, groups

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(df: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document (tokenizer: the path of a tokenizer.json on the driver): its ids, then `end`, cut from the back, so that only the first piece may be shorter."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = ByteBPE.of(spec.value), end.to_bytes(4, "little")
        for b in batches:
            docs = iter(b.column(0).to_pylist())
            for texts in groups(b.column(1)):
                rows = []
                for ids, doc in zip(encoder.ids(texts), docs):  # noqa: B905
                    ids += last
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        stop = at + ((n - at - 1) % size + 1 if not at else size)
                        rows.append((doc, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                        at, k = stop, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECE, strict=True)], [t.name for t in _PIECE])

    return one.mapInArrow(cut, PIECE)


def best_fit(fills: list[int], size: int) -> list[list[int]]:
    """Indexes of the items in each bin; best fit, longest first, ties in the order given. free has a bit for each amount of room that some bin has."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]
    free = 0
    for i in sorted(range(len(fills)), key=lambda i: -fills[i]):
        n = fills[i]
        if fit := free >> n:
            r = n + (fit & -fit).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, k = size, len(bins)
            bins.append([])
        bins[k].append(i)
        if r > n:
            room[r - n].append(k)
            free |= 1 << (r - n)
    return bins


#: Items that a task packs together.
TOGETHER = 200_000
_BIN = f"fill int, open boolean, members array<struct<{PIECE.replace(' long', ':long').replace(' int', ':int')}>>"


def _round(bins: DataFrame, size: int, slack: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TOGETHER:
                yield from together(held)
                held = []
        yield from together(held)

    def together(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not any(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).combine_chunks()
        fills, members = t.column("fill").to_pylist(), t.column("members").combine_chunks()
        offsets, flat = members.offsets.to_pylist(), members.values
        out = best_fit(fills, size)
        for at in range(0, len(out), 5000):
            part = out[at : at + 5000]
            take, ends = [], [0]
            for b in part:
                for i in b:
                    take.extend(range(offsets[i], offsets[i + 1]))
                ends.append(len(take))
            full = [sum(fills[i] for i in b) for b in part]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([f < size - slack for f in full], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(take, pa.int64())))], ["fill", "open", "members"])

    return bins.select("fill", "members").mapInArrow(pack, _BIN)


def pack(found: DataFrame, size: int = 1024, slack: int = 8, per_task: int = 20_000) -> DataFrame:
    """found (the columns of PIECE) with sequence_id and offset."""
    spark = found.sparkSession
    item = found.select(F.col("length").cast("int").alias("fill"), F.array(F.struct(*[f.name for f in _PIECE])).alias("members"))
    whole = item.where(F.col("fill") == size)
    now = settle(_round(item.where(F.col("fill") < size), size, slack), "bins")
    done = [whole, now.where("not open").select("fill", "members")]
    tasks = max(1, found.rdd.getNumPartitions())
    while True:
        rest = now.where("open")
        left = rest.count()
        fewer = max(tasks // 8, -(-left // per_task), 1)
        if left < 2 or fewer >= tasks:
            done.append(rest.select("fill", "members"))
            break
        tasks = fewer
        # dealt by a hash of the members, so that each task gets bins of every fill
        now = settle(_round(rest.repartition(tasks, F.hash("members")), size, slack), "bins")
        done.append(now.where("not open").select("fill", "members"))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    bins = bins.withColumn("sequence_id", F.monotonically_increasing_id())
    before = F.expr("aggregate(slice(members, 1, pos), 0L, (acc, m) -> acc + m.length)")
    return bins.select("sequence_id", "members", F.posexplode("members").alias("pos", "m")).select("m.*", "sequence_id", before.alias("offset"))
