"""A stored index over sparse vectors, with block-max top-k.

A task puts some thousand chunks at a time in order of their length and cuts them into spans of 64. As a term's weight is its share of the chunk's tokens, a span's chunks have weights of one
size, so a block, the postings of a term in a span, has a tight maximum; its postings are in order of impact, the largest first. A span's chunks are of one task, so its blocks are made
there, and nothing is shuffled to build an index.

A query's score in a span is at most the sum of its weights times the blocks' maxima. Some promising spans of each query are scored first; their k-th score
is a floor. After that only spans whose bound reaches the floor are read, and of their blocks only the postings with which a chunk
can still reach it: a chunk below is in no result, so what is left out changes none. Nothing is collected. The spans to read are written and sent to the blocks, at most MOST at once and each query's together,
as a join by shuffle would move every block of an asked term once for each query; with more of them the blocks are read again, and only each query's k best are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.session import shared_folder

#: Bits of a chunk's place within its span, and of a span's number within its task; spans scored first for each query.
SPAN, SPANS, FIRST = 6, 33, 4
#: Chunks, or bytes of their tokens, that a task puts in order together.
WINDOW, WINDOW_BYTES = 8192, 1 << 25
#: Spans to read that are sent to the blocks at once.
MOST = 500_000
#: Scores that differ by less are ties.
SLACK = 1e-8


class SparseIndex(NamedTuple):
    """blocks: term, span, top, postings (array of weight, key by falling weight)."""

    blocks: DataFrame
    at: str


def build(chunks: DataFrame, key: str = "chunk_id", text: str = "text", path: str | None = None) -> SparseIndex:
    """Writes the index of all chunks under the path (a new folder of the shared one, if there is none) and returns it.

    Chunks without tokens have no postings; a null key takes no part; of a key that repeats, each chunk is indexed.
    """
    spark = chunks.sparkSession
    at = path or f"{shared_folder(spark)}/quarry-index-{uuid.uuid4().hex}"
    own = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), tx.tokens(text).alias("t"))
    kind = own.schema["key"].dataType.simpleString()
    made = own.mapInArrow(_blocks, f"term string, span long, top double, postings array<struct<weight:double,key:{kind}>>")
    made.write.option("compression", "zstd").parquet(f"{at}/blocks")
    return opened(spark, at)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's chunks (key, tokens)."""
    task, spans, held = TaskContext.get().partitionId(), 0, []
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            held.append(b.slice(i, 1024))
            if sum(x.num_rows for x in held) >= WINDOW or sum(x.nbytes for x in held) >= WINDOW_BYTES:
                yield from _window(held, task, spans)
                spans, held = spans + (sum(x.num_rows for x in held) >> SPAN) + 1, []
    if held:
        yield from _window(held, task, spans)


def _window(held: list[pa.RecordBatch], task: int, spans: int) -> Iterator[pa.RecordBatch]:
    """The blocks of these chunks, whose spans are numbered from `spans` within the task, by term."""
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    lists = t.column(1)
    n = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    terms = words.dictionary
    order = np.argsort(n, kind="stable")
    span = np.empty(len(n), np.int64)
    span[order] = np.arange(len(n)) >> SPAN
    by_name = np.empty(len(terms), np.int64)
    named = pc.sort_indices(terms).to_numpy()
    by_name[named] = np.arange(len(terms))
    # one number for the term, the span and the chunk: equal ones are a chunk's repeats of a word
    width = (len(n) >> SPAN) + 1
    pairs, times = np.unique((by_name[words.indices.to_numpy()] * width + np.repeat(span, n)) * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    block, chunk = np.divmod(pairs, len(n))
    weight = times / n[chunk]
    best = np.lexsort((-weight, block))
    block, chunk, weight = block[best], chunk[best], weight[best]
    first = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(first, len(block))
    for i in range(0, len(first), 20_000):
        part = slice(i, i + 20_000)
        lo, hi = ends[i], ends[min(i + 20_000, len(first))]
        term, place = np.divmod(block[first[part]], width)
        inner = pa.StructArray.from_arrays([pa.array(weight[lo:hi]), t.column(0).take(pa.array(chunk[lo:hi]))], ["weight", "key"])
        postings = pa.ListArray.from_arrays(pa.array((ends[i : i + len(term) + 1] - lo).astype(np.int32)), inner)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(named[term])), pa.array((task << SPANS) + spans + place), pa.array(weight[first[part]]), postings], ["term", "span", "top", "postings"])


def opened(spark, path: str) -> SparseIndex:
    """An index that was built under the path."""
    return SparseIndex(spark.read.parquet(f"{path}/blocks"), path)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder, so that it is counted and read without being made again."""
    at = f"{shared_folder(df.sparkSession)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _scores(asked: DataFrame, blocks: DataFrame, spans: DataFrame, floor: bool) -> DataFrame:
    """(query, key, weight): products of the postings of the spans (query, span, bound); with a floor, without those that cannot reach it."""
    met = blocks.select("term", "span", "top", "postings").join(asked, "term").join(F.broadcast(spans) if spans.count() <= 2 * MOST else spans, ["query", "span"])
    if floor:  # what the other terms can add at most is the bound less this block's part
        least = (F.col("floor") - SLACK - F.col("bound")) / F.col("w") + F.col("top")
        met = met.withColumn("postings", F.filter("postings", lambda p: p["weight"] >= least))
    return met.select("query", "w", F.explode("postings").alias("p")).select("query", F.col("p.key").alias("key"), (F.col("w") * F.col("p.weight")).alias("part"))


def candidates(queries: DataFrame, index: SparseIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """For queries (query, term, w > 0): the parts of scores that are read (query, key, part), and the spans read (query, span, bound, floor).

    Every chunk among a query's k best has all its parts there.
    """
    spans = _spans(queries, index, k)
    return _scores(queries, index.blocks, spans, True), spans


def _spans(queries: DataFrame, index: SparseIndex, k: int) -> DataFrame:
    """(query, span, bound, floor) of the spans that can hold one of a query's k best."""
    tops = index.blocks.select("term", "span", "top")
    bounds = _kept(tops.join(queries, "term").groupBy("query", "span").agg(F.sum(F.col("w") * F.col("top")).alias("bound")), "bounds")
    # promising spans: the FIRST with the largest bounds and as many more as k chunks need
    some = bounds.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "span"))).where(F.col("r") <= FIRST + (k >> SPAN)).select("query", "span", "bound")
    first = _scores(queries, index.blocks, _kept(some, "first"), False).groupBy("query", "key").agg(F.sum("part").alias("score"))
    kth = first.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("r") == k).select("query", F.col("score").alias("floor"))
    asked = queries.select("query").distinct().join(kth, "query", "left").select("query", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    return _kept(bounds.join(asked, "query").where(F.col("bound") >= F.col("floor") - SLACK).select("query", "span", "bound", "floor"), "spans")


def top_k(queries: DataFrame, index: SparseIndex, k: int, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """(query, key, score, rank) by the dot product over shared terms, ties to the smaller key. queries: query, term, weight; weights of zero or less take no part."""
    asked = queries.where("weight > 0").select(F.col(query).alias("query"), "term", F.col("weight").alias("w"))
    spans = _spans(asked, index, k)

    def best(some: DataFrame) -> DataFrame:
        score = _scores(asked, index.blocks, some, True).groupBy("query", "key").agg(F.sum("part").alias("score"))
        ranked = score.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.asc("key")))).where(F.col("rank") <= k)
        return ranked.select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")

    turns = -(-spans.count() // MOST)
    if turns <= 1:
        return best(spans)
    spark, at = spans.sparkSession, f"{shared_folder(spans.sparkSession)}/quarry-best-{uuid.uuid4().hex}"
    for i in range(turns):
        best(spans.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == i)).write.mode("append").parquet(at)
    return spark.read.parquet(at)
