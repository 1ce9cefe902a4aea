"""Exact top-k of a batch of queries against all rows, by blocks.

A block of queries has a bounded number of them, so it is collected and broadcast; the rows stay where they are. A task scores its rows
against the block with matrix products and keeps each query's k best, so that what is shuffled is k rows a query and task, however
many rows share a term or direction with a query. Of several blocks one is at hand at a time: its hits are written to the shared
folder before the next is collected, and the rows are made once, so neither the plan nor the driver grows with the queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import shared_folder

#: Decimal places to which scores are compared: sums in another order differ beyond.
PLACES = 12


class Best:
    """Each query's k best of the scores seen so far, ties to the smaller key."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.q, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: a row per query, a column per key; -inf for none."""
        rounded = np.round(scores, PLACES)
        q, at = np.nonzero((rounded > -np.inf) & (rounded >= self.least[:, None]))
        key = keys[at] if self.key is None else np.concatenate([self.key, keys[at]])
        q, score = np.concatenate([self.q, q]), np.concatenate([self.score, rounded[q, at]])
        order = np.lexsort((key, -score, q))
        starts = np.flatnonzero(np.diff(q[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        kept = order[place < self.k]
        self.q, self.score, self.key = q[kept], score[kept], key[kept]
        last = order[place == self.k - 1]
        self.least[q[last]] = score[last]


def search(queries: DataFrame, rows: DataFrame, k: int, query: str, key: str, prepare: Callable, per_block: int) -> DataFrame:
    """(query, key, score): some k or more rows of each query among which its k best are.

    prepare makes of a block of query rows what a task scores with: a function of a record batch of `rows` (key first) that gives the
    matrix of scores, a row per query. At most some 2 * per_block queries are broadcast together.
    """
    blocks = max(1, -(-queries.count() // per_block))
    if blocks > 1:  # a hash deals about per_block to each
        queries = queries.withColumn("__b", F.pmod(F.xxhash64(query), F.lit(blocks)))
    kind = rows.select(key).schema[0].dataType.simpleString()
    schema = f"{query} {queries.select(query).schema[0].dataType.simpleString()}, {key} {kind}, score double"

    spark, at = rows.sparkSession, ""
    rows = rows.where(F.col(key).isNotNull())
    if blocks > 1:
        at = f"{shared_folder(spark)}/quarry-blocks-{uuid.uuid4().hex}"
        rows.write.parquet(f"{at}/rows")
        rows = spark.read.parquet(f"{at}/rows")

    def one(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast([tuple(r) for r in block])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, score = [r[0] for r in shared.value], prepare(shared.value)
            best, like = Best(len(names), k), None
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    like = b.column(0).type
                    best.add(score(b), np.array(b.column(0).to_pylist()))
            if like is not None and len(best.q):
                asked = pa.array([names[i] for i in best.q.tolist()])
                yield pa.RecordBatch.from_arrays([asked, pa.array(best.key.tolist(), like), pa.array(best.score)], [query, key, "score"])

        return rows.mapInArrow(scan, schema)

    if blocks == 1:
        return one(queries.collect())
    for i in range(blocks):
        one(queries.where(F.col("__b") == i).drop("__b").collect()).write.mode("append").parquet(f"{at}/hits")
    return spark.read.schema(schema).parquet(f"{at}/hits")


def best_of(hits: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Each query's k best hits by score, with their rank; ties to the smaller key."""
    order = W.partitionBy(query).orderBy(F.desc(F.round("score", PLACES)), F.asc(key))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosines(block: list) -> Callable:
    """For search(): query rows (id, vector), rows (key, vector); vectors of other lengths count as padded with zeros."""
    width = max([len(r[1]) for r in block], default=1) or 1
    q = np.zeros((len(block), width))
    for i, r in enumerate(block):
        q[i, : len(r[1])] = r[1]

    def score(b: pa.RecordBatch) -> np.ndarray:
        v = np.zeros((b.num_rows, max(width, max(map(len, b.column(1)), default=0))))
        for i, x in enumerate(b.column(1).to_pylist()):
            v[i, : len(x)] = x
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (q @ v[:, :width].T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :])
        return np.where(np.isfinite(s), s, -np.inf)

    return score


def shared_terms(block: list) -> Callable:
    """For search(): query rows (id, {term: weight}), rows (key, tokens); a row's weight of a term is its share of the tokens."""
    number: dict[str, int] = {}
    postings: list[list[tuple[int, float]]] = []
    for i, r in enumerate(block):
        for term, w in r[1].items():
            if term not in number:
                number[term] = len(postings)
                postings.append([])
            postings[number[term]].append((i, w))
    n = len(block)
    sizes = np.array([len(p) for p in postings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    who = np.array([i for p in postings for i, _ in p], np.int64)
    weight = np.array([w for p in postings for _, w in p])

    def score(b: pa.RecordBatch) -> np.ndarray:
        lists = b.column(1)
        words = lists.flatten().dictionary_encode()
        known = np.array([number.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
        length = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(b.num_rows), length)
        term = known[words.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
        pairs, times = np.unique(doc[term >= 0] * max(1, len(sizes)) + term[term >= 0], return_counts=True)
        doc, term = pairs // max(1, len(sizes)), pairs % max(1, len(sizes))
        own = times / length[doc]
        out = np.zeros(n * b.num_rows)
        for a in range(0, len(doc), 20_000):  # a term that all queries have meets them all
            part = slice(a, a + 20_000)
            k = sizes[term[part]]
            at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts[term[part]], k)
            out += np.bincount(who[at] * b.num_rows + np.repeat(doc[part], k), np.repeat(own[part], k) * weight[at], minlength=len(out))
        s = out.reshape(n, b.num_rows)
        return np.where(s > 0, s, -np.inf)

    return score
