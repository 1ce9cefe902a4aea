"""Exact top-k search by a vector-approximation file.

1. Every dimension's range over the whole table is cut into CELLS cells; a table is written that holds, beside each exact vector, its
   cells, one byte a dimension. This column is the approximation file.
2. For a block of queries (of bounded size, so it is broadcast) the cells alone are scanned. They give a lower and an upper bound of
   every inner product. A task keeps what its own k-th lower bound does not rule out; the k-th lower bound over all tasks then
   rules out the rest, but for few.
3. Exact vectors are read in the order of their upper bounds: first of each query's 2k best; then of those whose upper bound still
   reaches the k-th exact score. What is left cannot be among the k best.

Copies: of rows with one vector only the 2k smallest ids (k rows of one id at most) can be among any query's k best, so no more are
indexed, however many there are. The grouping keeps that many per task before it shuffles.

Defined results: vectors that are null, hold null or non-finite components, or lack an id take no part; shorter vectors count
as padded with zeros; rows with the query's own id are not its candidates; repeated rows count once each, as queries and as candidates;
ties go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import scratch, settle

CELLS = 256
#: Queries that are broadcast together.
PER_BLOCK = 8192
#: Candidates that a task holds before it rules out again.
HELD = 500_000


class Grid:
    """Cells of integer vectors (rows), and bounds of inner products from them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low, self.high = low.astype(np.float64), high.astype(np.float64)
        self.step = np.maximum(1.0, np.ceil((self.high - self.low + 1) / cells))
        self.half = (self.step - 1) / 2

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.low) // self.step).astype(np.uint8)

    def middles(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The inner products with the cells' centres, a row per query. A cell holds the integers from low + cell * step on, step of them."""
        return q @ (self.low + self.half + cells * self.step).T

    def spread(self, q: np.ndarray) -> np.ndarray:
        """How far, for each query, an exact product may be from its middle; with room for the rounding of very large sums."""
        size = np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high))
        return np.abs(q) @ self.half + np.where(size < 2.0**50, 0.0, size * 1e-13 * max(1, q.shape[1]))


def kept(grid: Grid, q: np.ndarray, q_ids: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, held: int = HELD) -> tuple[np.ndarray, ...]:
    """query's index, key and middle of the candidates that the k best middles so far do not rule out; blocks have (keys, ids, cells)."""
    spread = grid.spread(q)
    best = np.full((len(q), k), -np.inf)
    found: list[tuple[np.ndarray, ...]] = []

    def ruled() -> None:
        if found:
            i, key, m = (np.concatenate(x) for x in zip(*found, strict=True))
            ok = m + spread[i] >= best[i, 0] - spread[i]
            found[:] = [(i[ok], key[ok], m[ok])]

    for keys, ids, cells in blocks:
        m = grid.middles(q, cells)
        m[q_ids[:, None] == ids[None, :]] = -np.inf
        top = np.concatenate([best, m], axis=1)
        best = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
        best.sort(axis=1)
        i, j = np.nonzero((m + spread[:, None] >= best[:, :1] - spread[:, None]) & (m > -np.inf))
        found.append((i, keys[j], m[i, j]))
        if sum(len(x[0]) for x in found) > held:
            ruled()
    ruled()
    return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def approximation_file(vectors: DataFrame, queries: Column, k: int, scale: int, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame, Grid]:
    """The table (key, id, v, cells) of what may be found, the queries (key, id, v), and the grid."""
    x = F.col(embedding)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    # floor of a double beyond long would wrap; such components are outside what scores of type long can hold
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, finite)).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    rows = settle(rows.select(F.monotonically_increasing_id().alias("key"), "id", padded.alias("v"), "asks"), "vectors")
    ranges = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()  # a row per dimension
    grid = Grid(np.array([r.low for r in ranges] or [0] * width), np.array([r.high for r in ranges] or [0] * width))
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("v", "id").orderBy("key"))).where(F.col("n") <= k)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id", "key"))).where(F.col("n") <= 2 * k)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = grid.cells(b.column("v").flatten().to_numpy().reshape(-1, width))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in cells], pa.binary())], ["key", "id", "v", "cells"])

    file = settle(few.select("key", "id", "v").mapInArrow(quantise, "key long, id long, v array<long>, cells binary"), "approximations")
    return file, rows.where("asks").select("key", "id", "v"), grid


def bounded(file: DataFrame, block: list, grid: Grid, k: int) -> DataFrame:
    """(q, key, id, lower, upper) of the candidates of a block of queries (key, id, v) that scanning the cells leaves, a task's own best k ruling out the others."""
    width = len(grid.low)
    q = np.array([r["v"] for r in block], np.float64).reshape(-1, width)
    shared = file.sparkSession.sparkContext.broadcast((q, np.array([r["id"] for r in block], np.int64), np.array([r["key"] for r in block], np.int64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids, q_keys = shared.value
        own = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), np.uint8, width)) for b in batches if b.num_rows]
        for at in range(0, len(q), 512):
            part = slice(at, at + 512)
            pieces = ((key[i : i + 2000], ids[i : i + 2000], cells[i : i + 2000]) for key, ids, cells in own for i in range(0, len(key), 2000))
            i, keys, m = kept(grid, q[part], q_ids[part], pieces, k)
            s = grid.spread(q[part])[i]
            yield pa.RecordBatch.from_arrays([pa.array(q_keys[part][i]), pa.array(keys), pa.array(m - s), pa.array(m + s)], ["q", "key", "lower", "upper"])

    return file.select("key", "id", "cells").mapInArrow(scan, "q long, key long, lower double, upper double")


def _scored(found: DataFrame, file: DataFrame, queries: DataFrame) -> DataFrame:
    """found with the candidate's id, the query's id and their exact score: reads an exact vector for each row."""
    mine = queries.select(F.col("key").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
    both = found.join(file.select("key", F.col("id").alias("vec_id"), "v"), "key").join(mine, "q")
    score = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("q", "key", "query_id", "vec_id", score.alias("score"))


def _best(file: DataFrame, queries: DataFrame, found: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """The k best of every query of found (q, key, lower, upper), and the tables of which each row read an exact vector: two passes over them altogether."""
    by = W.partitionBy("q")
    certain = found.withColumn("n", F.row_number().over(by.orderBy(F.desc("lower")))).where(F.col("n") == k).select("q", F.col("lower").alias("least"))
    may = found.join(certain, "q", "left").where("least is null or upper >= least").drop("least")
    ranked = settle(may.withColumn("n", F.row_number().over(by.orderBy(F.desc("upper"), "key"))), "ranked")
    first = settle(_scored(ranked.where(F.col("n") <= 2 * k), file, queries), "first")
    order = by.orderBy(F.desc("score"), "vec_id", "key")
    certain = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("q", F.col("score").alias("least"))
    rest = ranked.where(F.col("n") > 2 * k).join(certain, "q").where(F.col("upper") >= F.col("least"))
    rest = settle(_scored(rest.select("q", "key"), file, queries), "rest")
    best = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), [first, rest]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", per_block: int = PER_BLOCK, reads: list | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of floor(scale * x) vectors for each row where queries (a condition on vec_id) holds, against all rows.

    Queries are taken in blocks of about per_block, each a scan of the cells whose survivors are written; exact vectors are read
    when those of all blocks are known. reads, if given, gets the number of exact vectors that survivors read.
    """
    file, asked, grid = approximation_file(vectors, queries, k, scale, vec_id, embedding)
    blocks = max(1, -(-asked.count() // per_block))
    path = f"{scratch(file.sparkSession)}/quarry-bounded-{file.settled_at.rsplit('-', 1)[-1]}"
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # about per_block rows
        bounded(file, block, grid, k).write.mode("append").parquet(path)
    found = file.sparkSession.read.schema("q long, key long, lower double, upper double").parquet(path)
    best, read = _best(file, asked, found, k)
    if reads is not None:
        reads.extend(t.count() for t in read)
    return best
