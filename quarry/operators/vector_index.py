"""An approximate index over dense vectors (C5, C16): inverted lists of product-quantised residuals, with exact scores at the end.

A bounded sample of vectors, chosen by a hash of their keys, fits the centres of the lists and, for each part of a vector, the centres of what is left after
the list's own. Every row is indexed: its list and one byte a part. A search reads the lists nearest to any query of a block, scores codes with one table look-up a part,
keeps some candidates of each query in each task, and scores these by their whole vectors. dense_top_k is the exact way beside it; the
approximate one may miss neighbours, so its recall is measured (tests: 0.9 or more).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.session import shared_folder

#: Vectors that fit the centres (the bound of what is collected); rounds of fitting; centres of a part; lists.
SAMPLE, ROUNDS, CODES, MOST = 20_000, 12, 256, 1024


class VectorIndex(NamedTuple):
    """rows: key, list, codes, v (the unit vector), sorted by list; centres: of the lists; books: parts x CODES x width."""

    rows: DataFrame
    centres: np.ndarray
    books: np.ndarray
    at: str


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of the rows of x (fewer if there are fewer rows), by rounds of nearest centre and mean; empty ones stay where they were."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(ROUNDS):
        own = np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _units(column: pa.Array, width: int) -> np.ndarray:
    x = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        x[i, : min(width, len(v))] = v[:width]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _coded(x: np.ndarray, centres: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest list of each row, and the nearest centre of each part of what is left."""
    own = np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
    left = (x - centres[own]).reshape(len(x), len(books), -1)
    codes = [np.argmin((b * b).sum(axis=1)[None, :] - 2 * left[:, i] @ b.T, axis=1) for i, b in enumerate(books)]
    return own, np.stack(codes, axis=1).astype(np.uint8)


def usable(vectors: DataFrame, embedding: str):
    """Vectors that take part: not null, without nulls, finite and of some length."""
    return vectors.where(F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & (x.cast("double") * 0 == 0)) & F.exists(embedding, lambda x: x != 0))


def build(vectors: DataFrame, key: str = "chunk_id", embedding: str = "embedding", lists: int | None = None, parts: int = 16, path: str | None = None, seed: int = 0) -> VectorIndex:
    """Some square root of the rows is the number of lists, if none is given (MOST at most). Fits on about SAMPLE rows at most and indexes every usable row; vectors are taken as of the longest one's length in the sample, which parts must divide (it is padded with zeros)."""
    spark = vectors.sparkSession
    own = usable(vectors, embedding).select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("v")).where("key is not null")
    total = own.count()
    lists = lists or min(MOST, math.isqrt(total) + 1)
    share = min(1.0, SAMPLE / max(1, total))
    some = own.where(F.xxhash64("key", F.lit(seed)) <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else own
    got = [r.v for r in some.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(SAMPLE + SAMPLE // 10).collect()]  # bounded
    width = -(-max([len(v) for v in got], default=1) // parts) * parts
    x = _units(pa.array(got, pa.list_(pa.float64())), width)
    centres = _means(x, lists, seed) if len(x) else np.zeros((1, width))
    left = (x - centres[np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)]).reshape(len(x), parts, -1) if len(x) else np.zeros((1, parts, width // parts))
    books = np.zeros((parts, CODES, width // parts))
    for i in range(parts):
        found = _means(left[:, i], CODES, seed + i)
        books[i] = found[np.arange(CODES) % len(found)]
    shared = spark.sparkContext.broadcast((centres, books))  # lists x width and CODES x width numbers

    def code(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                units = _units(b.column("v"), width)
                own, codes = _coded(units, *shared.value)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(units), pa.list_(pa.float64()))], ["key", "list", "codes", "v"])

    kind = dict(own.dtypes)["key"]
    at = path or f"{shared_folder(spark)}/quarry-vectors-{uuid.uuid4().hex}"
    coded = own.mapInArrow(code, f"key {kind}, list int, codes binary, v array<double>")
    # a list may hold a large part of all rows: it is dealt over several ranges
    coded.repartitionByRange("list", "key").sortWithinPartitions("list").write.parquet(at)
    return VectorIndex(spark.read.schema(f"key {kind}, list int, codes binary, v array<double>").parquet(at), centres, books, at)


def _scored(index_centres: np.ndarray, books: np.ndarray, probes: int) -> Callable:
    """For blocks.search: of a block of queries (id, vector), what scores rows (key, list, codes): inner products with the coded vectors of the nearest lists."""

    def prepare(block: list) -> Callable:
        width = index_centres.shape[1]
        q = _units(pa.array([r[1] for r in block], pa.list_(pa.float64())), width)
        near = q @ index_centres.T
        least = np.sort(near - (index_centres**2).sum(axis=1) / 2, axis=1)[:, -min(probes, near.shape[1])]
        open_ = near - (index_centres**2).sum(axis=1) / 2 >= least[:, None]
        table = np.einsum("qpw,pcw->qpc", q.reshape(len(q), len(books), -1), books)

        def score(b: pa.RecordBatch) -> np.ndarray:
            lists = b.column("list").to_numpy()
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, len(books))
            out = np.full((len(q), b.num_rows), -np.inf)
            for one in np.unique(lists).tolist():
                asked, rows = np.flatnonzero(open_[:, one]), np.flatnonzero(lists == one)
                if len(asked):
                    part = near[asked, one][:, None] + sum(table[asked, p][:, codes[rows, p]] for p in range(len(books)))
                    out[np.ix_(asked, rows)] = part
            return out

        return score

    return prepare


def top_k(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, more: int = 8, query: str = "query_id", key: str = "chunk_id", embedding: str = "embedding", per_block: int = 1024) -> DataFrame:
    """(query, key, score, rank) by cosine, ties to the smaller key, among the candidates: some more * k or more of the best codes in each query's `probes` nearest lists (if none are given 16, or half of the lists if these are more: vectors without clusters have neighbours in many)."""
    asked = usable(queries, embedding).select(F.col(query).alias("query"), F.col(embedding).cast("array<double>").alias("q"))
    coded = index.rows.select("key", "list", "codes")
    found = blocks.search(asked, coded, more * k, "query", "key", _scored(index.centres, index.books, probes or max(16, len(index.centres) // 2)), per_block)
    best = blocks.best_of(found, "query", "key", more * k)
    unit = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    width = index.centres.shape[1]
    padded = F.slice(F.concat("q", F.array_repeat(F.lit(0.0), width)), 1, width)
    both = best.select("query", "key").join(index.rows.select("key", "v"), "key").join(asked, "query")
    exact = both.select("query", "key", (F.aggregate(F.zip_with(padded, "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / unit).alias("score"))
    return blocks.best_of(exact, "query", "key", k).select(F.col("query").alias(query), F.col("key").alias(key), "score", "rank")
