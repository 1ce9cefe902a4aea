"""The stored sparse index against plain Python, and how much of it a search reads; searches in several blocks of queries."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as rt
from quarry.operators import sparse_index as si

WORD = re.compile(r"\w+")


def weights(t):
    own = [w.lower() for w in WORD.findall(t or "")]
    return {w: n / len(own) for w, n in collections.Counter(own).items()}


def brute(queries, chunks, k):
    out = {}
    for q, asked in queries:
        a, score = weights(asked), []
        for c, t in chunks:
            w = weights(t)
            if c is not None and (common := set(a) & set(w)):
                score.append((-round(sum(a[x] * w[x] for x in common), 9), c))
        out[q] = [c for _, c in sorted(score)[:k]]
    return out


def corpus(rnd, n):
    vocab = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 20, 60, 60, 400])))) for i in range(n)]


CHUNK, ASKED = "chunk_id long, text string", "query_id long, query string"


def test_index_gives_the_best_and_skips(spark, tmp_path):
    rnd = random.Random(9)
    chunks = [*corpus(rnd, 900), (2000, None), (2001, "  "), (None, "w1 w2"), (2002, "w1"), (2003, "w1")]
    queries = [(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randrange(1, 9)))) for i in range(30)] + [(99, ""), (98, "nowhere"), (97, None)]
    index = si.build(spark.createDataFrame(chunks, CHUNK), path=str(tmp_path / "index"))
    asked = rt.sparse_vectors(spark.createDataFrame(queries, ASKED), "query_id", "query")
    got = collections.defaultdict(list)
    for r in sorted(si.top_k(asked, si.opened(spark, index.at), 5).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.chunk_id)
    want = brute(queries, chunks, 5)
    assert all(got.get(q, []) == w for q, w in want.items()) and got.keys() <= want.keys()
    # of the postings of the asked terms a part is read; every block holds one span, by falling weight
    named = asked.select(F.col("query_id").alias("query"), "term", F.col("weight").alias("w"))
    parts, spans = si.candidates(named, index, 5)
    every = named.join(index.blocks, "term").agg(F.sum(F.size("postings"))).first()[0]
    regions = named.join(index.blocks, "term").select("query", "span").distinct().count()
    assert parts.count() < 0.6 * every and spans.count() < 0.9 * regions
    assert index.blocks.where("size(postings) > 64 or top <> postings[0].weight").isEmpty()


def test_many_spans_and_no_shuffle_of_blocks(spark, tmp_path, monkeypatch):
    """An index is built without a shuffle and the blocks meet the queries without one; spans sent in several turns give the same."""
    rnd = random.Random(2)
    chunks = corpus(rnd, 700)
    queries = [(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(5))) for i in range(12)]
    df = spark.createDataFrame(chunks, CHUNK)
    made = []
    write = type(df.write).parquet
    monkeypatch.setattr(type(df.write), "parquet", lambda self, path, *a, **b: made.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, path, *a, **b))
    index = si.build(df, path=str(tmp_path / "index"))
    assert made and not any("Exchange" in p for p in made)
    asked = rt.sparse_vectors(spark.createDataFrame(queries, ASKED), "query_id", "query").persist()
    once = si.top_k(asked, index, 5)
    assert "SortMergeJoin" not in once._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(si, "MOST", 20)
    assert sorted(map(tuple, si.top_k(asked, index, 5).collect())) == sorted(map(tuple, once.collect()))


def test_index_of_nothing(spark, tmp_path):
    none = si.build(spark.createDataFrame([], CHUNK), path=str(tmp_path / "none"))
    asked = rt.sparse_vectors(spark.createDataFrame([(1, "a")], ASKED), "query_id", "query")
    assert si.top_k(asked, none, 3).isEmpty()


@pytest.mark.parametrize("per_block", [7, 512])
def test_blocks_of_queries(spark, per_block):
    """Many blocks give what one gives, with a plan of one scan."""
    rnd = random.Random(4)
    chunks, queries = corpus(rnd, 200), [(i, f"w{i % 9} w{i % 4}") for i in range(40)]
    hits = rt.sparse_search(spark.createDataFrame(queries, ASKED), spark.createDataFrame(chunks, CHUNK), 4, per_block=per_block)
    got = collections.defaultdict(list)
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got[r.query_id].append(r.chunk_id)
    want = brute(queries, chunks, 4)
    assert all(got.get(q, []) == w for q, w in want.items())
    assert "Union" not in hits._jdf.queryExecution().toString()
