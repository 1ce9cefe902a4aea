"""Queries that SQL does not express, against plain Python over the same tables."""

import collections
import json
import math
import re

import pytest

from quarry.functions import text as tx
from quarry.operators import blocks, flows
from quarry.operators import retrieval as rt
from quarry.plans import documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def bm25(query, texts):
    """{id: score} within the candidates {id: text}."""
    toks = {i: [w.lower() for w in WORD.findall(t)] for i, t in texts.items()}
    n, avg = len(toks), max(1.0, sum(map(len, toks.values())) / len(toks))
    out = dict.fromkeys(texts, 0.0)
    for term in {w.lower() for w in WORD.findall(query)}:
        has = {i: t.count(term) for i, t in toks.items() if term in t}
        for i, f in has.items():
            out[i] += math.log(1 + (n - len(has) + 0.5) / (len(has) + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks[i]) / avg))
    return out


def test_context_pack(spark, docs, items):
    hits = collections.defaultdict(list)
    for r in documents.sparse_search_hits(spark, SF).collect():
        hits[r.query_id].append(r.chunk_id)
    got = collections.defaultdict(list)
    for r in documents.context_pack(spark, SF).collect():
        got[r.query_id].append((r.place, r.chunk_id, r.chars, r.original_chars, r.packed_chars, r.dropped))
    assert set(got) == set(hits)
    for q, ids in hits.items():
        scores = bm25(items[q], {i: docs[i] for i in ids})
        packed, used = [], 0
        for i in sorted(ids, key=lambda i: (-round(scores[i], 9), i)):
            s = docs[i].strip(" ")[:800]
            if s and len(packed) < 6 and used < 4000 and (not packed or used + len(s) <= 4000):
                packed.append((i, len(s)))
                used += len(s)
        whole = sum(len(docs[i]) for i in ids)
        assert sorted(got[q]) == [(p, i, n, whole, used, len(ids) - len(packed)) for p, (i, n) in enumerate(packed)]


def test_decompose(spark, items):
    want = []
    for i, text in items.items():
        parts = [p.strip() for p in re.split("[,.]+", text)]
        merged = []
        for p in [p for p in parts if p]:
            if merged and (len(p) < 20 or p.startswith(("and", "of"))):
                merged[-1] += "," + p
            else:
                merged.append(p)
        want += [(i, n + 1, p) for n, p in enumerate(merged or [text])]
    assert sorted((r.item_id, r.sub_no, r.description) for r in documents.decompose(spark, SF).collect()) == sorted(want)


def test_sectionize(spark, docs):
    anchor, want = re.compile(tx.ANCHOR), []
    for d, text in docs.items():
        found, now = [], None
        for line in text.split("\n"):
            s = line.strip()
            m = re.match(r"(#{1,6})\s+\S", s)
            if s and (anchor.search(s) or m and len(m[1]) <= 2):
                now = [s[:64], (re.sub(r"^#{1,6}\s+", "", s).strip() if m else s)[:64], [line]]
                found.append(now)
            elif now is None:
                now = ["preamble", "preamble", [line]]
                found.append(now)
            else:
                now[2].append(line)
        kept = [(a, t, "\n".join(x).strip()) for a, t, x in found]
        want += [(d, n, a, t, len(c)) for n, (a, t, c) in enumerate(x for x in kept if x[2])]
    got = [tuple(r) for r in documents.sectionize(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_insight_summary(spark):
    rows = [(1, 0, "a", None), (1, 1, "b", "h1"), (1, 2, "a", "h2"), (1, 3, "a", "h1"), (2, 0, "c", None)]
    from quarry.operators import extract as ex

    got = {r.doc_id: r for r in ex.insight_summary(spark.createDataFrame(rows, "doc_id long, pos int, category string, anchor string"), "doc_id").collect()}
    assert (got[1].total_items, got[1].key_sections, got[1].category_counts) == (4, ["h1", "h2"], {"a": 3, "b": 1}) and got[2].key_sections == []
    whole = {r.doc_id: r for r in documents.insight_summary(spark, SF).collect()}
    each = collections.Counter((r.doc_id, r.category) for r in documents.insight_dedup(spark, SF).collect())
    assert {(d, c): n for d, r in whole.items() for c, n in json.loads(r.category_counts).items()} == dict(each)


def test_search_by_blocks(spark, items, docs):
    """Both searches against all pairs, with several blocks, repeated rows, null and empty texts and vectors."""
    texts = [(i, docs[i]) for i in sorted(docs)[:60]] + [(900, None), (901, ""), (902, docs[0]), (0, docs[0])]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, t) for i, t in list(items.items())[:15]] + [(99, "")], "query_id long, query string")
    share = lambda t: {w: k / sum(c.values()) for c in [collections.Counter(x.lower() for x in WORD.findall(t or ""))] for w, k in c.items()}
    want = []
    for q, t in [*list(items.items())[:15], (99, "")]:
        own = share(t)
        scored = [(round(sum(w * s[x] for x, w in own.items() if x in s), 9), c) for c, s in ((c, share(x)) for c, x in texts)]
        want += [(q, n + 1, c) for n, (_, c) in enumerate(sorted([(-s, c) for s, c in scored if s > 0])[:7])]
    for per in (512, 4):
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in rt.sparse_search(asked, chunks, 7, per_block=per).collect()) == sorted(want)
    vecs = [(i, [float((i * k) % 7 - 3) for k in range(1, 6)]) for i in range(50)] + [(60, None), (61, [0.0] * 5), (62, [1.0, None])]
    v = spark.createDataFrame(vecs, "chunk_id long, embedding array<double>").repartition(3)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), blocks.PLACES)
    ok = [(i, x) for i, x in vecs[:50] if any(x)]
    want = [(q, n + 1, c) for q, a in ok[:9] for n, (_, c) in enumerate(sorted((-cos(a, b), c) for c, b in ok)[:4])]
    queries = v.where("chunk_id <= 61").withColumnRenamed("chunk_id", "query_id").join(spark.createDataFrame([(q,) for q, _ in ok[:9]], "query_id long"), "query_id")
    for per in (512, 3):
        got = rt.dense_top_k(queries, v, 4, per_block=per).collect()
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == sorted(want)


def test_retrieve_parts_is_one_search_per_part(spark, items):
    rows = documents.retrieve_parts(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.item_id].append(r)
    assert set(by) <= set(items) and all(sorted(r.position for r in x) == list(range(1, len(x) + 1)) and len({r.chunk_id for r in x}) == len(x) for x in by.values())
    assert flows.REQUIREMENT_BASE["bidding"] == 58
