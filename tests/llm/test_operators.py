"""The operators over a small awkward table (nulls, empty and long texts, ties, repeats, clashing columns), against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import queries as lq
from quarry.llm import chat, jaccard, licenses, media, packing, quality, simhash, substring, tokens, urls, vafile
from quarry.llm.common import components


def awkward(spark, seed=1, extra=True):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocab) for _ in range(70))
    texts = [None, "", "   \n ", "One", "two words", passage, passage]
    for _ in range(40):
        own = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 120))]
        if rnd.random() < 0.4:
            at, k = rnd.randrange(len(own) + 1), rnd.randrange(0, 40)
            own[at:at] = passage.split()[k : k + rnd.randrange(10, 31)]
        if rnd.random() < 0.2:
            own += own[:30]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(own) + rnd.choice(["", "\nReleased under the MIT License.", "\nLicensed under the Apache License, Version 2.0."]))
    texts += [texts[8], texts[9] + " tail", " ".join(rnd.choice(vocab) for _ in range(6000)), "Ünïcode £    x " * 20]
    data = [(i * 5 % len(texts), t, "h", "c", "kept") for i, t in enumerate(texts)]
    data += [(None, passage, "h", "c", "kept"), (0, texts[[d[0] for d in data].index(0)], "h", "c", "kept")]
    names = "doc_id long, text string, h string, key string, fp string" if extra else "doc_id long, text string"
    return spark.createDataFrame([d if extra else d[:2] for d in data], names).repartition(5), data


EMPTY = "doc_id long, text string"


def test_substring(spark):
    df, data = awkward(spark)
    got = {}
    for r in substring.remove_repeats(df, 20, keep=("h",)).collect():
        got.setdefault((r.doc_id, r.n_words), []).append((r.n_removed, r.kept, r.h))
    seen, n = {}, 0
    one = {d[0]: d[1] for d in data if d[0] is not None}
    for doc in sorted(one):
        w = (one[doc] or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            gone[i : i + 20] |= k in seen
            seen.setdefault(k, 1)
        want = (int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), "h")
        assert set(got[doc, len(w)]) == {want}
        n += want[0]
    assert n > 100 and got[None, 70][0][0] == 0
    spaced = {r.doc_id: r for r in substring.remove_repeats(df.where("doc_id is not null"), 20, spaced=True).collect()}
    for doc, t in one.items():
        r = spaced[doc]
        assert (r.kept == t) if r.n_removed == 0 else r.kept.encode().split() == got[doc, r.n_words][0][1].encode().split()
    assert substring.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0


def test_substring_takes_texts_of_one_id_as_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(25))
    rows = substring.remove_repeats(spark.createDataFrame([(1, a), (1, b), (1, a), (2, a + " " + b), (3, b)], EMPTY)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rows) == [(1, 25, 0), (1, 60, 0), (1, 60, 0), (2, 85, 85), (3, 25, 25)]


def test_substring_cuts_up_hot_minimizers(spark, monkeypatch):
    df, _ = awkward(spark, 3)
    want = sorted(map(str, substring.remove_repeats(df).collect()))
    monkeypatch.setattr(substring, "HOT", 1)
    assert sorted(map(str, substring.remove_repeats(df).collect())) == want


@pytest.mark.parametrize("hot", [1, 2000])
def test_substring_is_exact_where_hashes_collide(spark, monkeypatch, hot):
    """With word hashes of three bits most windows share a minimizer; still only true repeats go. (Workers get the patched functions by value.)"""
    df, data = awkward(spark, 4)
    want = sorted(map(str, substring.remove_repeats(df).collect()))
    whole = substring._mix
    monkeypatch.setattr(substring, "HOT", hot)
    rows = substring._stretch_rows(df.where("doc_id is not null").select("doc_id", F.hash("text"), "text"), 20)
    made = [r.h for r in rows.collect()]
    assert len(set(made)) > 100

    def few(frame, window):
        return rows_of(frame, window).withColumn("h", F.col("h").bitwiseAND(F.lit(7)))

    rows_of = substring._stretch_rows
    monkeypatch.setattr(substring, "_stretch_rows", few)
    assert sorted(map(str, substring.remove_repeats(df).collect())) == want and whole is substring._mix


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark):
    df, data = awkward(spark, 5)
    near = [(1000 + i, " ".join(f"q{j}" for j in range(3000)) + f" e{i % 7}", "h", "c", "kept") for i in range(12)]
    df = df.unionByName(spark.createDataFrame(near, df.schema))
    data = data + near
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    fps = []
    for d in data:
        w = (d[1] or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)))
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(data):
        if d[0] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), d[0])
    assert sorted(got, key=str) == sorted(((d[0], format(fps[i], "016x"), least.get(find(i))) for i, d in enumerate(data)), key=str)
    assert len({f for f in fps[-12:]}) > 1 and len({find(i) for i in range(len(data) - 12, len(data))}) == 1
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_near_groups(spark, monkeypatch):
    rnd = random.Random(8)
    base = [[rnd.randrange(5000) for _ in range(rnd.randrange(5, 200))] for _ in range(30)]
    docs = []
    for b in base:
        for _ in range(rnd.choice([1, 1, 2, 12])):
            own = list(b)
            for _ in range(rnd.randrange(0, max(1, len(b) // 40) + 1)):
                own[rnd.randrange(len(own))] = rnd.randrange(5000)
            docs.append(" ".join(f"v{x}" for x in own))
    docs += docs[:5] + ["", "  "]
    df = spark.createDataFrame(list(enumerate(docs)), EMPTY)
    sets = [set(simhash.shingles(simhash.words(t), 5).tolist()) for t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(docs)) if sets[i]}
    for small in (24, 3):
        monkeypatch.setattr(simhash, "SMALL", small)
        got = {r.doc_id: r.group_id for r in simhash.near_groups(df).collect()}
        assert [(i, got.get(i), want.get(i), len(sets[i])) for i in range(len(docs)) if got.get(i) != want.get(i)] == []


def test_near_groups_around_one_original(spark, monkeypatch):
    """Several hundred copies that are alike only through an original in their middle, and a few that are like nothing."""
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(400):
        own = list(base)
        for j, at in enumerate(rnd.sample(range(5, 190, 10), 3 if i % 50 else 12)):
            own[at + rnd.randrange(5)] = f"c{i}x{j}"
        docs.append(" ".join(own if i != 200 else base))
    sets = [set(simhash.shingles(simhash.words(t), 5).tolist()) for t in docs]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    near = [i for i, s in enumerate(sets) if like(s, sets[200])]
    assert len(near) == 393 and sum(like(sets[i], sets[j]) for i in near[:100] for j in near[:100] if i < j) < 200
    want = {i: min(near) if i in near else i for i in range(400)}
    df = spark.createDataFrame(list(enumerate(docs)), EMPTY).repartition(3)
    for small, cell in ((32, 2048), (2, 20)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "CELL", cell)
        assert {r.doc_id: r.group_id for r in simhash.near_groups(df).collect()} == want


def test_near_groups_recall(spark):
    """At sf0.1, of all pairs of different texts at a similarity of 0.8 or more (by an exact prefix join) nine in ten or more are in one group, and equal texts always."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(simhash.shingles(simhash.words(r.text or ""), 5).tolist()) for r in rows}
    first, held, pairs = {}, {}, []
    for doc in sorted(sets):
        s = sets[doc]
        if not s or first.setdefault(s, doc) != doc:
            continue
        tokens = sorted(s)[: len(s) - -(-len(s) * 8 // 10) + 1]
        for other in {d for t in tokens for d in held.get(t, ())}:
            both = len(s & sets[other])
            if 10 * both >= 8 * (len(s) + len(sets[other]) - both):
                pairs.append((other, doc))
        for t in tokens:
            held.setdefault(t, []).append(doc)
    group = {r.doc_id: r.group_id for r in simhash.near_groups(spark.createDataFrame(rows).repartition(8)).collect()}
    assert len(pairs) >= 40 and sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(group[d] == group[first[s]] for d, s in sets.items() if s)


MIT = """Permission is hereby granted, free of charge, to any
  person obtaining a copy of this software and
  associated documentation files (the "Software"), to deal"""
BSD = """Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the
# following conditions are met:"""


def test_licenses(spark):
    texts = [None, "", "MIT License mit-license", "x general public\nlicense y GENERAL PUBLIC LICENSE", "Licensed under CC BY-NC 4.0!", "the apache\tlicense", "Licensed under the Apache License, Version 2.0. and more words here", "all rights reserved\nALL RIGHTS reserved by", "mitlicense", "é mit license", "mit licenseé", "Released  under (the) MIT license", "This wor\u212a is licensed under the GNU General Public License, version 3", "\u0130MIT mit license \u0130"]
    texts += ["😀 😀 😀 mit license", "a\u2028b\u0085 c mit license", "\u0085 mit license x\u2028 general public license 😀", MIT, BSD, f"some words before {BSD} and words after " * 3, BSD.replace("binary", "x").replace("forms", "y").replace("source", "z")]
    texts += ["all " * 50 + "rights " * 50 + "reserved", "\u212a mit license", "mit " * 3000 + "released under the license mit", "mit license " * 2000]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(texts)] + [(None, "mit license", "w", 1)], "doc_id long, text string, w string, label int")
    got = {(r.doc_id): tuple(r)[1:] for r in licenses.scan(df).collect()}
    for i, t in [*enumerate(texts), (None, "mit license")]:
        w = licenses.words_of(t or "")
        at, labels = [], set()
        for p, label in licenses.PHRASES:
            k = p.split()
            hit = [j for j in range(len(w)) if w[j : j + len(k)] == k]
            at += hit
            labels |= {label} if hit else set()
        more, score = set(labels), 0.0
        for label, text in licenses.TEMPLATES:
            own, size = set(licenses.words_of(text)), licenses.block_length(len(licenses.words_of(text)))
            best = max(len(own.intersection(w[j : j + size])) for j in range(max(1, len(w) - size + 1)))
            if best * 10 >= 9 * len(own):
                more.add(label)
                score = max(score, best / len(own))
        assert got[i] == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score)
    labels = [v[5] for v in got.values()]
    assert "bsd" in labels and any("mit" in got[i][5] and not got[i][4] for i, t in enumerate(texts) if t == MIT) and got[texts.index("😀 😀 😀 mit license")][2:4] == (3, 3)
    assert licenses.scan(spark.createDataFrame([], EMPTY)).count() == 0


def test_license_plan_does_not_grow_with_templates(spark):
    """But for one literal of prefix words the plan is the same."""
    df = spark.createDataFrame([(1, "alpha beta")], EMPTY)
    size = lambda n: len(licenses.scan(df, templates=[(f"l{i}", f"word{i} other{i} third{i} and more{i}") for i in range(n)])._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(200) == size(2)


def test_media(spark):
    df, data = awkward(spark, 7)
    enc = media.encode_media(df, keep=("doc_id", "h"))
    for r in media.read_media(enc, keep=("doc_id", "n_bytes", "h")).collect():
        p = media.padded(next((d[1] or "").encode() for d in data if d[0] == r.doc_id))
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32, r.error) == (hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-32:]), None)
        blob = media.mux(p)
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        x = [b - 128 for b in p]
        share = [p.count(b) / len(p) for b in set(p)]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        figures = [sum(x) / len(x), (sum(v * v for v in x) / len(x)) ** 0.5, max(map(abs, x)), turns, -sum(q * math.log2(q) for q in share)]
        got = dict(f.split("=") for f in r.feature.split(";"))
        assert np.allclose([float(got[k]) for k in ("mean", "rms", "peak", "crossings", "entropy")], figures, atol=1e-4)
        assert (int(got["packets"]), int(got["clusters"])) == (len(p) // 576, -(-len(p) // (576 * 8 * 32)))
    assert media.packet_table(enc).count() == sum(len(media.padded((d[1] or "").encode())) // 576 for d in data)
    assert media.read_media(spark.createDataFrame([(1, 0, None), (2, 0, b"x")], "doc_id long, n_bytes long, media binary")).where("error is not null").count() == 2
    assert media.read_media(media.encode_media(spark.createDataFrame([], EMPTY))).count() == 0


def test_urls(spark):
    pages = [(1, "http://a.org/x", '<a href="http://b.net/">'), (2, "http://b.net/x", None), (3, "HTTP://C.com/de/1", '<a href="http://d.net/">'), (4, "http://e.net/q?x#y", "<A HREF='https://c.com/z'>"), (5, None, None), (6, "no scheme", ""), (7, "http://example.org/es/1", ""), (8, "http://x.example.org", ""), (8, "http://x.example.org", ""), (9, "http://example.org/en/12", ""), (10, "http://d.net/p#q", "")]
    df = spark.createDataFrame([(*p, "h", 1.0) for p in pages], "page_id int, url string, html string, host string, trust double")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[3] == ("c.com", "/de/1", "com/de/", "block")
    assert got[2][3] == "allow" and got[4] == ("e.net", "/q", None, "block")  # links to a blocked host
    assert got[10][3] == "allow"  # is linked from one
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.org/es/", "block") and got[8] == ("x.example.org", "", None, "allow") and got[9][2] == "example.org/en/1"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_urls_small_distrust(spark):
    """Two hops of 600 in-links each leave a distrust far under six places; it still is more than no trust."""
    link = lambda h: f'<a href="http://{h}/">'
    pages = [(0, "http://c.com/de/1", "")] + [(i, f"http://n{i}.net/", link("c.com")) for i in range(1, 601)] + [(600 + i, f"http://m{i}.net/", link("n1.net")) for i in range(1, 601)] + [(2000, "http://z.net/", "")]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got[601] == got[1200] == got[1] == "block" and got[2000] == "allow"


def test_urls_equal_personalised_pagerank(spark):
    """Scores of 300 hosts against the solved equations, forward from allowed and backward from blocked seeds; one is linked without a scheme."""
    rnd = random.Random(12)
    host = lambda i: f"h{i}.net"
    links = {(i, j) for i in range(300) for j in [rnd.randrange(300) for _ in range(rnd.choice([0, 1, 2, 8]))] if i != j} | {(290 + i, 291 + i) for i in range(9)}
    rules = [("allow", host(i), "/") for i in range(0, 20)] + [("block", host(i), "/") for i in range(20, 35)]
    pages = [(i, f"http://{host(i)}/x", " ".join(f"<a href={'//' if b % 7 == 0 else 'https://'}{host(b)}/>" for a, b in sorted(links) if a == i) * 2) for i in range(300)]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(pages, "page_id int, url string, html string"), rules).collect()}

    def rank(edges, seeds):
        a, p = np.zeros((300, 300)), np.zeros(300)
        p[seeds] = 1 / len(seeds)
        for i in range(300):
            own = [j for k, j in edges if k == i]
            for j in own:
                a[j, i] = 1 / len(own)
            if not own:
                a[:, i] = p
        return np.linalg.solve(np.eye(300) - 0.85 * a, 0.15 * p)

    trust, distrust = rank(links, range(0, 20)), rank({(b, a) for a, b in links}, range(20, 35))
    for i in range(300):
        assert abs(got[i].trust - trust[i]) < 1e-4 * trust[i] + 1e-9 and abs(got[i].distrust - distrust[i]) < 1e-4 * distrust[i] + 1e-9
        if i >= 35 and abs(trust[i] - distrust[i]) > 1e-7:
            assert got[i].verdict == ("block" if distrust[i] > trust[i] else "allow")
    assert sum(got[i].verdict == "block" for i in range(35, 300)) > 20


def test_urls_sql_over_links(spark):
    duckdb = pytest.importorskip("duckdb")
    from quarry.llm import sql

    pages = [(1, "http://a.org/x", '<a href="http://b.net/">'), (2, "http://b.net/x", "<a href='//c.com/z'>"), (3, "http://c.com/de/1", '<a href="http://d.net/">'), (4, "http://d.net/q", "<A HREF='https://e.net/z'>"), (5, "http://e.net/", "")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    con = duckdb.connect()
    con.execute("create table pages (page_id int, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    want = {r[0]: r[1:] for r in con.execute(sql.op6()).fetchall()}
    for r in urls.filter_urls(df).collect():
        assert tuple(r)[1:5] == want[r.page_id][:4] and np.allclose([r.trust, r.distrust], want[r.page_id][4:], atol=1e-5)


def test_vafile(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] + [0.0] * 7), (204, [0.5, -0.25]), (None, [1.0] * 8)]
    vecs += [(300, vecs[50][1]), (301, vecs[50][1])]
    df = spark.createDataFrame([(*v, "q") for v in vecs], "vec_id long, embedding array<double>, q string")
    ok = [(i, np.floor(256 * np.pad(np.array(v), (0, 8 - len(v)))).astype(int)) for i, v in vecs if i is not None and i not in (200, 201, 202, 203)]
    want = []
    for i, x in ok:
        if i % 50 == 0:
            want += [(i, k + 1, v, -s) for k, (s, v) in enumerate(sorted((-int(x @ y), j) for j, y in ok if j != i)[:5])]
    for per in (4096, 3):
        assert sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 50 == 0, per_block=per).collect()) == sorted(want)
    assert vafile.top_k(df.limit(0), F.lit(True)).count() == 0


def test_vafile_reads_few_exact_vectors(spark):
    """One vector in 3000 copies, with repeated rows of a query's own id, and 3000 others: same results as brute force from a small part of the exact vectors."""
    rng = np.random.default_rng(5)
    hot = [0.9] * 16
    vecs = [(i, hot) for i in range(3000)] + [(i, [float(x) for x in rng.normal(size=16)]) for i in range(3000, 6000)] + [(0, hot)] * 12
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(6)
    asks = (F.col("vec_id") % 500 == 0) | (F.col("vec_id") % 997 == 5)
    reads: list[int] = []
    got = sorted(tuple(r) for r in vafile.top_k(df, asks, reads=reads).collect())
    x = np.floor(256 * np.array([v for _, v in vecs])).astype(np.int64)
    ids = np.array([i for i, _ in vecs])
    want = []
    for r in np.flatnonzero((ids % 500 == 0) | (ids % 997 == 5)):
        order = np.lexsort((ids, -(x @ x[r])))
        want += [(int(ids[r]), n + 1, int(ids[c]), int(x[c] @ x[r])) for n, c in enumerate([c for c in order if ids[c] != ids[r]][:5])]
    assert got == sorted(want)
    n_queries = sum((ids % 500 == 0) | (ids % 997 == 5))
    assert sum(reads) < 0.01 * n_queries * len(ids)


def test_vafile_reads_exact_vectors_twice_whatever_the_blocks(spark, monkeypatch):
    """Each pass over exact vectors is counted: two for one block of queries, and two for a dozen."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)], "vec_id long, embedding array<double>")
    passes, scored = [], vafile._scored
    monkeypatch.setattr(vafile, "_scored", lambda *a: passes.append(1) or scored(*a))
    got = [sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 3 == 0, per_block=per).collect()) for per in (1000, 4)]
    assert got[0] == got[1] and len(passes) == 4


def by_hand(path, size):
    """A document's pieces by a plain call of the tokenizers library: (piece, start, length, crc32)."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    def cut(text):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % size or size
        at = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        return [(k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]

    return cut


def sequences(rows, size):
    """Each sequence's lengths; asserts that it is filled without a gap."""
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    return seqs


def first_fit(lengths, size):
    """How many bins first fit, longest first, takes."""
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(size - n)
        else:
            room[k] -= n
    return len(room)


def test_packing(spark):
    p = pytest.importorskip("public_tokenizers")
    path = p.path("byte_bpe_50k.json")
    df, data = awkward(spark, 9)
    cut = by_hand(path, 64)
    rows = packing.pack(packing.pieces(df, path, size=64), size=64, slack=2, per_task=5).collect()
    want = [(d, *x) for d, t, *_ in data for x in cut(t)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert len(sequences(rows, 64)) <= 1.1 * first_fit([r.length for r in rows], 64) + 1
    assert packing.pack(packing.pieces(spark.createDataFrame([], EMPTY), path)).count() == 0


def test_packing_small_chunks(spark, monkeypatch):
    found = spark.createDataFrame([(i, 0, 0, i % 60 + 1, i) for i in range(500)], packing.PIECE).coalesce(1)
    bins = packing._round(found.select(F.col("length").cast("int").alias("fill"), F.array(F.struct(*found.columns)).alias("members")), 64, 2)
    assert bins.agg(F.sum("fill")).first()[0] == sum(i % 60 + 1 for i in range(500))
    assert packing.best_fit([], 64) == []


def test_packing_long_texts(spark):
    p = pytest.importorskip("public_tokenizers")
    path = p.path("byte_bpe_50k.json")
    n = 2_000_000
    texts = [" " * n, "\n" * n, "x" * n, "a" + " " * 1_100_000 + "b", "<|endoftext|>", "x <|endoftext|> y<|endoftext|>"]
    cut = by_hand(path, 1024)
    rows = packing.pack(packing.pieces(spark.createDataFrame(list(enumerate(texts)), EMPTY), path)).collect()
    want = sorted((i, *x) for i, t in enumerate(texts) for x in cut(t))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences(rows, 1024)


def test_op8_query_equals_brute_force(spark):
    p = pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    rows = lq.op8_packing(spark, sf).collect()
    cut = by_hand(p.path("byte_bpe_50k.json"), 1024)
    want = [(r.doc_id, *x) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in cut(r.text)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert len(sequences(rows, 1024)) <= 1.02 * first_fit([r.length for r in rows], 1024) + 1


def test_sentencepieces(spark):
    p = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = p.path("piece_bpe_32k.model")
    original = sentencepiece.SentencePieceProcessor(model_file=path)
    df, data = awkward(spark, 10)
    text = {d[0]: d[1] or "" for d in data}
    got = tokens.sentencepieces(df, path).collect()
    assert len(got) == len(data) and all(r.parity for r in got)
    for r in got:
        assert r.ids == original.encode(text[r.doc_id]) and r.decoded == original.decode(r.ids) == text[r.doc_id] and len(r.ids) == r.n_tokens
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))


def test_op2_query_equals_the_sentencepiece_library(spark):
    p = pytest.importorskip("public_tokenizers")
    import sentencepiece

    original = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lq.op2_sentencepiece(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        ids = original.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.parity) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), True)
        assert r.decoded_sha256 == hashlib.sha256(original.decode(ids).encode()).hexdigest()


def test_parity_tells_a_difference():
    """A pipeline that differs from the original for a whole text is told, and decoding is of the ids, not of the text."""
    p = pytest.importorskip("public_tokenizers")
    m = tokens.Pieces(open(p.path("piece_bpe_32k.model"), "rb").read(), 1)
    assert m.encode(["plain words"])[0][1:] == ("plain words", True)
    m._known.clear()
    m._known["words"] = m.ids(["sword"])[0]
    m._known["plain"] = m.ids(["plain"])[0]
    ids, back, same = m.encode(["plain words"])[0]
    assert back == "plain sword" and not same


def test_quality(spark):
    rnd = random.Random(11)
    good = [" ".join(rnd.choice(["the", "of", f"word{rnd.randrange(60)}", f"term{rnd.randrange(60)}", f"thing{i}"]) if i % 2 else f"noun{rnd.randrange(90)}" for i in range(rnd.randrange(25, 90))) + "." for _ in range(150)]
    bad = [" ".join(f"w{i}###" for i in range(40)), "SHOUTING WORDS ARE BAD!! " * 8, "same same same same same same same same same same same same", " | ".join(f"c{i}" for i in range(30))]
    texts = good + [b for b in bad for _ in range(8)] + [None, ""]
    df = spark.createDataFrame([(i, t, "k", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, votes string, score double")
    got = {r.doc_id: r for r in quality.classify(df, keep=("votes",)).toDF("doc_id", "v", "posterior", "score", "rejected", "votes").collect()}
    assert sum(got[i].rejected for i in range(150)) <= 1 and all(got[i].rejected for i in range(150, 184)) and got[0].votes == "k"
    assert quality.classify(spark.createDataFrame([], EMPTY)).count() == 0


def test_quality_by_plain_python(spark):
    """Votes, posteriors and scores of every document of sf0.001, recomputed with loops over dictionaries."""
    import collections
    import re

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]

    def vote(x, good, bad):
        if good < bad:
            return "g" if x <= good else "b" if x >= bad else "-"
        return "g" if x >= good else "b" if x <= bad else "-"

    def said(t):
        b = t.encode()
        w, n = b.split(), max(1, len(b.split()))
        up, low, num = (len(re.findall(p, b)) for p in (rb"[A-Z]", rb"[a-z]", rb"[0-9]"))
        wide = sum(x >= 128 for x in b)
        inked = max(1, sum(x not in b" \t\n\x0b\x0c\r" for x in b))
        lines = [x for x in b.split(b"\n") if x]
        return "".join((
            vote(up / max(1, up + low), 0.2, 0.5), vote(len(re.findall(rb"([^\w\s\x80-\xff])\1", b)) / n, 0.02, 0.2), vote(sum(x == b"|" for x in w) / n, 0.01, 0.1),
            vote(sum(x in quality.STOP for x in b.lower().split()) / n, 0.15, 0.04) if n >= 20 else "-", vote((inked - up - low - num - wide) / inked, 0.1, 0.16) if n >= 8 else "-",
            vote(1 - len(set(lines)) / len(lines), 0.05, 0.3) if len(lines) >= 4 else "-", vote(sum(x == y for x, y in zip(w, w[1:], strict=False)) / n, 0.02, 0.1) if len(w) >= 2 else "-",
        ))

    votes = {d: said(t) for d, t in docs}
    times = collections.Counter(votes.values())
    post = {}
    for v in times:
        p = [(1 if "b" not in v else 0) + 0.01] + [(c == "b") + 0.01 for c in v]
        post[v] = [x / sum(p) for x in p]
    for _ in range(100):
        total = sum(times.values())
        prior = [(sum(times[v] * post[v][k] for v in times) + 0.01) / (total + 0.08) for k in range(8)]
        rate = [[(sum(times[v] * post[v][k] for v in times if v[j] == "g") + 0.01) / (sum(times[v] * post[v][k] for v in times if v[j] != "-") + 0.02) for j in range(7)] for k in range(8)]
        for v in times:
            p = [prior[k] * math.prod(rate[k][j] if c == "g" else 1 - rate[k][j] for j, c in enumerate(v) if c != "-") for k in range(8)]
            post[v] = [x / sum(p) for x in p]

    # the sample is every different row, in order of its hash
    rows = spark.createDataFrame(docs, EMPTY).select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "doc_id").collect()
    text, order = dict(docs), sorted(rows, key=lambda r: r.h)
    slot = lambda w, seed: xxhash.xxh64_intdigest(w, seed) % 65535 + 1
    shape = lambda w: re.sub(r"(?s)(.)\1+", r"\1\1", re.sub("[^\x00-\x7f]", "x", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", w)))))

    def features(t):
        own, w = collections.Counter(), t.split()
        for x in w:
            own[slot(x.lower(), 1)] += 1
            own[slot(shape(x), 2)] += 1
        same = sum(x == y for x, y in zip(w, w[1:], strict=False))
        if same:
            own[0] += same
        return own

    made = [features(text[r.doc_id]) for r in order]
    goal = [post[votes[r.doc_id]][0] for r in order]
    mean = sum(goal) / len(goal)
    weight, grads = collections.defaultdict(float), collections.defaultdict(lambda: 1e-3)
    b, gb, rng = math.log((mean + 1e-3) / (1 - mean + 1e-3)), 1e-3, np.random.default_rng(7)
    for _ in range(8):
        for i in rng.permutation(len(made)):
            own = dict(sorted(made[i].items(), key=lambda x: x[0] * 0x9E3779B97F4A7C15 % 2**64)[:2048])
            if not own:
                continue
            scale = 2 / sum(own.values())
            d = 1 / (1 + math.exp(-(b + sum(weight[f] * n * scale for f, n in own.items())))) - goal[i]
            for f, n in own.items():
                g = d * n * scale + 1e-6 * weight[f]
                grads[f] += g * g
                weight[f] -= 0.4 * g / math.sqrt(grads[f])
            gb += d * d
            b -= 0.1 * d / math.sqrt(gb)
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(docs, EMPTY)).collect()}
    assert {d: r.votes for d, r in got.items()} == votes
    for d, t in docs:
        own = features(t)
        x = sum(weight[f] * n for f, n in own.items()) * 2 / max(1, sum(own.values()))
        p = 1 / (1 + math.exp(-(b + x)))
        assert abs(got[d].posterior - post[votes[d]][0]) < 1e-9 and abs(got[d].score - p) < 2e-4
        assert got[d].rejected == (not own or got[d].score < 0.5) or abs(p - 0.5) < 1e-3


def test_quality_sample_of_a_huge_table(spark):
    """The share of a table of 1e11 rows is not zero, null ids are not all or none, and repeated rows are one."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("__text"))
    got = quality.chosen(rows, 10**11, 10**9).collect()
    assert 120 < len(got) < 300 and len({r["__h"] for r in got}) == len(got)
    same = spark.createDataFrame([(1, "a few words here")] * 300 + [(i, f"other words {i}") for i in range(2, 20)], EMPTY)
    assert quality.classify(same, sample=10).count() == 318


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    r = quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, clean, kept = r.agg(F.avg((F.col("rejected") == (F.col("quality") == 0)).cast("int")), F.count_if(F.col("quality") == 1), F.count_if((F.col("quality") == 1) & ~F.col("rejected"))).first()
    assert right >= 0.95 and kept >= 0.98 * clean


def test_chat(spark):
    said = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (2, 0, "assistant", "x"), (None, 0, "user", "n"), (1, 1, "assistant", "a"), (3, None, None, "z")]
    df = spark.createDataFrame([(*s, 1) for s in said], "conv_id long, turn long, role string, text string, seq int")
    log = chat.events(df, "conv_id", "turn", F.lit(0), F.lit("message"), "role", "text")
    got = {r.conv_id: r for r in chat.format_digests(log).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"ab<|im_end|>").hexdigest() and got[1].loss_chars == 12
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na\nassistant\nb<|im_end|>\n").hexdigest()
    turns = chat.format_turns(log).where("conv = 1").orderBy("char_start").collect()
    whole = "".join(t.formatted for t in turns)
    assert len(whole) == got[1].formatted_chars and "".join(chat.unescape(whole[t.loss_start : t.loss_end]) for t in turns) == "ab<|im_end|>"
    assert set(got) == {1, 2, 3, None} and chat.format_digests(log.limit(0)).count() == 0


def test_chat_events_through_a_table(spark):
    """Deltas, edits and regenerations of two conversations, in any order of rows, become final messages."""
    log = [
        (1, 0, 0, "delta", "user", "Hel"), (1, 0, 1, "delta", "user", "lo"), (1, 1, 0, "delta", "assistant", "bad"), (1, 1, 1, "regenerate", None, None), (1, 1, 2, "delta", "assistant", "good "), (1, 1, 3, "delta", None, "answer"),
        (1, 2, 0, "message", "user", "thanks"), (1, 2, 1, "edit", None, "no"), (2, 0, 0, "delta", "user", "x<|im_end|>"), (2, 0, 1, "edit", "system", "y<|im_end|>"), (2, 1, 0, "delta", "assistant", ""),
    ]
    rows = spark.createDataFrame(random.Random(1).sample(log, len(log)), "c long, t long, s long, k string, role string, text string").repartition(4)
    got = chat.format_turns(chat.events(rows, "c", "t", F.col("s"), F.col("k"), "role", "text")).orderBy("conv", "char_start").collect()
    each = {c: list(chat.Turns().feed("".join(r.formatted for r in got if r.conv == c))) for c in (1, 2)}
    assert each[1][:2] == [("user", "Hello"), ("assistant", "good answer")] and each[1][2:] == [("user", "thanks"), ("", "no")]
    assert each[2] == [("system", "y<|im_end|>"), ("assistant", "")]
    digests = {r.conv_id: r for r in chat.format_digests(chat.events(rows, "c", "t", F.col("s"), F.col("k"), "role", "text")).collect()}
    assert digests[1].n_turns == 4 and digests[1].loss_sha256 == hashlib.sha256(b"good answer").hexdigest()
