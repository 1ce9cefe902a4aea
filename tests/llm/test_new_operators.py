"""op11 to op13 against brute force, over awkward tables."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import fim, jaccard, repair, simhash
from tests.llm.test_operators import EMPTY, awkward


# op11


def brute_groups(data, k=3, percent=90):
    """(doc_id, n, component) of each row, in plain Python."""
    sets = [frozenset(simhash.shingles(simhash.words(t or ""), k).tolist()) for _, t in data]
    names = sorted(set(filter(None, sets)), key=sorted)
    root = {s: s for s in names}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (doc, _), s in zip(data, sets, strict=True):
        if s and doc is not None:
            least[find(s)] = min(doc, least.get(find(s), doc))
    return sorted(((doc, len(s), least.get(find(s)) if s else doc) for (doc, _), s in zip(data, sets, strict=True)), key=str)


def near_copies(rnd, n, length, edits, original=True):
    own = [f"v{rnd.randrange(5000)}" for _ in range(length)]
    out = [" ".join(own)] if original else []
    for _ in range(n):
        x = list(own)
        for _ in range(rnd.randrange(1, edits + 1)):
            x[rnd.randrange(length)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, monkeypatch, small):
    """Groups that touch, groups of unlike texts with a common passage, short sets at the very threshold."""
    rnd = random.Random(7)
    df, data = awkward(spark, 6)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rnd, 60, 120, 4) + near_copies(rnd, 40, 300, 12, original=False) + [passage + " " + " ".join(f"z{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 60))) for _ in range(80)]
    ten = [f"t{i}" for i in range(12)]
    texts += [" ".join(ten), " ".join(ten[:11]), " ".join(ten[:10]), " ".join(ten[1:]), "A b C", "a B c", "a b", "A  B"]
    more = [(2000 + i, t, "h", "c", "kept") for i, t in enumerate(texts)]
    both = df.unionByName(spark.createDataFrame(more, df.schema))
    if small:  # every list is dealt into cells
        monkeypatch.setattr(jaccard, "SMALL", 2)
        monkeypatch.setattr(jaccard, "CELL", 3)
        monkeypatch.setattr(jaccard, "FEW", 0)
    got = sorted((tuple(r) for r in jaccard.similar_groups(both).collect()), key=str)
    want = brute_groups([d[:2] for d in data + more])
    assert got == want and len({c for _, _, c in want}) < len(want) - 50


def test_jaccard_without_rows_or_words(spark):
    assert jaccard.similar_groups(spark.createDataFrame([], EMPTY)).count() == 0
    rows = [(1, None), (2, ""), (None, " "), (None, "x y z"), (3, "x y z"), (4, "q")]
    assert sorted((tuple(r) for r in jaccard.similar_groups(spark.createDataFrame(rows, EMPTY)).collect()), key=str) == brute_groups(rows)


def test_jaccard_lengthens_prefixes(spark):
    """Where lists are long a document asks for several shared tokens; the choice changes no link."""
    rnd = random.Random(5)
    texts = [(i, " ".join(f"c{rnd.randrange(12)}" for _ in range(150))) for i in range(60)]
    df = spark.createDataFrame(texts, EMPTY)
    rows = jaccard._rows(df, 2, 90, "doc_id", "text").where("n > 0").withColumn("node", F.monotonically_increasing_id())
    _, chosen = jaccard._postings(rows, 90)
    assert chosen.where("need > 1").count() > 0
    got = sorted((tuple(r) for r in jaccard.similar_groups(df, k=2).collect()), key=str)
    assert got == brute_groups(texts, 2)


# op12


def brute_fim(doc, text, plain=10, spm=20, sentinels=fim.SENTINELS):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in sentinels) or h[2] % 100 >= 100 - plain:
        return doc, n, "plain", None, None, t
    x, y, z = sentinels
    return (doc, n, "spm", len(p), len(m), y + s + x + p + z + m) if h[3] % 100 < spm else (doc, n, "psm", len(p), len(m), x + p + y + s + z + m)


@pytest.mark.parametrize("sentinels", [fim.SENTINELS, ("<|prefix|>", "<|suffix|>", "<|é|>")])
def test_fim(spark, sentinels):
    rnd = random.Random(2)
    bits = ["<", "<P", "<P>", "<S", "M>", ">", "é", "€", "😀", "\x00", "\n", "word", "Z" * 300, "aab", "aaab", "é<", "<|prefix", "|>", "é|>"]
    made = [(i, "".join(rnd.choice(bits[:2] + bits[5:] if i % 3 else bits) for _ in range(rnd.randrange(0, 300)))) for i in range(150)] + [(900, "a" * 100_000), (901, "é" * 5000 + "<"), (902, "<P"), (None, "one two")]
    df, data = awkward(spark, 8)
    both = df.unionByName(spark.createDataFrame([(*m, "h", "c", "kept") for m in made], df.schema))
    got = fim.fill_in_middle(both, sentinels=sentinels, keep=("h", "key")).withColumn("back", fim.restored(sentinels=sentinels)).collect()
    want = [brute_fim(d, t, sentinels=sentinels) for d, t in [x[:2] for x in data] + made]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    texts = {d: t or "" for d, t in made if d is not None}
    assert all(r.back == texts[r.doc_id] for r in got if r.doc_id in texts and sum(x[0] == r.doc_id for x in data) == 0) and got[0].key == "c"
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], EMPTY)).count() == 0
    with pytest.raises(ValueError, match="sentinels"):
        fim.fill_in_middle(df, sentinels=("aab", "ab", "c"))


def test_automaton_state_depends_on_its_last_bytes():
    for sentinels in (fim.SENTINELS, ("<|a|>", "<<é", "ab")):
        table, span = fim.automaton(sentinels)
        rnd = random.Random(1)
        letters = sorted({b for s in sentinels for b in s.encode()} | {65, 32, 0xC3, 0xA9})
        for _ in range(3000):
            ends = set()
            tail = [rnd.choice(letters) for _ in range(span)]
            for state in range(len(table) // 256):
                for b in tail:
                    state = int(table[state * 256 + b]) & 0xFF
                ends.add(state)
            assert len(ends) == 1


# op13


def brute_repair(turns):
    """The least cost and, of the cheapest edits, the ASCII-least audit with its repaired turns: best-first over (place, state)."""
    seen, faults = set(), []
    for role, text in turns:
        bare = re.sub(r"[\x20\x09-\x0D]+$", "", text) if text.strip(" \t\n\x0b\x0c\r") else ""
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in (0, 3):
            return cost, audit, "\n".join(out), faults
        give = "a" if state == 2 else "u"
        name = {"a": "assistant", "u": "user"}[give]
        nxt = 3 if give == "a" else 2
        heapq.heappush(queue, (cost + 2, audit + "I", i, nxt, (*out, f"{name}:")))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, nxt, (*out, f"{name}:{text}")))
                for first, at, to in (("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("a", 2, 3), ("u", 3, 2)):
                    if role[:1] == first and at == state:
                        heapq.heappush(queue, (cost + more, audit + "K", i + 1, to, (*out, f"{role}:{text}")))


def conversations(rnd, n):
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, 12)):
            turn = None if rnd.random() < 0.05 else t + rnd.randrange(3)
            rows.append((c, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rnd.choice(["a.", "b!", "c", "", "  \n", "d?  ", None, f"e{rnd.randrange(99)}."])))
    return rows


KINDS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def brute_report(rows, hurt):
    out = []
    for c in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        cost, audit, said, faults = brute_repair([r[2:] for r in own])
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        heads = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [16, 1])
def test_repair(spark, monkeypatch, bits):
    """With blocks of two turns nearly every conversation is solved in several runs."""
    monkeypatch.setattr(repair, "BLOCK", bits)
    rnd = random.Random(bits)
    rows = conversations(rnd, 40) + [(None, 0, "user", "x."), (None, None, None, None), (77, 5, "user", "only.")] + [(78, t // 3, "user", "same.") for t in range(20)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], KINDS + ", run string, at int").repartition(3)
    hurt = repair.damage(df)
    assert sorted((tuple(r) for r in hurt.collect()), key=str) == sorted(damaged(rows), key=str)
    got = sorted((tuple(r) for r in repair.repair_report(df, hurt).collect()), key=str)
    assert got == brute_report(rows, damaged(rows))


def test_repair_gives_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "r?"), (1, 3, "assistant", "a."), (2, 0, "assistant", "b.")]
    _, _, parts, totals = repair.repair(spark.createDataFrame(rows, KINDS))
    got = sorted((r.conv_id, r["at"], r.part, r.edit, r.role, r.text) for r in parts.where("role is not null").collect())
    assert [(c, e, role, t) for c, _, _, e, role, t in got if c == 1] == [(1, "K", "system", "s."), (1, "K", "user", "q?"), (1, "I", "assistant", ""), (1, "K", "user", "r?"), (1, "K", "assistant", "a.")]
    assert {(r.conv_id, r.cost, r.illegal) for r in totals.collect()} == {(1, 2, 1), (2, 2, 0)}


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], KINDS)
    assert repair.repair_report(none, repair.damage(none)).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "x.")], KINDS)
    assert [tuple(r) for r in repair.repair_report(df, repair.damage(df)).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_run_matrices_compose():
    """Costs through a run are those of its matrix, whatever follows."""
    rnd = random.Random(4)
    for _ in range(200):
        turns = [(rnd.choice("suatx"), rnd.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rnd.randrange(1, 7))]
        end = repair.relaxed(tuple(rnd.randrange(9) for _ in range(4)))
        unit = [repair._costs(turns, tuple(0 if i == j else repair.FAR for i in range(4)))[0] for j in range(4)]
        assert repair._costs(turns, end)[0] == tuple(min(unit[j][i] + end[j] for j in range(4)) for i in range(4))
        assert np.all(np.array(repair._costs(turns, end)) >= 0)


def test_jaccard_candidates_do_not_grow_with_the_square(spark, monkeypatch):
    # sets of a group that are somewhat too different: each was a candidate with every other, in all the lists they share
    token = np.random.default_rng(7).permutation(np.unique(np.random.default_rng(5).integers(0, 2**32, 6000)))
    rows = [np.concatenate([token[:330], token[400 + 66 * i :][:66]]) for i in range(60)] + [token[5000:5300], token[5020:5300]]
    sets = spark.createDataFrame([(i, np.sort(x).astype("<u4").tobytes()) for i, x in enumerate(rows)], "node long, hashes binary").coalesce(1)
    made, candidates = [], jaccard._candidates

    def counted(*args):
        found = candidates(*args).cache()
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_candidates", counted)
    found, _ = jaccard.links(jaccard.described(sets, 80, "<u4"), 80, lambda need: sets.join(need, "node"), turns=("all",), kind="<u4")
    assert sorted(map(tuple, found.collect())) == [(60, 61)]
    assert sum(made) < 62


def test_jaccard_counts_a_pair_once_in_a_route():
    # two near copies in three lists of one route: one row that says so, not three
    n = 3 * [10, 10]
    cols = {"cell": [1, 1, 2, 2, 3, 3], "n": n, "lead": 3 * [1, 2], "node": 3 * [7, 8], "root": 3 * [7, 8], "need": 3 * [2, 2], "level": 6 * [1], "side": 6 * [2], "sketch": 6 * [bytes(128)]}
    m = jaccard.Members(pa.table(cols), 90)
    assert m.pairs(jaccard._all(m)).to_pylist() == [{"a": 7, "b": 8, "need": 2, "shared": 3}]
