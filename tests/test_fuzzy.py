"""F9 and F12 against plain searches."""

import random
import re
import time

import pytest

from quarry.operators import fuzzy as fz
from quarry.plans import documents

SF = "/root/testdata/sf0.001"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(a, b):
    """Every stretch of the longer string, partial ones at both ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0

    def one(s, t):
        m = len(s)
        stretches = [t[i : i + m] for i in range(len(t) - m + 1)] + [t[:i] for i in range(1, m)] + [t[i:] for i in range(len(t) - m + 1, len(t))]
        return max(200.0 * common(s, x) / (m + len(x)) for x in stretches)

    s, t = (a, b) if len(a) <= len(b) else (b, a)
    return max(one(s, t), one(t, s)) if len(a) == len(b) else one(s, t)


def test_partial_ratio():
    rnd = random.Random(1)
    for k in range(600):
        letters = "abcde" if k % 2 else "abcdefghijklmnopq é字😀"
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randrange(0, n if k % 10 else 2 * n))) for n in (30, 60))
        if k % 3 == 0 and len(b) > 10:
            i = rnd.randrange(len(b) - 5)
            a = list(b[i : i + rnd.randrange(3, 130)])
            a[rnd.randrange(len(a))] = rnd.choice(letters)
            a = "".join(a)
        want, cutoff = brute(a, b), rnd.choice([50, 80, 88])
        assert fz.partial_ratio(a, b) == pytest.approx(want) and fz.partial_ratio(a, b, cutoff) == pytest.approx(want if want >= cutoff else 0)
    assert fz.partial_ratio("ceeadedaeeaded", "ddadcaceeadecdeeadedabddaa") == pytest.approx(92.857142857)
    assert fz.partial_ratio("abcdefgh", "xx abcdxfgh yy") == 87.5 and fz.partial_ratio("", "x") == 0 and fz.partial_ratio("", "") == 100
    long = "".join(rnd.choice("abcdefgh") for _ in range(200))  # four words of 64 places
    text = "".join(rnd.choice("abcdefgh") for _ in range(500))
    assert fz.partial_ratio(long, text) == pytest.approx(brute(long, text))


def test_unsupported(spark):
    said = [(1, "the transformer is tested"), (1, "this is nowhere at all"), (1, "the transfomer is testd"), (2, "the transformer is tested"), (3, "short"), (1, "the transformer is tested")]
    rnd = random.Random(3)
    said += [(4, "".join(rnd.choice("abc ") for _ in range(12)).strip().ljust(8, "z")) for _ in range(150)]
    ev = [(1, "note: The transformer is  tested daily"), (1, None), (2, ""), (4, "".join(rnd.choice("abc") for _ in range(60))), (4, "a"), (5, "no sentence")]
    got = sorted(tuple(r) for r in fz.unsupported(spark.createDataFrame(said, "k int, content string"), spark.createDataFrame(ev, "k int, text string"), "k").collect())
    squeeze = lambda t: re.sub(r"\s+", "", t or "").lower()
    want = sorted({(k, s) for k, s in said if len(s) >= 8 and not any(squeeze(s) in squeeze(t) or brute(squeeze(s), squeeze(t)) >= 88 for j, t in ev if j == k)})
    assert got == want and {k for k, _ in got} == {1, 2, 4}


def test_fuzzy_gate_over_whole_evidence(spark):
    """The query against all 24 hits' whole texts; stretches are scored by the plain search where a few characters of the bound allow it."""
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    squeeze = lambda t: re.sub(r"\s+", "", t or "").lower()
    evidence = {}
    for r in documents._hits(spark, SF).collect():
        evidence.setdefault(r.query_id, []).append(squeeze(r.text))
    want = set()
    for item, text in items.items():
        for s in (p.strip() for p in re.split("[。；;\n]+", text)):
            if len(s) >= 8 and not any(squeeze(s) in t or fz.partial_ratio(squeeze(s), t) >= 88 for t in evidence.get(item, [])):
                want.add((item, s))
    assert {tuple(r) for r in documents.fuzzy_gate(spark, SF).collect()} == want


def search(slots, options):
    """The whole search: every candidate of every slot in order; a slot stays empty only if all of its candidates are taken."""
    best = [-1, -1e9, {}]

    def go(k, used, team, score):
        if k == len(slots):
            if len(team) > best[0] or len(team) == best[0] and score > best[1] + 1e-9:
                best[:] = [len(team), score, team]
            return
        free = [(s, a) for s, a in options.get(slots[k], []) if a not in used]
        for s, a in free:
            go(k + 1, used | {a}, team | {slots[k]: (a, s)}, score + s)
        if not free:
            go(k + 1, used, team, score)

    go(0, frozenset(), {}, 0.0)
    return best[2]


def test_best_team_is_that_of_the_whole_search():
    rnd = random.Random(1)
    for k in range(800):
        own = {a: round(rnd.random(), 1) for a in range(6)}
        slots = list(range(rnd.randrange(1, 6)))
        options = {s: sorted(((own[a] if k % 2 else round(rnd.random(), 1), a) for a in rnd.sample(range(6), rnd.randrange(0, 5))), key=lambda x: (-x[0], x[1])) for s in slots}
        assert fz.best_team(slots, options) == search(slots, options)


def test_best_team_of_many():
    rnd = random.Random(2)
    own = {a: round(rnd.random(), 2) for a in range(500)}
    options = {s: sorted(((own[a], a) for a in rnd.sample(range(500), 100)), key=lambda x: (-x[0], x[1])) for s in range(50)}
    began = time.time()
    team = fz.best_team(list(range(50)), options)
    assert len(team) == 50 and time.time() - began < 5  # about 0.7 s on an idle machine
    best = sorted({a for s in options.values() for _, a in s}, key=lambda a: -own[a])[:50]
    assert sum(s for _, s in team.values()) == pytest.approx(sum(own[a] for a in best), abs=1.0)
