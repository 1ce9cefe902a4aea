"""Nearly contained texts (F12): the best match of a sentence with a stretch of a longer text.

partial_ratio is 100 * 2 L / (m + w), the largest over all stretches of the longer text that are as long as the shorter one (w = m), and
over its shorter beginnings and ends; L is the length of the longest common subsequence. L comes from bit vectors, one lane a stretch, so
hundreds of stretches are scored together. Before that, each stretch's shared q-grams bound its L: an edit spoils at most q of them. Stretches are scored
in order of that bound until none can beat the best, or the cutoff.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Characters of a gram; stretches that are scored together; sentences that meet a text together.
GRAM, LANES, SENTENCES = 3, 512, 64


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _masks(needle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The needle's characters, sorted, and for each (and a last one for all others) the words of a bit vector of its places."""
    alphabet = np.unique(needle)
    words = -(-len(needle) // 64)
    bits = np.zeros((len(alphabet) + 1, words), np.uint64)
    place = np.arange(len(needle))
    np.bitwise_or.at(bits, (np.searchsorted(alphabet, needle), place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return alphabet, bits


def _letters(alphabet: np.ndarray, text: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(alphabet, text), len(alphabet) - 1)
    return np.where(alphabet[at] == text, at, len(alphabet))


def common_lengths(bits: np.ndarray, letters: np.ndarray, starts: np.ndarray, width: int, needle: int) -> np.ndarray:
    """Lengths of the longest common subsequences of the needle with stretches of that width: a lane a stretch, words of 64 places with carries."""
    lanes, words = len(starts), bits.shape[1]
    state = np.full((words, lanes), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(width):
        mask = bits[letters[starts + j]].T
        carry = np.zeros(lanes, np.uint64)
        for w in range(words):
            s, m = state[w], mask[w]
            total = s + (s & m)
            over = total < s
            total2 = total + carry
            carry = (over | (total2 < total)).astype(np.uint64)
            state[w] = total2 | (s & ~m)
    if needle % 64:
        state[-1] |= ~np.uint64((1 << needle % 64) - 1)
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def _beginnings(needle: str, text: str) -> float:
    """The best ratio with a beginning of text that is shorter than the needle: one pass."""
    masks: dict[str, int] = {}
    for i, c in enumerate(needle):
        masks[c] = masks.get(c, 0) | 1 << i
    m, best = len(needle), 0.0
    full = (1 << m) - 1
    state = full
    for n, c in enumerate(text[: m - 1], 1):
        u = state & masks.get(c, 0)
        state = (state + u | state - u) & full
        best = max(best, 200.0 * (m - state.bit_count()) / (m + n))
    return best


def _within(needle: str, text: str, cutoff: float) -> float:
    """The best ratio of the needle with the text's stretches, if it is at least the cutoff (else something below it)."""
    m, n = len(needle), len(text)
    best = max(_beginnings(needle, text), _beginnings(needle[::-1], text[::-1]))
    a, t = _codes(needle), _codes(text)
    q = min(GRAM, m)
    windows = n - m + 1
    # a gram of the text that the needle has may be shared; prefix sums count them for all stretches
    key = lambda x: sum(x[i : len(x) - q + 1 + i].astype(np.uint64) << np.uint64(21 * (q - 1 - i)) for i in range(q))
    held = np.concatenate([[0], np.cumsum(np.isin(key(t), key(a)))])
    shared = held[m - q + 1 :] - held[:windows]
    # shared >= (m - q + 1) - (2 q - 1) (m - L)
    bound = np.minimum(m, m - -(-(m - q + 1 - shared) // (2 * q - 1)))
    order = np.argsort(-bound, kind="stable")
    alphabet, bits = _masks(a)
    letters = _letters(alphabet, t)
    for i in range(0, windows, LANES):
        some = order[i : i + LANES]
        most = 100.0 * bound[some[0]] / m
        if most <= best or most < cutoff:
            break
        best = max(best, 100.0 * int(common_lengths(bits, letters, some, m, m).max()) / m)
    return best


def partial_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """the best ratio of the shorter string with a stretch of the longer one; 0 if it is below the cutoff. Of equally long ones, each is tried against the other."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    needle, text = (a, b) if len(a) <= len(b) else (b, a)
    if needle in text:
        return 100.0
    best = _within(needle, text, cutoff)
    if len(a) == len(b):
        best = max(best, _within(text, needle, cutoff))
    return best if best >= cutoff else 0.0


def unsupported(said: DataFrame, evidence: DataFrame, key: str, sentence: str = "content", text: str = "text", threshold: float = 88.0, least: int = 8) -> DataFrame:
    """sentences of at least `least` characters that no evidence text of their key contains, or nearly (partial_ratio), white space and case aside.

    Sentences that a text contains never reach Python. The others meet the texts of their key in bundles of bounded size, so a key of many sentences
    or texts is many rows; a row is decided by the first bundle member's bounds upwards, in one pass over its text.
    """

    @F.arrow_udf("array<boolean>")
    def near(sentences: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([[partial_ratio(s, t, threshold) >= threshold for s in own] for own, t in zip(sentences.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(pa.bool_()))

    own = said.where(F.length(sentence) >= least).select(key, sentence, tx.squeezed(sentence).alias("__s")).distinct()
    pool = evidence.select(key, tx.squeezed(text).alias("__e"))
    plain = own.join(pool, key, "left").groupBy(key, sentence, "__s").agg(F.coalesce(F.bool_or(F.contains("__e", F.col("__s"))), F.lit(False)).alias("hit")).where("not hit").drop("hit")
    bundles = plain.groupBy(key).agg(F.ceil(F.count("*") / SENTENCES).alias("n"))
    dealt = plain.select(key, F.col("__s").alias("s")).distinct().join(bundles, key).groupBy(key, F.pmod(F.xxhash64("s"), "n").alias("b")).agg(F.collect_list("s").alias("__all"))
    judged = dealt.join(pool.distinct(), key).select(key, F.arrays_zip(F.col("__all").alias("s"), near("__all", "__e").alias("near")).alias("z")).select(key, F.inline("z"))
    held = judged.where("near").select(key, F.col("s").alias("__s")).distinct()
    return plain.join(held, [key, "__s"], "left_anti").select(key, sentence)


def best_team(slots: list[int], options: dict[int, list[tuple[float, int]]]) -> dict[int, tuple[int, float]]:
    """{slot: (person, score)}, the team of most filled slots, then highest score, where a slot with a free candidate is never left empty.

    Slots are asked in order, so an empty one's candidates must all be taken by slots before it. An assignment of least cost is found with a
    dear place of its own for each slot; where an empty slot's candidate is taken later, either the slot must be filled, or its candidates are for earlier slots
    only: both are solved, best first. Ties go to earlier candidates, slot by slot.
    """
    people = sorted({p for s in slots for _, p in options.get(s, [])})
    number = {p: j for j, p in enumerate(people)}
    n, m = len(slots), len(people)
    if not n:
        return {}
    cost = np.full((n, m + n), math.inf)
    for i, s in enumerate(slots):
        for score, p in options.get(s, []):
            cost[i, number[p]] = min(cost[i, number[p]], -score)
    finite = np.abs(cost[:, :m][np.isfinite(cost[:, :m])])
    dear = 2.0 * float(finite.sum()) + 1.0
    cost[np.arange(n), m + np.arange(n)] = dear
    known = np.isfinite(cost[:, :m])

    def legal(to: np.ndarray) -> tuple[int, int] | None:
        """An empty slot and a candidate of it that a later slot takes."""
        taken = {int(j): i for i, j in enumerate(to) if j < m}
        for i in np.flatnonzero(to >= m):
            for j in np.flatnonzero(known[i]):
                if taken.get(int(j), -1) > i:
                    return int(i), int(j)
        return None

    def best(c: np.ndarray, limit: float) -> tuple[float, np.ndarray] | None:
        """The least cost of a legal assignment, up to the limit."""
        open_: list[tuple[float, int, np.ndarray, np.ndarray]] = []
        count = 0

        def push(c: np.ndarray) -> None:
            nonlocal count
            if (got := least_cost(c)) is not None and got[0] <= limit + 1e-9:
                count += 1
                open_.append((got[0], count, c, got[1]))

        push(c)
        while open_:
            at = min(range(len(open_)), key=lambda k: open_[k][:2])
            total, _, c, to = open_.pop(at)
            if (fault := legal(to)) is None:
                return total, to
            i, j = fault
            swapped = to.copy()  # often the same cost: the person goes to the empty slot
            later = int(np.flatnonzero(to == j)[0])
            swapped[i], swapped[later] = j, m + later
            worth = c[np.arange(n), swapped].sum()
            if worth <= total + 1e-9 and np.isfinite(worth) and legal(swapped) is None:
                return total, swapped
            filled = c.copy()
            filled[i, m + i] = math.inf
            push(filled)
            empty = c.copy()
            empty[i, :m] = math.inf
            empty[i + 1 :, :m][:, known[i]] = math.inf
            push(empty)
        return None

    total, to = best(cost, math.inf)
    free = least_cost(cost)  # without the rule
    slack = cost - free[2][:, None] - free[3][None, :]  # what taking a place costs beyond the least total, at least
    for i, s in enumerate(slots):  # earlier candidates, where the whole stays as good
        for _, p in options.get(s, []):
            j = number[p]
            if j == to[i]:
                break
            if free[0] + slack[i, j] > total + 1e-9 or not np.isfinite(cost[i, j]):
                continue
            fixed = cost.copy()
            fixed[i, np.arange(m + n) != j] = math.inf
            fixed[np.arange(n) != i, j] = math.inf
            if (other := best(fixed, total)) is not None:
                to = other[1]
                break
        j = int(to[i])
        cost[i, np.arange(m + n) != j] = math.inf
        cost[np.arange(n) != i, j] = math.inf
    return {s: (people[int(to[i])], max(x for x, p in options[s] if p == people[int(to[i])])) for i, s in enumerate(slots) if to[i] < m}


def least_cost(cost: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
    """The least total of a column of its own for each row, the columns, and the prices of rows and columns; none where some row has no finite one. Rows join one by one along a shortest path."""
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        near, back, done = np.full(m, math.inf), np.full(m, -1), np.zeros(m, bool)
        i, column, base = row, -1, 0.0
        tree = [row]
        while True:
            with np.errstate(invalid="ignore"):
                reach = base + cost[i] - u[i] - v
            better = ~done & (reach < near)
            near[better], back[better] = reach[better], column
            j = int(np.argmin(np.where(done, math.inf, near)))
            base = near[j]
            if done[j] or not np.isfinite(base):
                return None
            done[j] = True
            column = j
            if owner[j] < 0:
                break
            i = int(owner[j])
            tree.append(i)
        seen = np.flatnonzero(done & (np.arange(m) != column))
        u[row] += base
        for j in seen:
            u[owner[j]] += base - near[j]
        v[seen] -= base - near[seen]
        while column >= 0:  # along the path, each row gives its column to the one before
            before = int(back[column])
            owner[column] = owner[before] if before >= 0 else row
            column = before
    to = np.full(n, -1)
    to[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return float(cost[np.arange(n), to].sum()), to, u, v
