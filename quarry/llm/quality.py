"""Quality classifier from weak labels.

Seven heuristics each call a text good, bad or abstain. Expectation-maximisation over the counts of their joint votes (at most 3^7
kinds, whatever the input's size) estimates the share of good texts and each heuristic's accuracy on good and bad texts; the
posterior of a text's votes is its label. A linear scorer over hashed words and word shapes is trained on these labels and scores
every text; texts that score below `cut` are rejected.

The scorer is fitted on a sample of about SAMPLE different rows: those whose 64-bit hash of id and text is under a bound, so the share
may be as small as the input asks for. Of a sampled text at most SLOTS features are taken (those of the least hash), which bounds
the sample in bytes, too. Votes are counted and texts scored over all rows and whole texts.

Defined results: a null or empty text has no words and is rejected (nothing can be trained on it); repeated rows are sampled as one
and scored alike; null ids are kept; if all labels agree, the scorer is that label; very long texts are read whole. The stop words are
those of four languages: texts in others get no good vote from that labeller, and its accuracy is estimated with that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import process_cache

LABELLERS = ("shouting", "marks", "bars", "stopwords", "symbols", "repeats", "variety")
SAMPLE, SLOTS, BITS = 8000, 2048, 16
# Common function words of English, French, German and Spanish.
STOP = frozenset(
    b"a an and are as at be by for from has in is it of on or that the this to was were with "
    b"au aux avec ce dans de des du elle en est et il la le les ne par pas pour qui que sur un une "
    b"als auch auf das dem den der des die ein eine im in ist mit nicht sich und von zu "
    b"al con como del el es las lo los mi no para por se si su una y".split()
)
_MARK = re.compile(rb"([^\w\s\x80-\xff])\1")
_DIGIT, _UP, _LOW, _WIDE, _RUN = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[^\x00-\x7f]"), re.compile(r"(.)\1+", re.S)


def _vote(x: float, good: float, bad: float) -> int:
    """1 (good) up to `good`, 0 (bad) from `bad` on, -1 between; the bounds may be the other way round."""
    if good > bad:
        x, good, bad = -x, -good, -bad
    return 1 if x <= good else 0 if x >= bad else -1


def votes(text: str) -> tuple[int, ...]:
    """1 good, 0 bad, -1 abstains, of each of LABELLERS."""
    data = text.encode()
    words = data.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    alike = int(counts[48:58].sum()) + upper + lower + int(counts[128:].sum())
    inked = max(1, len(data) - int(counts[9:14].sum()) - int(counts[32]))
    stops = sum(map(STOP.__contains__, data.lower().split()))
    same = sum(map(eq, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x]
    return (
        _vote(upper / max(1, upper + lower), 0.2, 0.5),
        _vote(len(_MARK.findall(data)) / n, 0.02, 0.2),
        _vote(words.count(b"|") / n, 0.01, 0.1),
        _vote(stops / n, 0.15, 0.04) if n >= 20 else -1,
        _vote((inked - alike) / inked, 0.1, 0.16) if n >= 8 else -1,
        -1 if len(lines) < 4 else _vote(1 - len(set(lines)) / len(lines), 0.05, 0.3),
        -1 if len(words) < 2 else _vote(same / n, 0.02, 0.1),
    )


def fit_labellers(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The shares of good texts and of a kind of bad texts for each labeller, and each labeller's chance of saying good (if it says anything) on each kind.

    patterns: joint votes and how often they occur. Labellers overlap, so badness has several kinds: they are taken as independent
    given the kind. At the start a text that any calls bad is of those labellers' kinds, others are good.
    """
    v = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    k = np.array([c for _, c in patterns], np.float64)
    said, good = v >= 0, v == 1
    post = np.concatenate([(v != 0).all(1)[:, None], v == 0], axis=1) + 0.01
    post /= post.sum(1, keepdims=True)
    for _ in range(rounds):
        w = post * k[:, None]
        prior = (w.sum(0) + 0.01) / (w.sum() + 0.01 * post.shape[1])
        rate = (w.T @ good + 0.01) / (w.T @ said + 0.02)
        post = _kinds(v, prior, rate)
    return prior, rate


def _kinds(v: np.ndarray, prior: np.ndarray, rate: np.ndarray) -> np.ndarray:
    said, good = v >= 0, v == 1
    log = np.log(prior) + good @ np.log(rate).T + (said & ~good) @ np.log(1 - rate).T
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def posterior(v: np.ndarray, prior: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The chance that texts with these votes are good."""
    return _kinds(v, prior, rate)[:, 0]


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other alphabets as x, runs shortened to two."""
    return _RUN.sub(r"\1\1", _WIDE.sub("x", _LOW.sub("a", _UP.sub("A", _DIGIT.sub("0", word)))))


REPEATED = 0


def slots(word: str, bits: int = BITS) -> tuple[int, int]:
    """The features of a word: itself (lower-cased) and its shape. Slot REPEATED is for words equal to the one before."""
    most = (1 << bits) - 1
    return xxhash.xxh64_intdigest(word.lower(), 1) % most + 1, xxhash.xxh64_intdigest(shape(word), 2) % most + 1


def counted(text: str, bits: int = BITS, most: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text's features and how often each occurs; of more than `most` those of the least hash."""
    words = text.split()
    times = Counter(words)
    found: Counter[int] = Counter()
    for w, k in times.items():
        for i in slots(w, bits):
            found[i] += k
    if same := sum(map(eq, words, words[1:])):
        found[REPEATED] += same
    kept = sorted(found, key=lambda i: i * 0x9E3779B97F4A7C15 % 2**64)[:most]
    return np.array(kept, np.uint32), np.array([found[i] for i in kept], np.uint32)


def bound(total: int, sample: int) -> int:
    """The signed 64-bit hash up to which about `sample` of `total` rows have theirs; all do if there are fewer."""
    return -(2**63) + min(2**64 * sample // max(1, total), 2**64 - 1)


def chosen(rows: DataFrame, total: int, sample: int) -> DataFrame:
    """__h and __text of the rows (doc_id, __text) to be sampled."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("__text", F.lit("")))
    return rows.select(h.alias("__h"), "__text").where(F.col("__h") <= F.lit(bound(total, sample)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 8, step: float = 0.4, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression by AdaGrad; a row has slots and counts, each slot with value 2 * count / all counts."""
    w, b = np.zeros(1 << bits), float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    g, gb, order = np.full(1 << bits, 1e-3), 1e-3, np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own, k = rows[i]
            if not len(own):
                continue
            x = k * (2 / k.sum())
            d = 1 / (1 + np.exp(-np.clip(b + w[own] @ x, -60, 60))) - labels[i]
            grad = d * x + decay * w[own]
            g[own] += grad * grad
            w[own] -= step * grad / np.sqrt(g[own])
            gb += d * d
            b -= 0.1 * d / np.sqrt(gb)
    return w, float(b)


def classify(df: DataFrame, cut: float = 0.5, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, votes (a letter g, b or - each), posterior, score (the scorer's chance of good), rejected, and the columns of keep, for every row."""
    spark = df.sparkSession
    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"), *[F.col(k).alias(f"k_{k}") for k in keep])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for b in batches:
            for t in b.column(0):
                v = "".join("bg-"[x] for x in votes(t.as_py() or ""))
                found[v] = found.get(v, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["v", "n"])

    said = one.select("__text").mapInArrow(count, "v string, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()  # 3^7 rows at most
    number = {"b": 0, "g": 1, "-": -1}
    patterns = sorted((tuple(number[x] for x in r["v"]), r["n"]) for r in said)
    total = sum(n for _, n in patterns)
    prior, rate = fit_labellers(patterns) if patterns else (np.ones(1), np.full((1, len(LABELLERS)), 0.5))
    label = {p: float(posterior(np.array([p]), prior, rate)[0]) for p, _ in patterns}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, goal = [], []
            for t in b.column(1):
                own = t.as_py() or ""
                rows.append(b"".join(x.astype("<u4").tobytes() for x in counted(own)))
                goal.append(label[votes(own)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), pa.array(goal, pa.float64())], ["h", "at", "goal"])

    # about `sample` rows of at most 8 * SLOTS bytes; repeated rows have one hash and are one of them, so few may be left: then more are asked for
    got, many = [], sample
    while total and not got:
        got = chosen(one, total, many).mapInArrow(featured, "h long, at binary, goal double").groupBy("h").agg(F.min("at").alias("at"), F.min("goal").alias("goal")).collect()
        if not got and many >= total:
            raise RuntimeError("no row was sampled")
        many *= 64
    got.sort(key=lambda r: r["h"])
    rows, labels = [tuple(np.frombuffer(r["at"], "<u4").reshape(2, -1)) for r in got], np.array([r["goal"] for r in got])
    w, b0 = fit_scorer(rows, labels) if got else (np.zeros(1 << BITS), 0.0)
    model = spark.sparkContext.broadcast(w.astype(np.float32))  # 2^BITS numbers

    names = [f"k_{k}" for k in keep]
    schema = one.select("doc_id", F.lit("").alias("votes"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"), *names).schema
    key = xxhash.xxh64_hexdigest(w.astype(np.float32).tobytes())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = process_cache("quality"), model.value
        if own.get("key") != key:
            own.update(key=key, words={})
        known: dict[str, float] = own["words"]
        for b in batches:
            said, post, points, out = [], [], [], []
            for t in b.column("__text"):
                s = t.as_py() or ""
                v, words = votes(s), s.split()
                if len(known) > 300_000:
                    known.clear()
                for x in set(words).difference(known):
                    i, j = slots(x)
                    known[x] = float(weights[i]) + float(weights[j])
                same = sum(map(eq, words, words[1:]))
                x = (sum(map(known.__getitem__, words)) + same * float(weights[REPEATED])) * 2 / max(1, 2 * len(words) + same)
                p = 1 / (1 + np.exp(-np.clip(b0 + x, -60, 60)))
                said.append("".join("bg-"[x] for x in v))
                post.append(label[v])
                points.append(round(float(p), 6))
                out.append(not words or p < cut)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said, pa.string()), pa.array(post, pa.float64()), pa.array(points, pa.float64()), pa.array(out, pa.bool_()), *[b.column(k) for k in names]], ["doc_id", "votes", "posterior", "score", "rejected", *names])

    return one.mapInArrow(score, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))
