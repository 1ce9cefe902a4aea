"""Terms of a lexicon in texts (C17, B27, D3, D17, E1): every place of every term, in one pass over the texts.

A lexicon of bounded size is broadcast and becomes one automaton in each Python worker, however many terms it has, so the pass does not grow with the
terms. A larger one stays where it is: texts and terms meet by a term's first GRAM characters in a hash join, and the whole term is
compared at the place where these stand. Neither form joins by `contains`.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Characters of all terms up to which a lexicon is broadcast; characters by which terms and texts are joined beyond it.
BROADCAST, GRAM = 8_000_000, 4
_BUILT: dict[bytes, ahocorasick.Automaton] = {}


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """The automaton of non-empty terms; a worker keeps the last few it was asked for."""
    name = hashlib.sha256("\0".join(terms).encode()).digest()
    if name not in _BUILT:
        if len(_BUILT) >= 4:
            _BUILT.pop(next(iter(_BUILT)))
        made = ahocorasick.Automaton()
        for t in terms:
            made.add_word(t, len(t))
        if terms:
            made.make_automaton()
        _BUILT[name] = made
    return _BUILT[name]


def _by_automaton(own: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    shared = own.sparkSession.sparkContext.broadcast(terms)

    @F.arrow_udf("array<struct<at: int, length: int>>")
    def places(texts: pa.Array) -> pa.Array:
        a = automaton(shared.value)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32())]))
        return pa.array([[{"at": end - n + 1, "length": n} for end, n in a.iter(t)] if len(a) and t else [] for t in texts.to_pylist()], kind)

    met = own.withColumn("__p", places("__text")).select(*keep, "__text", F.explode("__p").alias("__p"))
    return met.select(*keep, F.substr("__text", F.col("__p.at") + 1, F.col("__p.length")).alias("term"), F.col("__p.at").alias("at"))


def _by_grams(own: DataFrame, terms: DataFrame, keep: list[str]) -> DataFrame:
    """Lengths of the terms' beginnings are few, so a text gives a row for each place and such length."""
    lengths = [r.n for r in terms.select(F.least(F.length("term"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM numbers at most
    begins = terms.select("term", F.substring("term", 1, GRAM).alias("__gram"))

    def begun(n: int) -> Column:
        at = F.when(F.length("__text") >= n, F.sequence(F.lit(1), F.length("__text") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.substr("__text", i, F.lit(n)).alias("gram"), i.alias("i")))

    if not lengths:
        return own.select(*keep, F.lit("").alias("term"), F.lit(0).alias("at")).limit(0)
    grams = own.select(*keep, "__text", F.inline(F.concat(*map(begun, lengths))))
    met = grams.join(begins, F.col("gram") == F.col("__gram")).where(F.substr("__text", F.col("i"), F.length("term")) == F.col("term"))
    return met.select(*keep, "term", (F.col("i") - 1).alias("at"))


def find(df: DataFrame, lexicon: DataFrame, text: str = "text", term: str = "term", keep: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """The columns of keep, term and at (code points before it) of every place where a term of the lexicon stands, overlapping ones too.

    Null texts have no terms; null and empty terms are none; a term that repeats counts once. most: characters up to which the lexicon is broadcast.
    """
    own = df.select(*keep, tx.text(text).alias("__text"))
    terms = lexicon.select(F.col(term).cast("string").alias("term")).where("term <> ''").distinct()
    size = terms.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if size <= (BROADCAST if most is None else most):
        return _by_automaton(own, sorted(r.term for r in terms.collect()), list(keep))
    return _by_grams(own, terms, list(keep))
