"""Seams for models (§2.12): each is a function of DataFrames with a deterministic default, so that plans run without any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import extract as ex
from quarry.operators.retrieval import hash_embedding, lexical_score, to_dense, top_k


def per_partition(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A model made once per partition and applied to its batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield model(b)

    return df.mapInPandas(run, schema)


def mock_generate(snippets: Column, most: int = 3) -> Column:
    """The first sentences of up to three snippets."""
    return F.array_join(F.transform(F.slice(F.filter(snippets, lambda s: F.trim(s) != ""), 1, most), lambda s: F.get(tx.sentences(s), F.lit(0))), "\n")


def mock_review(content: Column, least: int = 20) -> Column:
    return F.when(F.length(F.trim(tx.text(content))) >= least, "PASS").otherwise("FAIL")


def mock_rewrite(query: Column) -> Column:
    return tx.squash(query)


def embed(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """The default embedding: signed feature hashing."""
    return to_dense(hash_embedding(df, key, text, size), key, size)


def fallback_template(title: Column, requirement: Column) -> Column:
    return F.format_string("%s\n\n%s", F.coalesce(title, F.lit("")), F.coalesce(requirement, F.lit("")))


def run_steps(steps: dict[str, Callable[[], DataFrame]], status: dict[str, str]) -> dict[str, str]:
    """A step executor: runs what is not done, in order; stops at the first failure."""
    for name, step in steps.items():
        if status.get(name) == "success":
            continue
        try:
            step()
            status[name] = "success"
        except Exception as e:  # noqa: BLE001  the state table records it, and a later run resumes here
            status[name] = f"failed: {e}"[:300]
            break
    return status


def rerank_by(hits: DataFrame, make: Callable[[], Callable[[pd.Series, pd.Series], list[float]]], k: int, query: str = "query_id", key: str = "chunk_id", asked: str = "query", text: str = "text", quality: str = "quality") -> DataFrame:
    """Hits (with rank, score and quality) by the scores of a model of query and text, which `make` makes once per partition; equal scores keep their order.

    A query of which the model could score not every hit is ranked by words (C10), as all are if the model cannot be made.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in hits.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = make()
        except Exception:  # noqa: BLE001  an absent model is a case of its own, see above
            model = None
        for b in batches:
            try:
                scores = None if model is None else [float(x) for x in model(b[asked], b[text])]
            except Exception:  # noqa: BLE001
                scores = None
            yield b.assign(__model=pd.array(scores if scores is not None and len(scores) == len(b) else [None] * len(b), dtype="Float64"))

    scored = hits.mapInPandas(run, f"{kinds}, __model double")
    whole = F.count_if(F.col("__model").isNull() | F.isnan("__model")).over(W.partitionBy(query)) == 0
    new = F.when(whole, F.col("__model")).otherwise(lexical_score(asked, text, quality))
    by = scored.withColumn("__whole", whole).withColumn("score", new).withColumn("__was", F.when(F.col("__whole"), F.col("rank"))).drop("rank")
    return top_k(by, [query], [F.desc(F.round("score", 9)), F.asc_nulls_last("__was"), F.asc(key)], k).drop("__model", "__whole", "__was")


def facts_or(df: DataFrame, key: str, fallback: Callable[[DataFrame], DataFrame] | None = None, text: str = "text", patterns=ex.FACTS) -> DataFrame:
    """The rules' facts, and, for documents of which the rules miss any field, those of the fallback (key, field, value) where the rules have none. The rules win."""
    own = ex.facts(df, key, text, patterns)
    if fallback is None:
        return own
    whole = own.groupBy(key).agg(F.countDistinct("field").alias("n")).where(F.col("n") >= len({n for n, _ in patterns}))
    asked = df.join(whole.select(key), key, "left_anti")
    return ex.merge_facts(own, fallback(asked).select(key, "field", "value").where("value is not null"), key)


def scorecard_by(tables: DataFrame, key: str, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A scorecard's items (key, item_no, name, score) by a model of its tables, or by the rule if none is given; with the total and the status in which it waits for its confirmation."""
    items = ex.scorecard(tables, key) if extract is None else extract(tables).select(key, "item_no", "name", F.coalesce("score", F.lit(0.0)).alias("score")).withColumn("total", F.sum("score").over(W.partitionBy(key)))
    return items.withColumn("status", F.lit("PENDING_CONFIRM"))
