"""From raw documents to packed training sequences, in four stages.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the stage before kept. The first three return the
columns of documents; the last returns the pieces and where they are packed. Rows without an id, and rows that repeat one, are judged
like any other: near-dedup tells them apart by their texts, and drops only equal and nearly equal ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop, settle, small_batches
from quarry.llm.packing import pack, pieces
from quarry.llm.quality import classify
from quarry.llm.simhash import near_groups
from quarry.llm.substring import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier does not reject."""
    small_batches(spark)
    return classify(docs.select(*COLUMNS), keep=COLUMNS[1:]).where("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies; texts without words are alone. Rows whose id is null or not their own go by a hash of id and text."""
    docs = docs.select(*COLUMNS)  # other columns may have names of ours
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("__d"), F.lit(True).alias("__odd"))
    both = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    hashed = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(2**63)))  # below all ids
    keyed = both.select(F.when(F.col("__odd"), hashed).otherwise(F.col("doc_id")).alias("__key"), "__odd", *COLUMNS)
    gone = near_groups(keyed, doc_id="__key").where("group_id <> doc_id").select(F.col("doc_id").alias("__key")).distinct()
    kept = keyed.join(gone, "__key", "left_anti")
    again = kept.where("__odd").dropDuplicates(["__key"])
    return kept.where("__odd is null").unionByName(again).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that stand in an earlier document, or earlier in the same one."""
    kept = remove_repeats(docs, window=20, keep=("lang", "source"), spaced=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; documents of which nothing is left are not packed."""
    left = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return pack(settle(pieces(left, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit", best_fit)]
#: SQL can express neither the fitted classifier nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settle(stage(spark, docs, sf_dir), name)
        drop(last)  # nothing is left to compute of it
    return STAGES[-1][1](spark, docs, sf_dir)
