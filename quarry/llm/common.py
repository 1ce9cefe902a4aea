"""What several operators of this subpackage share: shared scratch tables, ASCII rules, connected components."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Rows in a batch that goes to Python: texts may be long, and a batch is held in both processes.
BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(text: str) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return text.encode().lower().split()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. Where that is unset, one of our own on a single machine (tests); an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        shared = spark.sparkContext.getCheckpointDir()
    return shared


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later uses neither recompute it nor depend on one executor's disk."""
    path = f"{scratch(df.sparkSession)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.settled_at = path
    return made


def drop(*tables: DataFrame) -> None:
    """Removes tables that settle() wrote. Only for those of which nothing is left to compute: what was made of them is settled itself."""
    for t in tables:
        if path := getattr(t, "settled_at", None):
            at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks; it holds only what can be rebuilt. Asking for another name drops it."""
    m = sys.modules.setdefault("_quarry_process_cache", types.ModuleType("_quarry_process_cache"))
    held = m.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: pairs (a, b), in any order, repeats and loops allowed. Returns (node, root), root the smallest node of the
    component, for every node but the roots. Each round is two aggregations with map-side combining; the
    rounds grow with the logarithm of the component size, and each round's edges are written to the shared folder.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = settle(edges.select(low.alias("v"), high.alias("u")).where("u <> v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are settled apart from the joins, so that a star's edges can be split over tasks
        low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc")
        large = settle(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, settle(small, "cc")
        drop(last, low, large, least)
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
