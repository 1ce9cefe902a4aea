"""Hybrid retrieval for batches of queries (C2-C26): every row carries its query, so one plan answers all queries.

Batches of queries meet texts and vectors in blocks of bounded size (blocks.py), each task keeping its k best. Over a stored index term
scores are equi-joins on the term, with map-side partial sums. Per-query top-k is `row_number() <= k`, which Spark prunes before its sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx
from quarry.operators import blocks
from quarry.operators.terms import find


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def sparse_vectors(df: DataFrame, key: str, text: str = "text", idf: DataFrame | None = None) -> DataFrame:
    """(key, term, weight), weight tf / length, times the term's idf if there is a table of them (absent terms: 1)."""
    own = df.select(key, tx.tokens(text).alias("t")).select(key, F.size("t").alias("n"), F.explode("t").alias("term"))
    out = own.groupBy(key, "term").agg((F.count("*") / F.first("n")).alias("weight"))
    if idf is None:
        return out
    return out.join(idf.select("term", "idf"), "term", "left").select(key, "term", (F.col("weight") * F.coalesce("idf", F.lit(1.0))).alias("weight"))


def term_slot(term: Column, size: int) -> tuple[Column, Column]:
    """The slot and sign of a term by its sha1."""
    h = F.sha1(term.cast("binary"))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int"), F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hash_embedding(df: DataFrame, key: str, text: str = "text", size: int = 64) -> DataFrame:
    """(key, slot, value) of the signed feature-hash vector, L2-normalised; zero slots are left out."""
    slot, sign = term_slot(F.col("term"), size)
    own = df.select(key, F.explode(tx.tokens(text)).alias("term")).select(key, slot.alias("slot"), sign.alias("s"))
    sums = own.groupBy(key, "slot").agg(F.sum("s").alias("v")).where("v <> 0")
    return sums.select(key, "slot", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(key)))).alias("value"))


def to_dense(df: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, embedding) of hash_embedding's rows."""
    made = F.map_from_entries(F.collect_list(F.struct("slot", "value")))
    return df.groupBy(key).agg(made.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))


def fit_size(c: Column, size: int) -> Column:
    """C4: a vector cut or padded with zeros to `size`."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(0.0), size)), 1, size)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id", embedding: str = "embedding", per_block: int = 4096) -> DataFrame:
    """(query, key, score, rank) by cosine, ties to the smaller key. Queries meet all vectors in blocks of about per_block; vectors that are null, hold a null or have no length take no part."""
    own = lambda df, c: df.where(F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull())).select(c, F.col(embedding).cast("array<double>").alias("v"))
    found = blocks.search(own(queries, query), own(vectors, key), k, query, key, blocks.cosines, per_block)
    return top_k(found, [query], [F.desc("score"), F.asc(key)], k)


def sparse_top_k(queries: DataFrame, index: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """C6 over an index that is stored: (query, key, score, rank) by the dot product over shared terms; both sides have term and weight."""
    q = queries.select(query, "term", F.col("weight").alias("w"))
    score = index.join(q, "term").groupBy(query, key).agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    return top_k(score, [query], [F.desc(F.round("score", 9)), F.asc(key)], k)


def sparse_search(queries: DataFrame, chunks: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id", asked: str = "query", text: str = "text", per_block: int = 512) -> DataFrame:
    """C6 over texts: what sparse_top_k gives for sparse_vectors of both sides, without a row per term or per pair that shares one."""
    terms = sparse_vectors(queries, query, asked).groupBy(query).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("terms"))  # a query's terms
    found = blocks.search(terms, chunks.select(key, tx.tokens(text).alias("t")), k, query, key, blocks.shared_terms, per_block)
    return top_k(found, [query], [F.desc(F.round("score", 9)), F.asc(key)], k)


def prefilter(df: DataFrame, equal: dict[str, object], sensitivity: str = "sensitivity", tags: str = "tags", status: str = "status") -> DataFrame:
    """Public, not about prices, not deprecated, and equal in the fields that are asked for (None: not asked)."""
    out = df.where((F.col(sensitivity) == "PUBLIC_OK") & ~F.coalesce(F.array_contains(tags, "PRICING_RELATED"), F.lit(False)) & (F.coalesce(status, F.lit("")) != "deprecated"))
    for c, v in equal.items():
        out = out if v is None else out.where(F.col(c) == F.lit(v))
    return out


def postfilter(df: DataFrame, as_of: str, sensitivity: str = "sensitivity", tags: str = "tags", status: str = "status", until: str = "valid_to", expires: str = "expires") -> DataFrame:
    """The same checks once more (an absent sensitivity is public), and neither date before as_of."""
    day = F.lit(as_of).cast("date")
    fresh = lambda c: F.coalesce(F.col(c) >= day, F.lit(True))
    return df.where((F.coalesce(sensitivity, F.lit("PUBLIC_OK")) == "PUBLIC_OK") & ~F.coalesce(F.array_contains(tags, "PRICING_RELATED"), F.lit(False)) & fresh(until) & fresh(expires) & (F.coalesce(status, F.lit("")) != "deprecated"))


def fuse(lists: Sequence[DataFrame], top: int, query: str = "query_id", key: str = "chunk_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion, sum of 1 / (k + rank); ties go to hits of earlier lists, then by their rank there."""
    rows = None
    for i, one in enumerate(lists):
        own = one.select(query, key, "rank", F.lit(i).alias("list"))
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy(query, key).agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return top_k(fused, [query], [F.desc(F.round("score", 9)), F.asc("first"), F.asc(key)], top).drop("first")


def relevance(query: Column, text: Column) -> Column:
    """1 if the text contains the query; else the larger of shared words / query words and shared Han pairs / the query's pairs."""
    q, t = F.lower(F.trim(tx.text(query))), F.lower(F.trim(tx.text(text)))
    own = F.array_distinct(tx.tokens(query))
    overlap = F.when(F.size(own) > 0, F.size(F.array_intersect(own, tx.tokens(text))) / F.size(own)).otherwise(0.0)
    pairs = tx.bigrams(tx.cjk(q))
    both = F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda p: F.contains(t, p))) / F.size(pairs)).otherwise(0.0)
    return F.when((q != "") & F.contains(t, q), 1.0).otherwise(F.greatest(overlap, both))


def lexical_score(asked: str, text: str, quality: str) -> Column:
    """.55 score + .40 relevance + .05 quality in percent."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(quality).cast("double"), F.lit(0.0)) / 100))
    return F.col("score") * 0.55 + relevance(F.col(asked), F.col(text)) * 0.40 + share * 0.05


def rerank(hits: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id", asked: str = "query", text: str = "text", quality: str = "quality") -> DataFrame:
    """By lexical_score."""
    return top_k(hits.drop("rank").withColumn("score", lexical_score(asked, text, quality)), [query], [F.desc(F.round("score", 9)), F.asc(key)], k)


# Numbers with units, and model names.
NUMBER_UNIT = r"(\d+(?:\.\d+)?\s*(?:kV|KV|kv|V|A|kW|MW|Hz|MHz|GHz|mm|cm|m))"
MODEL_NAME = r"(?U)(\b[A-Za-z]{1,6}[-_ ]?\d{2,}[A-Za-z0-9-]*\b)"


def key_facts(query: Column) -> Column:
    """C11: numbers with units and model names of a query, in lower case without spaces."""
    found = F.concat(F.regexp_extract_all(tx.text(query), F.lit(NUMBER_UNIT), F.lit(1)), F.regexp_extract_all(tx.text(query), F.lit(MODEL_NAME), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(found, tx.squeezed)))


def key_fact_filter(hits: DataFrame, query: str = "query_id", asked: str = "query", text: str = "text", context: str | None = None) -> DataFrame:
    """Hits that hold any key fact of their query; all of them where none does or the query has no facts."""
    t = tx.squeezed(text) if context is None else F.concat_ws(" ", tx.squeezed(text), tx.squeezed(context))
    hit = F.exists(key_facts(F.col(asked)), lambda f: F.contains(t, f))
    own = hits.withColumn("__hit", hit)
    return own.withColumn("__any", F.max("__hit").over(W.partitionBy(query))).where("__hit or not __any").drop("__hit", "__any")


def reorder(hits: DataFrame, ranked: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Hits in a model's order (ranked: query, key, place), the unranked after them as they were."""
    both = hits.withColumnRenamed("rank", "__was").join(ranked.groupBy(query, key).agg(F.min("place").alias("place")), [query, key], "left")
    return top_k(both, [query], [F.asc_nulls_last("place"), F.asc("__was")], k).drop("__was", "place")


def ranked_ids(answer: Column) -> Column:
    """C14: the ranked ids in a model's answer, trimmed; from the first JSON object in it that parses, empty if none."""
    kind = "struct<ranked_chunk_ids:array<string>>"
    whole = F.from_json(F.trim(tx.text(answer)), kind).ranked_chunk_ids
    inner = F.from_json(F.regexp_extract(tx.text(answer), r"(?s)\{.*?\}", 0), kind).ranked_chunk_ids
    return F.coalesce(F.filter(F.transform(F.coalesce(whole, inner), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def best_score(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score, the first of the columns that has one."""
    return df.withColumn("score", F.coalesce(*columns))


def search(queries: DataFrame, chunks: DataFrame, as_of: str, k: int = 5, pool: tuple[int, int] = (10, 20), equal: dict[str, object] | None = None, size: int = 64) -> DataFrame:
    """(query_id, chunk_id, score, rank). queries: query_id, query; chunks: chunk_id, text, embedding (null: none), quality, sensitivity, tags, status, valid_to, expires.

    Both lists have max(50, min(max(5k, 128), 100)) hits; the result has k, clamped to pool.
    """
    want, limit = max(pool[0], min(k, pool[1])), max(50, min(max(5 * k, 128), 100))
    allowed = postfilter(prefilter(chunks, equal or {}), as_of)
    asked = to_dense(hash_embedding(queries, "query_id", "query", size), "query_id", size)
    dense = dense_top_k(asked, allowed.where("embedding is not null"), limit)
    sparse = sparse_search(queries, allowed, limit)
    fused = fuse([dense, sparse], limit)
    hits = fused.join(queries.select("query_id", "query"), "query_id").join(allowed.select("chunk_id", "text", "quality"), "chunk_id")
    return key_fact_filter(rerank(hits, want)).select("query_id", "chunk_id", "score", "rank")


def expand(queries: DataFrame, synonyms: DataFrame, query: str = "query") -> DataFrame:
    """C17: the query followed by the sorted aliases (term, alias) of terms it contains, as far as it does not have them. Terms are found in one pass (see terms.find)."""
    said = find(queries.select(query).distinct().withColumn("__q", F.col(query)), synonyms, "__q", keep=(query,)).select(query, "term").distinct()
    met = said.join(synonyms.select("term", "alias"), "term").where(~F.contains(F.col(query), F.col("alias")))
    more = met.groupBy(query).agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("__more"))
    return queries.join(more, query, "left").withColumn("expanded", F.concat_ws(" ", query, "__more")).drop("__more")


def decompose(df: DataFrame, key: str, text: str, short: int = 8, separator: str = "[，,；;。]+", continuations: Sequence[str] = lx.CONTINUATIONS, kinds: lx.Lexicon = lx.SUB_REQUIREMENTS, glue: str = "，") -> DataFrame:
    """(key, sub_no, description, category): parts between separators; a short part, or one that begins with a continuation word, goes to the part before it."""
    parts = tx.pieces(text, separator)
    goes_on = lambda p: (F.length(p) < short) | F.exists(F.array(*[F.lit(w) for w in continuations]), lambda w: F.startswith(p, w))
    step = lambda acc, p: F.when((F.size(acc) > 0) & goes_on(p), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.lit(glue), p)))).otherwise(F.concat(acc, F.array(p)))
    merged = F.aggregate(parts, F.array().cast("array<string>"), step)
    own = F.when(F.size(parts) == 0, F.array(tx.text(text))).otherwise(merged)
    return df.select(key, F.posexplode(own).alias("__i", "description")).select(key, (F.col("__i") + 1).alias("sub_no"), "description", lx.first_match(F.col("description"), kinds, "GENERAL").alias("category"))


def merge_hits(hits: DataFrame, key: Sequence[str], sub: str = "sub_no", chunk: str = "chunk_id") -> DataFrame:
    """Each chunk once per key: its position by first appearance, its score by the last, and the sub-queries it covers."""
    at = F.struct(sub, "rank")
    one = hits.groupBy(*key, chunk).agg(F.min(at).alias("first"), F.max_by("score", at).alias("score"), F.array_sort(F.collect_set(sub)).alias("covers"))
    return one.withColumn("position", F.row_number().over(W.partitionBy(*key).orderBy("first"))).drop("first")


def bm25(queries: DataFrame, candidates: DataFrame, query: str = "query_id", key: str = "chunk_id", asked: str = "query", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Candidates (query, key, text) with their BM25 score within their query's candidates (0 without shared terms)."""
    docs = candidates.select(query, key, tx.tokens(text).alias("t")).withColumn("len", F.size("t"))
    by = W.partitionBy(query)
    stats = docs.withColumns({"n": F.count("*").over(by), "avg": F.greatest(F.lit(1.0), F.avg("len").over(by))})
    terms = queries.select(query, F.explode(F.array_distinct(tx.tokens(asked))).alias("term"))
    tf = stats.select(query, key, "len", "n", "avg", F.explode("t").alias("term")).join(terms, [query, "term"]).groupBy(query, key, "term", "len", "n", "avg").agg(F.count("*").alias("f"))
    df = F.count("*").over(W.partitionBy(query, "term"))
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    score = tf.withColumn("part", part).groupBy(query, key).agg(F.sum("part").alias("bm25"))
    return candidates.join(score, [query, key], "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 9))


def pack_context(scored: DataFrame, query: str = "query_id", key: str = "chunk_id", text: str = "text", items: int = 6, chars: int = 4000, snippet: int = 800) -> DataFrame:
    """The snippets packed for each query, best first: a snippet that overflows is skipped unless it is the first. (query, place, key, snippet)"""
    cut = F.substring(F.trim(tx.text(text)), 1, snippet)
    # beyond this place nothing that fits can change the result's first `items`, but skipped ones may be many, so all are folded; candidates of one query are few
    each = scored.withColumn("__s", cut).where("__s <> ''").groupBy(query).agg(F.array_sort(F.collect_list(F.struct((-F.col("bm25")).alias("o"), F.col(key).alias("key"), F.col("__s").alias("s")))).alias("c"))
    zero = F.struct(F.array().cast("array<struct<key:bigint,s:string>>").alias("got"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        n = F.length(x.s)
        full = (F.size(acc.got) >= items) | (acc.used >= chars) | ((F.size(acc.got) > 0) & (acc.used + n > chars))
        return F.when(full, acc).otherwise(F.struct(F.concat(acc.got, F.array(F.struct(x.key.cast("bigint").alias("key"), x.s.alias("s")))).alias("got"), (acc.used + n).alias("used")))

    return each.select(query, F.posexplode(F.aggregate("c", zero, step, lambda acc: acc.got)).alias("place", "g")).select(query, "place", F.col("g.key").alias(key), F.col("g.s").alias("snippet"))


def compression(candidates: DataFrame, packed: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """Characters before and after packing, and how many texts were dropped."""
    a = candidates.groupBy(query).agg(F.sum(F.length(text)).alias("original_chars"), F.count("*").alias("n"))
    b = packed.groupBy(query).agg(F.sum(F.length("snippet")).alias("packed_chars"), F.count("*").alias("m"))
    return a.join(b, query, "left").select(query, "original_chars", F.coalesce("packed_chars", F.lit(0)).alias("packed_chars"), F.greatest(F.lit(0), F.col("n") - F.coalesce("m", F.lit(0))).alias("dropped"))


def with_context(text: Column, context: Column) -> Column:
    """The parent's context if there is one, else the text."""
    return F.coalesce(F.nullif(F.trim(context), F.lit("")), text)


def expiry(valid_to: Column, as_of: str, soon: int = 30) -> Column:
    """Unknown, expired, expiring_soon or valid."""
    left = F.datediff(F.try_to_timestamp(valid_to.cast("string"), F.lit("yyyy-MM-dd")).cast("date"), F.lit(as_of).cast("date"))
    return F.when(left.isNull(), "unknown").when(left < 0, "expired").when(left <= soon, "expiring_soon").otherwise("valid")


def cache_key(tag: Column, template: Column, requirement: Column, ids: Column, version: str = "v1") -> Column:
    """Tag:template:sha256 of the text:sha256 of the sorted ids:version."""
    return F.concat_ws(":", F.coalesce(tag, F.lit("-")), F.coalesce(template, F.lit("-")), F.sha2(F.trim(tx.text(requirement)), 256), F.sha2(F.to_json(F.array_sort(ids)), 256), F.lit(version))
