"""Queries of operators that make, keep and merge records (B, C, D, F, G, H, S), over whole tables, with their SQL. What a sink writes is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import analytics as an
from quarry.operators import chunking as ch
from quarry.operators import extract as ex
from quarry.operators import relational as rl
from quarry.operators import retrieval as rt
from quarry.operators import scoring as sc
from quarry.operators import state as st
from quarry.operators import structure as sx
from quarry.plans.views import table, typed
from quarry.session import shared_folder
from quarry.sources import readers as rd
from quarry.sources import sinks as sk

Q: dict = {}
SQL: dict[str, str] = {}
TYPES: dict[str, dict[str, str]] = {}


def query(sql: str | None = None, **types: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = typed(sql, types)
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/quarry-records-{uuid.uuid4().hex}"


_LINES = "SELECT doc_id, i, trim(regexp_replace(l[i], '^\\s+|\\s+$', '', 'g')) AS x FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) a) b"
_PARA = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_no, x AS content FROM ({_LINES}) WHERE x <> ''"


@query("SELECT source, round(count(*) * 0.10, 2) AS low, round(count(*) * 0.35, 2) AS high, round(count(*) * 0.01, 2) AS embedding FROM documents GROUP BY source")
def enhancement_cost(spark, d):
    """The cost band of each source's documents."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", an.enhancement_cost(F.col("n")).alias("c")).select("source", "c.*")


@query("SELECT item_id, 'K' || CAST(item_id % 3 AS VARCHAR) AS kind, 'ex-' || substr(sha1(CAST(item_id AS VARCHAR) || ':K' || CAST(item_id % 3 AS VARCHAR) || ':' || trim(text)), 1, 16) AS chunk_id FROM benchmark WHERE trim(text) <> ''")
def extraction_chunks(spark, d):
    """S10."""
    rows = table(spark, d, "benchmark").withColumn("kind", F.concat(F.lit("K"), (F.col("item_id") % 3).cast("string")))
    return rd.extraction_chunks(rows, "item_id", "text", "kind").select("item_id", "kind", "chunk_id")


@query("SELECT doc_id, lang, n_chars, md5(text) AS digest FROM documents")
def json_sink(spark, d):
    """Written in folders by language and read back."""
    at = _folder(spark)
    sk.write_json(table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text"), at, ("lang",))
    return spark.read.schema("doc_id long, n_chars long, text string, lang string").json(at).select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))


@query("SELECT c_custkey, c_name, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer")
def csv_sink(spark, d):
    """Written and read back."""
    at = _folder(spark)
    sk.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), at)
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string, c_acctbal double").option("header", True).option("escape", '"').csv(at).select("c_custkey", "c_name", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))


@query("""SELECT s_nationkey, '| s_name | s_suppkey |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s_name || ' | ' || CAST(s_suppkey AS VARCHAR) || ' |', chr(10) ORDER BY s_suppkey) AS markdown FROM supplier GROUP BY s_nationkey""")
def asset_markdown(spark, d):
    """A table of each nation's suppliers."""
    return sk.asset_markdown(table(spark, d, "supplier"), "s_nationkey", ("s_name", "s_suppkey"), ("s_suppkey",))


@query("SELECT o_custkey, count(*) AS steps, count(*) FILTER (o_orderstatus = 'F') AS failed, count(DISTINCT o_orderpriority) AS files FROM orders GROUP BY o_custkey")
def import_report(spark, d):
    """Orders as the steps of a customer's import; the report is read back from its JSON."""
    o = table(spark, d, "orders")
    steps = o.select("o_custkey", F.col("o_orderkey").alias("no"), F.lit("load").alias("step"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("OK").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started"), F.col("o_orderdate").cast("timestamp").alias("ended"), F.col("o_orderpriority").alias("file"))
    got = sk.import_report(steps, "o_custkey").withColumn("r", F.from_json("report", "steps array<struct<no: bigint>>, failed bigint, files array<string>"))
    return got.select("o_custkey", F.size("r.steps").cast("long").alias("steps"), "r.failed", F.size("r.files").cast("long").alias("files"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS headers FROM events GROUP BY user_id")
def table_headers(spark, d):
    """The union of the columns of each user's rows."""
    rows = table(spark, d, "events").select("user_id", F.create_map("event_type", "value").alias("row"))
    return sk.header_union(rows, "user_id", "row").select("user_id", F.array_join("headers", ",").alias("headers"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def promoted_rows(spark, d):
    """Orders wait in a staging table; the confirmed ones are added to the target."""
    at, o = _folder(spark), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    staged = rd.stage(o.select("o_orderkey", "o_custkey"), f"{at}/staged")
    rd.promote(spark, staged, o.where("o_orderstatus = 'F'"), f"{at}/target", "o_orderkey")
    return spark.read.parquet(f"{at}/target")


@query(f"""WITH l AS (SELECT doc_id, list(x) AS l FROM ({_LINES}) WHERE x <> '' GROUP BY doc_id)
 SELECT d.doc_id, coalesce(len(list_filter(l, lambda x: regexp_matches(x, '\\|.+\\|'))) > 0 OR len(list_filter(l, lambda x: contains(x, chr(9)))) >= 2 OR len(list_filter(l, lambda x: len(list_filter(string_split_regex(x, '\\s{{2,}}'), lambda p: p <> '')) >= 3)) >= 2, false) AS table_like FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id""")
def table_like(spark, d):
    """B3."""
    return table(spark, d, "documents").select("doc_id", tx.looks_like_table("text").alias("table_like"))


@query(f"SELECT doc_id, block_no, CASE WHEN regexp_matches(content, '^\\s*([-*•]|\\d+[.)、])\\s+') THEN 'LIST' ELSE 'PARA' END AS kind FROM ({_PARA})", block_no="INTEGER")
def paragraph_types(spark, d):
    """B5."""
    b = sx.paragraph_blocks(table(spark, d, "documents"), ["doc_id"], separator="\n")
    return b.select("doc_id", "block_no", tx.paragraph_type("content").alias("kind"))


@query(f"SELECT doc_id, block_no, md5(content) AS digest FROM ({_PARA}) WHERE length(content) >= 200", block_no="INTEGER")
def fallback_chunks(spark, d):
    """B25."""
    b = sx.paragraph_blocks(table(spark, d, "documents"), ["doc_id"], separator="\n")
    return ch.fallback_chunks(b).select("doc_id", "block_no", F.md5("content").alias("digest"))


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{2,}'), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS l FROM documents), r AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS x FROM p)
 SELECT doc_id, n AS paragraph_no, 'fb-' || substr(CAST(doc_id AS VARCHAR), 1, 8) || '-S1-' || CAST(n AS VARCHAR) || '-' || substr(sha1(x), 1, 10) AS chunk_id FROM r""", paragraph_no="INTEGER")
def feedback_chunks(spark, d):
    """B26."""
    return ch.feedback_chunks(table(spark, d, "documents").withColumn("s", F.lit("S1")), "doc_id", "s", "text").select("doc_id", "paragraph_no", "chunk_id")


@query("""SELECT d.doc_id, CASE WHEN n_chars % 3 = 0 THEN quality ELSE n_chars % 5 END AS score, CASE WHEN lang = 'en' THEN CAST(toxic AS VARCHAR) ELSE lang END AS tag FROM (SELECT *, CASE WHEN n_chars % 5 = 0 AND n_chars % 3 <> 0 THEN true ELSE false END AS zero FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT zero
 UNION ALL SELECT d.doc_id, quality, CASE WHEN lang = 'en' THEN CAST(toxic AS VARCHAR) ELSE lang END FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars % 5 = 0 AND n_chars % 3 <> 0""")
def gap_fill(spark, d):
    """A field that is null, zero or empty is taken from the labels."""
    a = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 3 != 0, F.col("n_chars") % 5).alias("score"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("tag"))
    b = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("score"), F.col("toxic").cast("string").alias("tag"))
    return sx.fill_gaps(a, b, "doc_id", ("score", "tag"))


@query("SELECT d.doc_id, d.lang, l.quality, e.label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def merged_sections(spark, d):
    """Documents as structure, labels as meta, clusters as risk."""
    return sx.merge_sections(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), ["doc_id"])


@query("SELECT doc_id, (DATE '2024-01-01' + CAST(n_chars % 90 AS INTEGER)) >= DATE '2024-01-31' OR n_chars % 7 = 0 AS valid FROM documents")
def lifecycle_valid(spark, d):
    """An expiration date, or none."""
    until = F.when(F.col("n_chars") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 90).cast("int")))
    return table(spark, d, "documents").select("doc_id", sx.lifecycle_valid(until, F.lit(None).cast("date"), "2024-01-31").alias("valid"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 40 ELSE 80 END AS size, round(list_sum(list_transform(CASE WHEN vec_id % 2 = 0 THEN embedding[1:40] ELSE embedding END, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings", size="INTEGER")
def fitted_vectors(spark, d):
    """C4: vectors cut to 40 or padded to 80."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fit = F.when(F.col("vec_id") % 2 == 0, rt.fit_size(F.col("v"), 40)).otherwise(rt.fit_size(F.col("v"), 80))
    return e.select("vec_id", fit.alias("v")).select("vec_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT d.doc_id, coalesce(l.quality, d.n_chars % 11) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def best_scores(spark, d):
    """A label where there is one, else a measure."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id", "left").withColumn("length", F.col("n_chars") % 11)
    return rt.best_score(rows, ("quality", "length")).select("doc_id", "score")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'GB/T 500' || CAST(p_size AS VARCHAR) END AS unknown FROM part""")
def unknown_references(spark, d):
    """A standard by size; those of every fourth size are known, written otherwise."""
    text = F.concat(F.lit("按GB/T 500"), F.col("p_size").cast("string"), F.lit("执行，并按DL 5210"))
    known = F.array(F.lit("DL-5210"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("gb/t-500"), F.col("p_size").cast("string"))).otherwise(F.lit("NB 1")))
    return table(spark, d, "part").select("p_partkey", F.array_join(ex.unknown_references(text, F.transform(known, F.upper)), ",").alias("unknown"))


@query("""WITH i AS (SELECT item_id, string_split_regex(text, '[.]') AS l FROM benchmark), r AS (SELECT item_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS x FROM i)
 SELECT item_id, CASE WHEN n % 2 = 0 THEN 'C' || CAST(n AS VARCHAR) ELSE 'REQ-' || lpad(CAST(n AS VARCHAR), 4, '0') END AS code, md5(trim(x)) AS digest FROM r WHERE trim(x) <> ''""")
def payload_rows(spark, d):
    """A model's answer with codes at every second place."""
    parts = F.transform(F.split("text", "[.]", -1), lambda x, i: F.struct(F.when(i % 2 == 1, F.concat(F.lit("C"), (i + 1).cast("string"))).otherwise(F.lit(" ")).alias("code"), x.alias("text")))
    return ex.payload_rows(table(spark, d, "benchmark").select("item_id", parts.alias("items")), "item_id", "items").select("item_id", "code", F.md5("text").alias("digest"))


@query("""WITH f AS (SELECT page_id, regexp_extract(html, '<title>([A-Za-z]+)', 1) AS a, regexp_extract(url, '//([a-z]+)', 1) AS b FROM pages)
 SELECT page_id, 'first' AS field, a AS "left", b AS "right" FROM f WHERE a <> '' AND b <> '' AND a <> b""")
def page_conflicts(spark, d):
    """A page's title and its host name two things."""
    p = table(spark, d, "pages")
    return ex.fact_conflicts(ex.facts(p, "page_id", "html", (("first", "<title>([A-Za-z]+)"),)), ex.facts(p, "page_id", "url", (("first", "//([a-z]+)"),)), "page_id")


@query("""WITH f AS (SELECT page_id, regexp_extract(html, '<h2>([A-Za-z]+)', 1) AS a, regexp_extract(url, '//([a-z]+)', 1) AS b FROM pages) SELECT page_id, 'first' AS field, CASE WHEN a <> '' THEN a ELSE b END AS value FROM f WHERE a <> '' OR b <> ''""")
def merged_facts(spark, d):
    """A page's own fact, else that of its address."""
    p = table(spark, d, "pages")
    return ex.merge_facts(ex.facts(p, "page_id", "html", (("first", "<h2>([A-Za-z]+)"),)), ex.facts(p, "page_id", "url", (("first", "//([a-z]+)"),)), "page_id")


@query("""WITH w AS (SELECT item_id, string_split_regex(lower(text), '[^a-z]+') AS l FROM benchmark) SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(l, lambda x: x NOT IN ('the', 'in', 'and', 'of', '')))), ' ') AS unbound FROM w""")
def unbound_words(spark, d):
    """the words an item uses beyond those allowed."""
    allowed = F.array(*[F.lit(x) for x in ("the", "in", "and", "of", "")])
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(sc.unbound(F.split(F.lower("text"), "[^a-z]+", -1), allowed)), " ").alias("unbound"))


@query("""WITH a AS (SELECT event_id, CAST(event_id % 9 AS INTEGER) AS k FROM events), w AS (SELECT event_id, least(60.0, pow(2.0, k)) AS wait, CAST('0x' || md5(CAST(event_id AS VARCHAR))[1:8] AS BIGINT) AS h FROM a)
 SELECT event_id, CAST(wait AS DOUBLE) AS wait, CAST(h % (CAST(wait AS BIGINT) + 1) AS DOUBLE) AS jittered FROM w""")
def backoff(spark, d):
    """Waits before a retry, and with jitter."""
    k = (F.col("event_id") % 9).cast("int")
    return table(spark, d, "events").select("event_id", st.backoff(k).alias("wait"), st.backoff(k, jitter=F.col("event_id")).alias("jittered"))


@query("SELECT p_partkey, p_size FROM part WHERE p_brand = 'Brand#13' AND p_size > 10")
def active_versions(spark, d):
    """A brand's active parts, the largest first."""
    p = table(spark, d, "part").withColumn("status", F.when(F.col("p_size") > 10, "active").otherwise("old"))
    return rl.active_versions(p, "p_brand", "Brand#13", "p_size").select("p_partkey", "p_size")


@query()
def review_sample(spark, d):
    """documents for manual review."""
    return sc.review_sample(table(spark, d, "documents"), "doc_id").select("doc_id", "source")
