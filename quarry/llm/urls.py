"""URL filters: rules by host and path, and for pages no rule fits, trust and distrust spread over links between hosts.

Trust is personalised PageRank from hosts that the rules allow, along links; distrust is the same from hosts that the rules
block, against links (who links to blocked hosts is suspect). Seeds share the walk's mass equally, hosts without a link onward give
theirs back to the seeds, and rounds go on until no host's score changes by more than a small part of itself, so hosts far from every
seed count as well. A host with more distrust than trust is blocked; a bound on distrust may block others. Built of DataFrame functions
only; pages are reduced to hosts and links before anything is shuffled, so a host with most pages weighs no more than another.

Defined results: null url or one without `://` has empty host and path, no rule, and is allowed; null html has no links; very long ones
are read whole; links may leave out the scheme (`//host/`); repeated rows are judged each; links count once per pair of hosts, links
within a host not at all; a host whose pages are allowed and blocked equally often is no seed; without seeds all scores are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, drop, settle

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MOST_RULES = 1000
#: Rounds stop at changes of TOLERANCE of each score: after the graph's diameter and some 70 more.
DAMPING, TOLERANCE = 0.85, 1e-5
#: Scores that differ by less, relatively, are equal.
EQUAL = 1e-12
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'<>]+)"
_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def linked_host(link: Column) -> Column:
    """The host of a link, which may begin with //."""
    return host(F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link)).otherwise(link))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(n, rule, verdict); null if none does. Rules travel in the plan, so there may be MOST_RULES at most."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for a plan")
    each = [F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.greatest(*each, F.lit(None)) if each else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def spread(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """hosts: (host, good, bad) seeds of 0 or 1; links: (src, dst), distinct. Returns (host, trust, distrust) of every host with any; each sums to 1 over all hosts.

    What hosts without a link onward hold goes back to the seeds; that only scales all scores alike, so it is done once, at the end.
    """
    some = hosts.where("good > 0 or bad > 0")
    n = some.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    share = lambda c: (F.col(c).cast("double") / F.lit(float(n[c] or 1)))
    seeds = settle(some.select("host", share("good").alias("trust"), share("bad").alias("distrust")), "seeds")
    if links.isEmpty():
        return seeds
    # settled apart from the joins, whose sides can be split only if both are dealt for them
    out, into = (settle(links.groupBy(c).agg(F.count("*").alias("k")), "degrees") for c in ("src", "dst"))
    ahead = links.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (1 / F.col("k")).alias("good"), F.lit(0.0).alias("bad"))
    back = links.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("good"), (1 / F.col("k")).alias("bad"))
    edges = settle(ahead.unionByName(back), "links")
    now, no = seeds, F.lit(0.0)
    while True:
        moved = now.join(edges, "host").select(F.col("to").alias("host"), (F.lit(damping) * F.col("trust") * F.col("good")).alias("trust"), (F.lit(damping) * F.col("distrust") * F.col("bad")).alias("distrust"), no.alias("t"), no.alias("d"))
        fresh = seeds.select("host", (F.lit(1 - damping) * F.col("trust")).alias("trust"), (F.lit(1 - damping) * F.col("distrust")).alias("distrust"), no.alias("t"), no.alias("d"))
        old = now.select("host", no.alias("trust"), no.alias("distrust"), F.col("trust").alias("t"), F.col("distrust").alias("d"))
        made = settle(fresh.unionByName(moved).unionByName(old).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")]), "rank")
        changed = lambda c, o: F.coalesce(F.max(F.abs(F.col(c) - F.col(o)) / F.nullif(F.col(c), F.lit(0.0))), F.lit(0.0))
        change = made.agg(F.greatest(changed("trust", "t"), changed("distrust", "d"))).first()[0]
        if now is not seeds:
            drop(now)
        now = made
        if change <= tolerance:
            break
    total = now.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    return now.select("host", *[(F.col(c) / F.lit(total[c] or 1.0)).alias(c) for c in ("trust", "distrust")])


def filter_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, most_distrust: float | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust (rounded to 9 places; compared as they are).

    most_distrust: where given, hosts with that much distrust or more are blocked whatever their trust.
    """
    said = F.col("__url")
    one = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("__url"), F.col(html).cast("string").alias("__html"))
    judged = one.select("page_id", host(said).alias("host"), path(said).alias("path")).withColumn("__rule", rule(F.col("host"), F.col("path"), rules))
    found = one.select(host(said).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("__html", F.lit(_LINK), F.lit(1)), linked_host))).alias("dst"))
    links = settle(found.where("src <> dst and src <> '' and dst <> ''").distinct(), "links")
    counts = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("__rule.verdict") == "allow").alias("a"), F.count_if(F.col("__rule.verdict") == "block").alias("b"))
    seeds = counts.select("host", (F.col("a") > F.col("b")).cast("int").alias("good"), (F.col("b") > F.col("a")).cast("int").alias("bad"))
    ranks = spread(seeds, links, damping).select(F.col("host").alias("__host"), F.col("trust").alias("__trust"), F.col("distrust").alias("__distrust"))
    both = judged.join(ranks, F.col("host") == F.col("__host"), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # equal sums, added in another order, differ by some last bits; that is no more distrust
    more = none("__distrust") > none("__trust") * (1 + EQUAL)
    if most_distrust is not None:
        more = more | (none("__distrust") >= most_distrust)
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(more, "block").otherwise("allow"))
    shown = lambda c: F.round(none(f"__{c}"), 9).alias(c)
    return both.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), shown("trust"), shown("distrust"))
