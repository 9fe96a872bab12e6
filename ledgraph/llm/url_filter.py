"""URL filters: rules, and link-graph propagation for what no rule decides; DataFrame functions only.

A rule names a host (with all its subdomains) and a path prefix; of the rules
that fit a url the longest decides.  Urls without a rule are judged by host:

* trust flows along links: personalised PageRank from the hosts that allow
  rules name, in proportion to their allowed pages;
* distrust flows against links (who links to blocked pages is suspect):
  personalised PageRank on the reversed edges, from the hosts with blocked pages;
* a host is blocked if its distrust is at least ``threshold`` times its trust
  and not zero; hosts that neither reaches are allowed.

Edges join different hosts; their weight is the number of links.  A link without
a scheme takes the page's, a relative one the host of the page's base (its own,
if it names none), so it makes an edge only where the base is on another host.  Rank that
reaches a host without edges goes back to the seeds.  Each round's ranks are
written to the shared folder, so a lost executor costs one round at most; the
rounds end when the ranks move by less than ``tolerance`` in all and no host is
new.  A round moves at most ``damping`` of what the one before moved, and a host
is first reached over a shortest path, so the rounds end; with ``rounds`` given
they stop there.

Edge cases.  A null url, or one without ``://``, has an empty host and path, fits
no rule and is allowed; null pages have no links.  Without seeds all scores are
zero.  Of rules of equal length the later one wins.  Repeated rows are judged
alike and each keeps its row, and their links count as often; an empty table
gives an empty result.  Pages are read to their end; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
TOLERANCE = 1e-4
THRESHOLD = 1.0
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?i)<base\s(?:[^>]*?\s)?href\s*=\s*["']?([^"'\s>]+)"""
# Character references of what ends a scheme or a host, and what they stand for.
REFERENCES = ((r"(?i)&(?:#0*47|#x0*2f|sol);?", "/"), (r"(?i)&(?:#0*58|#x0*3a|colon);?", ":"), (r"(?i)&(?:#0*63|#x0*3f|quest);?", "?"), (r"(?i)&(?:#0*35|#x0*23|num);?", "#"), (r"(?i)&(?:#0*46|#x0*2e|period);?", "."))
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)

    def pick(value) -> Column:
        out = F.lit(None).cast("string")
        for verdict, h, p in reversed(ordered):
            out = F.when(fits(h, p), F.lit(value(verdict, h, p))).otherwise(out)
        return out

    return pick(lambda v, h, p: h + p), pick(lambda v, h, p: v)


def judged_by_rule(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict) of each page; rule and verdict null if none fits."""
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("id", "host", "path", name.alias("rule"), verdict.alias("verdict"))


def _plain(link: Column) -> Column:
    for pattern, sign in REFERENCES:
        link = F.regexp_replace(link, pattern, sign)
    return link


def target_of(link: Column, base: Column) -> Column:
    """Host that a link leads to; empty for the page's own host and for links without a host."""
    full = F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link)
    return F.when(full.rlike(SCHEME), F.when(full.rlike(SCHEME + "//"), host_of(full)).otherwise("")).otherwise(base)


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts."""
    page = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    read = pages.select(host_of(F.col(url_col).cast("string")).alias("src"), target_of(_plain(F.regexp_extract(page, BASE, 1)), F.lit("")).alias("base"), F.regexp_extract_all(page, F.lit(LINK), F.lit(1)).alias("links"))
    pairs = read.where("src != ''").select("src", F.explode(F.transform("links", lambda x: target_of(_plain(x), F.col("base")))).alias("dst"))
    return pairs.where("dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): personalised PageRank; ``seeds`` is (host, mass) with masses that add up to one."""
    leaving = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    flow = edges.join(leaving, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    ranks = seeds.select("host", F.col("mass").alias("score"))
    if edges.isEmpty():  # every seed keeps its rank
        return ranks
    flow = written(flow, "links")
    ranks = seeds = written(ranks, "rank").select("host", "score", F.col("score").alias("mass"))
    senders = flow.select(F.col("src").alias("host")).distinct().withColumn("sends", F.lit(True))
    hosts, done = ranks.count(), 0
    while rounds is None or done < rounds:
        done += 1
        total, kept = ranks.join(senders, "host", "left").agg(F.sum("score"), F.sum(F.when(F.col("sends"), F.col("score")))).first()
        total, kept = total or 0.0, kept or 0.0
        sent = ranks.join(flow, ranks["host"] == flow["src"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("part"))
        back = seeds.select("host", (F.col("mass") * (1 - damping + damping * (total - kept))).alias("part"))
        after = written(sent.unionByName(back).groupBy("host").agg(F.sum("part").alias("score")), "rank")
        moved = after.join(ranks.select("host", F.col("score").alias("was")), "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))), F.count("score")).first()
        ranks, before, hosts = after, hosts, moved[1]
        if (moved[0] or 0.0) < tolerance and hosts == before:
            break
    return ranks


def host_scores(judged: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches."""

    def seeds(verdict: str) -> DataFrame:
        per_host = judged.where(F.col("verdict") == verdict).groupBy("host").agg(F.count("*").alias("n"))
        total = per_host.agg(F.sum("n")).first()[0] or 1
        return per_host.select("host", (F.col("n") / F.lit(float(total))).alias("mass"))

    reversed_edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = pagerank(edges, seeds("allow"), **options).select("host", F.col("score").alias("trust"))
    distrust = pagerank(reversed_edges, seeds("block"), **options).select("host", F.col("score").alias("distrust"))
    return trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Every page: id, host, path, rule, verdict, trust and distrust of its host."""
    judged = judged_by_rule(pages, id_col=id_col, url_col=url_col, rules=rules)
    edges = written(host_edges(pages, url_col=url_col, html_col=html_col), "edges")
    scores = host_scores(judged, edges, **options)
    # a host may hold a third of all pages: only the side of one row per host is moved as it is,
    # and the optimiser may split the other side's large partitions
    out = judged.join(scores.withColumnRenamed("host", "of"), F.col("host") == F.col("of"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when((distrust > 0) & (distrust >= threshold * trust), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
