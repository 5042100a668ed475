"""URL filters by link-graph propagation. DataFrame operations only.

Hosts are judged by two personalised PageRanks over the host graph: trust flows along links from the hosts of allowed
pages, distrust flows against them from the hosts of blocked pages. A host is blocked where distrust outweighs trust.
Rules come first: the longest one that fits a page decides it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialize

#: (verdict, host and path prefix). Fixed values of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: A flow ends when no rank above TINY grows by more than this share; every rank is then exact to this share times the
#: mean length of the ways to it. TINY is where doubles lose digits, some 4000 links from the seeds.
TOLERANCE, TINY = 1e-6, 1e-290
#: A host without a rule is blocked where its distrust is above this many times its trust.
RATIO = 1.0
MAX_RULES = 256
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]+)"
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), A_Z, a_z)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and all subdomains, by path prefix."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compared as expressions")
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, kind).otherwise(verdict)
    return found, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, w): links from host a to another host b, counted. Links without a host stay within one and carry none."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1))
    out = pages.select(F.col("host").alias("a"), F.explode(links).alias("link"))
    to = F.translate(F.regexp_extract("link", r"^(?:[^/]*)//([^/?#]*)", 1), A_Z, a_z)
    return out.select("a", to.alias("b")).where("a <> '' AND b <> '' AND a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, name: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, name): personalised PageRank over edges (a, b, w) with restarts at seeds (host, s), whose s sum to 1.

    Each round adds what ways of one more link bring, so ranks only grow. It is an equi-join on the source and a
    grouped sum combined before its shuffle; what a host without links holds returns to the seeds by way of
    normalisation at the end. The lineage is cut by a written table each round. There are as many rounds as the longest
    way has links, but where ways run in circles at most about log(tolerance) / log(DAMPING) rounds more.
    """
    out = edges.groupBy("a").agg(F.sum("w").alias("total"))
    moves = materialize(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p")))
    seeds = materialize(seeds)
    if moves.isEmpty():
        return seeds.select("host", F.col("s").alias(name))
    first = F.col("s") * (1 - DAMPING)
    rank = seeds.select("host", first.alias("r"), first.alias("more"))
    growing = (F.col("more") > tolerance * F.col("r")) & (F.col("r") > TINY)
    while not rank.where(growing).isEmpty():
        flow = rank.where("more > 0").join(moves, F.col("host") == F.col("a")).select(F.col("b").alias("host"), F.lit(0.0).alias("r"), (F.col("more") * F.col("p") * DAMPING).alias("more"))
        both = flow.union(rank.select("host", "r", F.lit(0.0))).groupBy("host").agg(F.sum("r").alias("r"), F.sum("more").alias("more"))
        before, rank = rank, materialize(both.select("host", (F.col("r") + F.col("more")).alias("r"), "more"))
        discard(before)
    total = rank.agg(F.sum("r")).first()[0] or 1.0
    return rank.select("host", (F.col("r") / total).alias(name))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html).

    Where a rule fits, verdict is the rule's; else it is block if the host's distrust is above RATIO times its trust.
    Hosts that neither flow reaches, the empty host among them, are allowed. Seeds are weighted by their pages.
    Null urls have an empty host and path, null html has no links; urls and pages of any length are read whole. Repeated
    rows are judged alike and count as seeds as often; other columns are ignored. Empty input gives no rows.
    """
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = materialize(placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")))
    edges = materialize(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")))
    ends = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    ends = materialize(ends)
    n_hosts, good, bad, width = ends.agg(F.count("*"), F.sum("good"), F.sum("bad"), F.max(F.length("host"))).first()
    seeds = lambda c, total: ends.where(F.col(c) > 0).select("host", (F.col(c) / (total or 1)).alias("s"))
    trust = propagate(edges, seeds("good", good), "trust")
    distrust = propagate(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"), seeds("bad", bad), "distrust")
    scores = materialize(ends.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"]))
    out = ruled.join(bounded_broadcast(scores, n_hosts, 4 * (width or 0) + 60), "host", "left").na.fill(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > RATIO * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")


def _oracle() -> str:
    """The same flows summed over all ways of up to 200 links."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    longest = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(*r.split('/', 1))} THEN '{pick(k, r)}'" for k, r in longest) + " END"
    flow = lambda name, moves, seeds: (
        f"{name} AS (SELECT host, 0 k, {seeds}::DOUBLE / sum({seeds}) OVER () * {1 - DAMPING} more FROM ends WHERE {seeds} > 0 "
        f"UNION ALL SELECT b, k + 1, sum(more * p * {DAMPING}) FROM {name} JOIN {moves} ON host = a WHERE k < 200 GROUP BY b, k),\n"
        f"{name}_rank AS (SELECT host, sum(more) / (SELECT sum(more) FROM {name}) r FROM {name} GROUP BY host)"
    )
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{A_Z}', '{a_z}') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path, coalesce(html, '') html FROM pages),
ruled AS (SELECT page_id, host, path, html, {case(lambda k, r: r)} rule, {case(lambda k, r: k)} verdict FROM u),
l AS (SELECT host a, translate(regexp_extract(link, '^(?:[^/]*)//([^/?#]*)', 1), '{A_Z}', '{a_z}') b FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) link FROM ruled)),
e AS (SELECT a, b, count(*) w FROM l WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
down AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) p FROM e), up AS (SELECT b a, a b, w / sum(w) OVER (PARTITION BY b) p FROM e),
ends AS (SELECT host, count(*) FILTER (verdict = 'allow') good, count(*) FILTER (verdict = 'block') bad FROM ruled WHERE host <> '' GROUP BY host),
{flow("trust", "down", "good")},
{flow("distrust", "up", "bad")}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.r, 0) > {RATIO} * coalesce(t.r, 0) THEN 'block' ELSE 'allow' END) verdict
FROM ruled LEFT JOIN trust_rank t USING (host) LEFT JOIN distrust_rank d USING (host)
"""


ORACLE = _oracle()
