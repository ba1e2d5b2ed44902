"""URL filter: rules by host and path, and trust and distrust carried over links between hosts where no rule fits.

Rules. A rule (action, host, path) fits its host and all hosts below it where the url's path starts with the rule's; the longest
(host and path together; then the longer host; then block) wins. Urls are looked up, not compared with every rule: by the ends of
the host that may be a rule's, then by beginnings of the path as long as one of the paths that rules of that host have.

Propagation. Of a host's urls, of its own pages and as pages of other hosts link to them, a share is allowed and one is blocked by rules: these shares
are what the host is seeded with. Trust is a personalised PageRank: of every round's mass, `damping` goes on over the links of
a host, in proportion to how many of its pages have them. Distrust goes the other way, from a blocked host to those that link to it, in proportion to
how many of the links to it are theirs. A score is the sum over all rounds, the seed's being round 0, so a host that is blocked as a whole has
a distrust of 1 or more. A url that no rule fits is blocked if its host's distrust is `least` or more and above its trust, else allowed.

Links are absolute `href`s of `a` and `area` elements outside comments, scripts and style sheets, to another host, each once a page; the page
is read once, and only if it holds `//` at all. Edges are counted by pairs of hosts, partly before the shuffle, so a host with a third of
all pages is few rows; hosts are numbered, so rounds move two numbers a row, and masses are broadcast up to a number of them.
Rounds end early when nothing is under way.

Defined results. A url that is null or has no `://` has an empty host and path; only a rule with an empty host would fit it, no links count for it, so it
is allowed. A null page has no links. Repeated rows are judged alike, and count as pages of their own. Without rules, or links, or rows, there are
no seeds, no rounds, no rows. Other columns, whatever their names, are ignored by `verdicts` and kept by `allowed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, lower_ascii, table

#: Broadcast up to so many rules and bytes of their text; up to so many hosts' masses (two numbers each).
RULES_TO_BROADCAST, RULE_BYTES_TO_BROADCAST = 100_000, 8 << 20
HOSTS_TO_BROADCAST = 1_000_000
DAMPING, ROUNDS, LEAST = 0.85, 30, 0.5

_SPACE = r" \t\n\r\f"
_UNSEEN = rf"(?is)<!--.*?(?:-->|\z)|<script[{_SPACE}>/].*?(?:</script|\z)|<style[{_SPACE}>/].*?(?:</style|\z)"
_LINK = rf"""(?is)<(?:a|area)(?:[{_SPACE}][^<>]*)?[{_SPACE}]href[{_SPACE}]*=[{_SPACE}]*["']?[{_SPACE}]*(?:https?:)?//([^?#"'<>{_SPACE}]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def links_of(html: Column) -> Column:
    """array<string>: what follows the // in links to a named host, up to its path's end, each once."""
    found = F.regexp_extract_all(F.regexp_replace(html, _UNSEEN, " "), F.lit(_LINK), F.lit(1))
    return F.when(html.contains("//"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path: distinct, and more) with rule and action, null where none fits."""
    rules = cut(rules.select(lower_ascii(F.col("host")).alias("_end"), F.col("path").alias("_start"), "action").where("_end is not null and _start is not null"), "url-rules")
    n, size, longest = rules.agg(F.count("*"), F.sum(F.octet_length("_end") + F.octet_length("_start")), F.max(F.length("_end"))).first()
    few = n <= RULES_TO_BROADCAST and (size or 0) <= RULE_BYTES_TO_BROADCAST
    side = F.broadcast if few else lambda df: df
    # no rule's host is longer than the tail but for its first character, which tells whether a label begins behind it
    tail = F.right("host", F.lit((longest or 0) + 1))
    begins = lambda i: F.when(i == 1, F.length("host") <= (longest or 0) + 1).otherwise(F.substring(tail, i - 1, F.lit(1)) == ".")
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(tail), F.lit(1))), begins), lambda i: F.substring(tail, i, F.lit((longest or 0) + 1)))
    sizes = rules.select("_end", F.length("_start").alias("_size")).distinct()
    tried = urls.select("host", "path", F.explode_outer(ends).alias("_end")).join(side(sizes), "_end").where(F.col("_size") <= F.length("path"))
    tried = tried.withColumn("_start", F.left("path", F.col("_size")))
    order = F.struct(F.length("_end") + F.length("_start"), F.length("_end"), F.col("action") == "block")
    best = tried.join(side(rules), ["_end", "_start"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_end", "_start").alias("rule"), "action"), order).alias("_r"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "_r.rule", "_r.action")


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(back, id, score) of edges (a, b, pages) and seeds (back, id, mass); back: against the links."""
    # a host's edges are summed up and joined; a window over them would gather a hub's
    out, into = (edges.groupBy(c).agg(F.sum("pages").alias("_all")) for c in ("a", "b"))
    ahead = edges.join(out, "a").select(F.lit(False).alias("back"), F.col("a").alias("id"), F.col("b").alias("to"), (F.col("pages") / F.col("_all")).alias("share"))
    back = edges.join(into, "b").select(F.lit(True).alias("back"), F.col("b").alias("id"), F.col("a").alias("to"), (F.col("pages") / F.col("_all")).alias("share"))
    ways = cut(ahead.unionByName(back), "url-ways")
    mass = cut(seeds.where("mass > 0"), "url-mass-0")
    every = mass
    for i in range(1, rounds + 1):
        n = mass.count()
        if n == 0:
            break
        side = F.broadcast(mass) if n <= HOSTS_TO_BROADCAST else mass
        moved = ways.join(side, ["back", "id"]).groupBy("back", F.col("to").alias("id")).agg((damping * F.sum(F.col("mass") * F.col("share"))).alias("mass"))
        mass = cut(moved, f"url-mass-{i}")
        every = every.unionByName(mass)
    return every.groupBy("back", "id").agg(F.sum("mass").alias("score"))


def verdicts(pages: DataFrame, rules: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """(host, path, rule, verdict, trust, distrust) of every different url of pages (url, html); rules: (action, host, path)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    slim = cut(pages.select(host.alias("host"), path.alias("path"), links_of(F.col("html")).alias("links")), "url-links")
    links = slim.where("host <> '' and size(links) > 0").select("host", F.explode_outer("links").alias("to"))
    cut_at = F.locate("/", F.col("to"))
    to_host = lower_ascii(F.when(cut_at > 0, F.left("to", cut_at - 1)).otherwise(F.col("to")))
    links = links.select("host", to_host.alias("to_host"), F.when(cut_at > 0, F.substring("to", cut_at, F.length("to"))).otherwise("").alias("to_path")).where("to_host <> '' and to_host <> host")

    own = slim.select("host", "path", F.lit(1).alias("own"), F.lit(1).alias("n"))
    linked = links.select(F.col("to_host").alias("host"), F.col("to_path").alias("path"), F.lit(0).alias("own"), F.lit(1).alias("n"))
    urls = cut(own.unionByName(linked).groupBy("host", "path").agg(F.max("own").alias("own"), F.sum("n").alias("n")), "urls")
    judged = cut(fitting_rules(urls, rules), "url-judged")
    part = lambda action: F.coalesce(F.sum(F.when(F.col("action") == action, F.col("n"))), F.lit(0)) / F.sum("n")
    hosts = judged.where("host <> ''").groupBy("host").agg(part("allow").alias("allowed"), part("block").alias("blocked"))
    hosts = cut(hosts.withColumn("id", F.monotonically_increasing_id()), "url-hosts")

    named = links.groupBy("host", "to_host").agg(F.count("*").alias("pages"))
    ids = hosts.select("host", "id")
    edges = named.join(ids.withColumnRenamed("id", "a"), "host").join(ids.select(F.col("host").alias("to_host"), F.col("id").alias("b")), "to_host")
    edges = cut(edges.select("a", "b", "pages"), "url-edges")
    seeds = hosts.select(F.lit(False).alias("back"), "id", F.col("allowed").alias("mass")).unionByName(hosts.select(F.lit(True).alias("back"), "id", F.col("blocked").alias("mass")))
    scores = (seeds.withColumnRenamed("mass", "score") if edges.isEmpty() else propagated(edges, seeds, damping, rounds)).groupBy("id")
    of = lambda back: F.coalesce(F.sum(F.when(F.col("back") == back, F.col("score"))), F.lit(0.0))
    scores = scores.agg(of(False).alias("trust"), of(True).alias("distrust"))
    by_host = hosts.select("host", "id").join(scores, "id").select("host", "trust", "distrust")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    known = judged.where("own = 1").join(by_host, "host", "left").select("host", "path", "rule", "action", zero("trust"), zero("distrust"))
    method = F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return known.select("host", "path", "rule", F.coalesce("action", method).alias("verdict"), "trust", "distrust")


def _joined(pages: DataFrame, rules: DataFrame, *columns: Column, **how) -> DataFrame:
    mine = pages.select(*columns, host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    return mine.join(cut(verdicts(pages, rules, **how), "url-verdicts"), ["host", "path"])


def allowed(pages: DataFrame, rules: DataFrame, **how) -> DataFrame:
    """The pages whose urls are allowed, with all their columns."""
    return _joined(pages, rules, F.struct(*[pages[c] for c in pages.columns]).alias("_page"), **how).where("verdict = 'allow'").select("_page.*")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return _joined(pages, rules, pages["page_id"]).select("page_id", "host", "path", "rule", "verdict")


OP12_SQL = f"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {", ".join(map(str, RULES))}),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
raw AS (SELECT host, unnest(list_distinct(regexp_extract_all(regexp_replace(html, '{_UNSEEN}', ' ', 'g'), '{_LINK.replace("'", "''")}', 1))) AS target FROM p WHERE host <> ''),
ln AS (
  SELECT host, translate(split_part(target, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS to_host,
         CASE WHEN contains(target, '/') THEN substr(target, strpos(target, '/')) ELSE '' END AS to_path FROM raw),
links AS (SELECT * FROM ln WHERE to_host <> '' AND to_host <> host),
urls AS (SELECT host, path, count(*) AS n FROM (SELECT host, path FROM p UNION ALL SELECT to_host, to_path FROM links) GROUP BY ALL),
fits AS (
  SELECT u.host, u.path, arg_max(struct_pack(rule := r.host || r.path, action := r.action), struct_pack(a := length(r.host || r.path), b := length(r.host), c := r.action = 'block')) AS best
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL),
judged AS (SELECT u.*, best.rule AS rule, best.action AS action FROM urls u LEFT JOIN fits f ON u.host = f.host AND u.path = f.path),
hosts AS (SELECT host, coalesce(sum(n) FILTER (action = 'allow'), 0) / sum(n) AS allowed, coalesce(sum(n) FILTER (action = 'block'), 0) / sum(n) AS blocked FROM judged WHERE host <> '' GROUP BY host),
edges AS (SELECT host AS a, to_host AS b, count(*) AS pages FROM links GROUP BY ALL),
ways AS (
  SELECT false AS back, a AS at, b AS goes, pages / sum(pages) OVER (PARTITION BY a) AS share FROM edges
  UNION ALL
  SELECT true, b, a, pages / sum(pages) OVER (PARTITION BY b) FROM edges),
flow AS (
  SELECT * FROM (SELECT 0 AS k, false AS back, host, allowed::DOUBLE AS mass FROM hosts UNION ALL SELECT 0, true, host, blocked::DOUBLE FROM hosts) WHERE mass > 0
  UNION ALL
  SELECT k + 1, w.back, w.goes, {DAMPING}::DOUBLE * sum(mass * share) FROM flow f JOIN ways w ON f.back = w.back AND f.host = w.at WHERE k < {ROUNDS} GROUP BY k, w.back, w.goes),
score AS (SELECT host, coalesce(sum(mass) FILTER (NOT back), 0) AS trust, coalesce(sum(mass) FILTER (back), 0) AS distrust FROM flow GROUP BY host)
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) >= {LEAST} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN judged j ON p.host = j.host AND p.path = j.path LEFT JOIN score s ON p.host = s.host
"""
