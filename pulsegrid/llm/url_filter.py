"""URL filter with redirect equivalence (DataFrame functions only).

A rule fits its host and all subdomains where the url's path starts with the rule's;
the longest fitting rule decides (of equal lengths an allowing one, then the first by
name). Urls joined by redirect or canonical-link edges are aliases: their components
are found by distributed star contraction, and a url without a rule is blocked if an
alias is blocked by a rule and none is explicitly allowed.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no
rule, has no aliases and is allowed; null html has no links; self links and repeated
rows change nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import connected_components, lower_ascii, stage, table

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def part(url: Column | str, i: int) -> Column:
    """1: host, 2: path, 3: query with its question mark."""
    c = F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return lower_ascii(c) if i == 1 else c


def _fitting(host: Column, path: Column, rules, value) -> Column:
    out = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, value(h, p, v)) if out is None else out.when(fits, value(h, p, v))
    return F.lit(None).cast("string") if out is None else out


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    return _fitting(host, path, rules, lambda h, p, v: h + p)


def verdict_of(host: Column, path: Column, rules=RULES) -> Column:
    return _fitting(host, path, rules, lambda h, p, v: v)


def node(host: Column, path: Column, query: Column) -> Column:
    """Urls that differ in scheme or fragment only are one node; null without a host."""
    return F.when(host != "", F.xxhash64(host, path, query))


def links_of(pages: DataFrame) -> DataFrame:
    """(url, target): canonical links and refresh redirects of each page, resolved against its url."""
    tag = lambda pattern: F.regexp_extract("html", pattern, 0)
    canonical = F.regexp_extract(tag(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(tag(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = pages.select("url", F.explode(F.array(canonical, refresh)).alias("href")).where("href <> '' and url is not null")
    base = F.concat(F.lit("x://"), part("url", 1))
    folder = F.regexp_extract(part("url", 2), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    target = (
        F.when(F.col("href").contains("://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href"))
        .when(F.col("href").startswith("/"), F.concat(base, "href"))
        .when(F.col("href").startswith("#"), F.col("url"))
        .when(F.col("href").startswith("?"), F.concat(base, part("url", 2), "href"))
        .otherwise(F.concat(base, folder, "href"))
    )
    return found.select("url", target.alias("target"))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; ``edges`` adds (url, target) redirects."""
    links = links_of(pages)
    if edges is not None:
        links = links.union(edges.select("url", "target"))
    ends = lambda c: node(part(c, 1), part(c, 2), part(c, 3))
    links = stage(links.select("url", "target", ends("url").alias("u"), ends("target").alias("v")).where("u <> v").distinct(), "links")
    roots = connected_components(links.select("u", "v"))
    urls = links.select(F.col("url").alias("x"), F.col("u").alias("node")).union(links.select("target", "v")).distinct()
    urls = urls.select("node", verdict_of(part("x", 1), part("x", 2), rules).alias("v")).where("v is not null")
    known = urls.join(roots, "node").groupBy("root").agg(F.max(F.col("v") == "block").alias("b"), F.max(F.col("v") == "allow").alias("a"))
    blocked = roots.join(known.where("b and not a"), "root").select(F.col("node").alias("alias"))
    p = pages.select("page_id", part("url", 1).alias("host"), part("url", 2).alias("path"), part("url", 3).alias("query"))
    p = p.withColumn("node", node(F.col("host"), F.col("path"), F.col("query"))).join(blocked, F.col("node") == F.col("alias"), "left")
    own = verdict_of(F.col("host"), F.col("path"), rules)
    return p.select(
        "page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"),
        F.coalesce(own, F.when(F.col("alias").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH RECURSIVE r(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
h AS (
  SELECT url, unnest([
    regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')]) AS href
  FROM pages WHERE url IS NOT NULL),
t AS (
  SELECT url, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN 'x:' || href
    WHEN starts_with(href, '/') THEN 'x://' || regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') || href
    WHEN starts_with(href, '#') THEN url
    WHEN starts_with(href, '?') THEN 'x://' || regexp_extract(url, '^.*?://([^/?#]*[^?#]*)', 1, 's') || href
    ELSE 'x://' || regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') || coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*([^?#]*/)', 1, 's'), ''), '/') || href END AS target
  FROM h WHERE href <> ''),
k AS (
  SELECT x, translate(regexp_extract(x, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(x, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(x, '^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1, 's') AS query
  FROM (SELECT url AS x FROM pages WHERE url IS NOT NULL UNION SELECT target FROM t)),
n AS (SELECT x, host || path || query AS node, host, path FROM k WHERE host <> ''),
e AS (SELECT DISTINCT a.node AS u, b.node AS v FROM t JOIN n a ON a.x = t.url JOIN n b ON b.x = t.target),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT reach.u, s.v FROM reach JOIN (SELECT u, v FROM e UNION SELECT v, u FROM e) s ON reach.v = s.u),
own AS (
  SELECT DISTINCT node, first_value(rv) OVER (PARTITION BY x ORDER BY length(rh || rp) DESC, rv, rh) AS v
  FROM n JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
blocked AS (
  SELECT reach.u AS node FROM reach JOIN own ON own.node = reach.v GROUP BY 1
  HAVING bool_or(own.v = 'block') AND NOT bool_or(own.v = 'allow')),
p AS (
  SELECT row_number() OVER () AS i, page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, coalesce(regexp_extract(url, '^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1, 's'), '') AS query
  FROM pages),
m AS (
  SELECT i, any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path, any_value(query) AS query,
    first(rh || rp ORDER BY length(rh || rp) DESC, rv, rh) AS rule, first(rv ORDER BY length(rh || rp) DESC, rv, rh) AS rv
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule,
  coalesce(rv, CASE WHEN host <> '' AND host || path || query IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM m
"""
