"""URL filters: rules by host and path, and decisions that aliases share.

A url's host and path are matched with the rules; the longest fitting rule decides. Redirects (a refresh in the page)
and canonical links make two urls aliases of each other. Over the connected components of these edges, a url without a
rule of its own takes the decision of its aliases: an explicit allow anywhere in the component comes before a block.
Without either, a url is allowed.

Urls are told apart without scheme, fragment and closing slash. Defined cases: a null url, or one without '://', has an
empty host and path, fits no rule, has no aliases and is allowed. Null html has no links. Every canonical link and refresh of a page counts.
Relative links are resolved against the page's url as RFC 3986 has it ('//host', '/path', '?query', 'page', '../page', with dot segments
removed; a base element isn't minded); links of other schemes, such as mailto, name no page. Repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, checkpointed, connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("block", "example.com/de/"), UrlRule("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def rest(url: Column) -> Column:
    """What follows the first '://'; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def identity(url: Column) -> Column:
    """A url without scheme, fragment and closing slash, its host in lower case; null without '://'."""
    tail = F.regexp_replace(F.regexp_extract(rest(url), r"^[^/?#]*([^#]*)", 1), r"/$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), tail))


def without_dots(path_: Column) -> Column:
    """A path that begins with '/', without its '.' and '..' segments."""
    segments = F.split(F.substring(path_, F.lit(2), F.length(path_)), "/")
    step = lambda so_far, s: F.when(s == ".", so_far).when(s == "..", F.regexp_replace(so_far, "/[^/]*$", "")).otherwise(F.concat(so_far, F.lit("/"), s))
    return F.aggregate(segments, F.lit(""), step)


def absolute(link: Column, base: Column) -> Column:
    """The url that a link on the page `base` names; null if it is of a scheme without '//'."""
    scheme = F.substring_index(base, "://", 1)
    own_path = F.regexp_extract(base, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(rest(base), r"^([^/?#]*)", 1))
    folder = F.coalesce(F.nullif(F.regexp_replace(own_path, "[^/]*$", ""), F.lit("")), F.lit("/"))
    whole = F.when(link.startswith("/"), link).otherwise(F.concat(folder, link))
    resolved = F.concat(site, without_dots(F.regexp_extract(whole, r"^([^?#]*)", 1)), F.regexp_extract(whole, r"^[^?#]*(.*)$", 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(site, own_path, link))
        .when(link.startswith("#"), base)
        .otherwise(resolved)
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b, a_url, b_url): hashed identities of each page and what it redirects to or names as canonical."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    links = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1)))
    found = pages.where(url.isNotNull() & (F.instr(url, "://") > 0) & html.rlike("(?i)canonical|refresh"))
    found = found.select(url.alias("a_url"), F.explode(F.filter(links, lambda x: x != "")).alias("link"))
    found = found.select("a_url", absolute(F.replace("link", F.lit("&amp;"), F.lit("&")), F.col("a_url")).alias("b_url")).where("b_url is not null")
    return found.select(F.xxhash64(identity(F.col("a_url"))).alias("a"), F.xxhash64(identity(F.col("b_url"))).alias("b"), "a_url", "b_url").where("a != b")


def inherited(edges: DataFrame, scratch: Scratch, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """(node, verdict) for each hashed identity in a component in which some url has a rule; an allow comes first."""
    parts = connected_components(edges, scratch)
    ends = edges.select(F.col("a").alias("node"), F.col("a_url").alias("url")).unionByName(edges.select(F.col("b").alias("node"), F.col("b_url").alias("url")))
    own = ends.select("node", verdict_of(rule_of(host(F.col("url")), path(F.col("url")), rules), rules).alias("own")).where("own is not null").distinct()
    told = parts.join(own, "node").groupBy("component").agg(F.min("own").alias("shared"))  # 'allow' < 'block'
    return parts.join(told, "component").select("node", "shared")


def judge_pages(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and via (rule, alias or default) for each row of pages."""
    scratch = Scratch(pages.sparkSession)
    edges = scratch.keep(link_edges(pages))
    h, p = host(F.col("url")), path(F.col("url"))
    out = pages.select("page_id", h.alias("host"), p.alias("path"), F.xxhash64(identity(F.col("url"))).alias("node"))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    own = verdict_of(F.col("rule"), rules)
    if edges.isEmpty():
        shared = F.lit(None).cast("string")
    else:
        told, _ = bounded(checkpointed(inherited(edges, scratch, rules)))
        out = out.join(told, "node", "left")
        shared = F.col("shared")
    scratch.close()
    via = F.when(F.col("rule").isNotNull(), "rule").when(shared.isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce(own, shared, F.lit("allow")).alias("verdict"), via.alias("via"))


#: The same result in SQL. Components by recursion over the same edges.
ORACLE_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, html,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  split_part(url, '://', 1) AS scheme, regexp_extract(rest, '^([^/?#]*)', 1) AS site, coalesce(nullif(regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') AS folder,
  CASE WHEN rest IS NOT NULL THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '/$', '') END AS node FROM p),
links AS (
  SELECT node, scheme, site, folder, host, path, replace(unnest(list_concat(list_concat(
    regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract_all(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1)),
    regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1))), '&amp;', '&') AS link
  FROM q WHERE node IS NOT NULL),
wholes AS (SELECT *, CASE WHEN starts_with(link, '/') THEN link ELSE folder || link END AS whole FROM links WHERE link <> ''),
targets AS (
  SELECT node AS a, host AS a_host, path AS a_path, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '?') THEN scheme || '://' || site || path || link WHEN starts_with(link, '#') THEN NULL
    ELSE scheme || '://' || site || list_reduce(string_split(substr(regexp_extract(whole, '^([^?#]*)', 1), 2), '/'),
      lambda so_far, s: CASE WHEN s = '.' THEN so_far WHEN s = '..' THEN regexp_replace(so_far, '/[^/]*$', '') ELSE so_far || '/' || s END, '') || regexp_extract(whole, '^[^?#]*(.*)$', 1) END AS b_url FROM wholes),
ends AS (
  SELECT a, a_host, a_path, substr(b_url, instr(b_url, '://') + 3) AS rest FROM targets WHERE b_url IS NOT NULL),
edges AS (
  SELECT a, a_host, a_path, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS b_path,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '/$', '') AS b FROM ends),
urls AS (SELECT a AS node, a_host AS host, a_path AS path FROM edges WHERE a <> b UNION SELECT b, b_host, b_path FROM edges WHERE a <> b),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
parts AS (SELECT DISTINCT r.node, u.host, u.path FROM reach r JOIN urls u ON u.node = r.other),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
shared AS (
  SELECT node, min(verdict) AS shared FROM (
    SELECT x.node, x.host, x.path, arg_max(r.verdict, length(r.rule)) AS verdict FROM parts x
    JOIN rules r ON (x.host = r.rhost OR ends_with(x.host, '.' || r.rhost)) AND starts_with(x.path, r.rpath) GROUP BY ALL) t GROUP BY node),
own AS (
  SELECT q.host, q.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM q) q
  JOIN rules r ON (q.host = r.rhost OR ends_with(q.host, '.' || r.rhost)) AND starts_with(q.path, r.rpath) GROUP BY ALL)
SELECT q.page_id, q.host, q.path, o.rule, coalesce(o.verdict, s.shared, 'allow') AS verdict,
  CASE WHEN o.rule IS NOT NULL THEN 'rule' WHEN s.shared IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM q LEFT JOIN own o ON o.host = q.host AND o.path = q.path LEFT JOIN shared s ON s.node = q.node
"""
