"""URL filters with redirect equivalence, in DataFrame expressions only.

A rule names a host (with all its subdomains) and a path prefix; the longest fitting
rule decides. A page that no rule fits takes its equivalence class's decision: pages
and link targets are nodes (the whole URL without scheme and fragment, so that pages told
apart by their query stay apart), canonical links and refresh redirects are edges, and a
block reaches every alias in the component unless some member is allowed explicitly.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no
rule and is allowed; a null html has no links; relative targets are resolved against
the page's host and directory, dot segments taken out; targets of schemes without ``//``
name no page; every link of a page counts; repeated pages get equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

#: Targets of canonical links and of refresh redirects, either attribute first.
CANONICAL = r"""(?i)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
CANONICAL_LATE = r"""(?i)<link\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)[^>]*?\brel\s*=\s*["']?canonical\b"""
REFRESH = r"""(?i)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*?\burl\s*=\s*["']?([^"'\s>;]+)"""

REFRESH_LATE = r"""(?i)<meta\b[^>]*?\burl\s*=\s*["']?([^"'\s>;]+)[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"\A[^?#]*(\?[^#]*)?", 1)


def node_of(url: Column) -> Column:
    """Host, path and query."""
    return F.concat(host_of(url), path_of(url), query_of(url))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def decide(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        hit = fits(rule, host, path)
        name, verdict = F.when(hit, rule.name).otherwise(name), F.when(hit, rule.verdict).otherwise(verdict)
    return name, verdict


def without_dots(path: Column) -> Column:
    """A path (from its first slash) with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/", -1)
    above = lambda held: F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))  # noqa: E731  (the first is before the root)
    step = lambda held, x: F.when(x == "..", above(held)).when(x == ".", held).otherwise(F.concat(held, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(closed, "/")).otherwise(path)


def alias_edges(pages: DataFrame) -> DataFrame:
    """``a`` (the page's node) and ``b`` (a target's node), from ``url`` and ``html``."""
    linked = pages.filter(F.rlike("html", F.lit("(?i)canonical|refresh")))
    targets = F.concat(*(F.regexp_extract_all("html", F.lit(p), 1) for p in (CANONICAL, CANONICAL_LATE, REFRESH, REFRESH_LATE)))
    found = linked.select("url", F.explode(F.array_distinct(targets)).alias("target"))
    found = found.select("url", F.replace("target", F.lit("&amp;"), F.lit("&")).alias("target"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own, given = F.concat(F.lit("http://"), "host"), F.regexp_extract("target", r"\A[^?#]*", 0)
    asked = F.regexp_extract("target", r"\A[^?#]*(\?[^#]*)?", 1)
    folder = F.when(F.col("path") == "", "/").otherwise(F.regexp_extract("path", r"\A(.*/)", 1))
    whole = (
        F.when(F.rlike("target", F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*://")), F.col("target"))
        .when(F.rlike("target", F.lit(r"\A[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(F.startswith("target", F.lit("//")), F.concat(F.lit("http:"), "target"))
        .when(F.startswith("target", F.lit("/")), F.concat(own, without_dots(given), asked))
        .when(given == "", F.concat(own, F.col("path"), F.when(asked == "", query_of(F.col("url"))).otherwise(asked)))
        .otherwise(F.concat(own, without_dots(F.concat(folder, given)), asked))
    )
    found = found.filter("target <> ''").select(node_of(F.col("url")).alias("a"), whole.alias("to")).filter("`to` is not null and a <> ''")
    return found.select("a", node_of(F.col("to")).alias("b")).filter("b <> '' and a <> b")


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``by`` (rule, alias or default)."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))
    name, verdict = decide(rules, F.col("host"), F.col("path"))
    judged = parsed.select("*", name.alias("rule"), verdict.alias("own"))
    edges = stored(alias_edges(pages), "aliases")
    if edges.isEmpty():
        judged = judged.withColumn("of", F.lit(None).cast("string"))
    else:
        nodes = components(edges)
        # no host holds a slash or a question mark
        host, path = F.regexp_extract("node", r"\A[^/?]*", 0), F.regexp_extract("node", r"\A[^/?]*([^?]*)", 1)
        known = nodes.select("*", decide(rules, host, path)[1].alias("own"))
        by = known.groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
        decided = by.select("component", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("of"))
        of = stored(nodes.join(decided, "component").select("node", "of"), "classes")
        judged = judged.withColumn("node", F.concat("host", "path", "query")).join(of, "node", "left").drop("node")
    how = F.when(F.col("own").isNotNull(), "rule").when(F.col("of").isNotNull(), "alias").otherwise("default")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "of", F.lit("allow")).alias("verdict"), how.alias("by"))


#: The same in DuckDB, where a block or an allow spreads along the edges.
ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, regexp_replace(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '#.*$', '', 's') AS rest FROM pages
), q AS (
  SELECT page_id, html, HOST_OF AS host, PATH_OF AS path, QUERY_OF AS query FROM u
), t AS (
  SELECT host, path, query, replace(unnest(
      regexp_extract_all(html, '<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i')
   || regexp_extract_all(html, '<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*?\brel\s*=\s*["'']?canonical\b', 1, 'i')
   || regexp_extract_all(html, '<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*?\burl\s*=\s*["'']?([^"''\s>;]+)', 1, 'i')
   || regexp_extract_all(html, '<meta\b[^>]*?\burl\s*=\s*["'']?([^"''\s>;]+)[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b', 1, 'i')), '&amp;', '&') AS target FROM q
), w AS (
  -- a target's authority, path and query, by the kind of reference
  SELECT host || path || query AS a, host, path, query, regexp_replace(target, '#.*$', '', 's') AS target FROM t WHERE host || path || query <> '' AND target <> ''
), x AS (
  SELECT a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(target, strpos(target, '://') + 3)
                 WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                 WHEN starts_with(target, '//') THEN substr(target, 3) END AS whole,
         CASE WHEN starts_with(target, '/') THEN split_part(target, '?', 1)
              WHEN target = '' OR starts_with(target, '?') THEN NULL
              ELSE CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1, 's') END || split_part(target, '?', 1) END AS joined,
         host, path, query, CASE WHEN contains(target, '?') THEN substr(target, strpos(target, '?')) ELSE '' END AS asked,
         regexp_matches(target, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') AS absolute
  FROM w
), y AS (
  SELECT a, CASE WHEN absolute THEN whole
                 WHEN joined IS NULL THEN host || path || CASE WHEN asked = '' THEN query ELSE asked END
                 ELSE host || asked_path || asked END AS rest
  FROM (SELECT *, CASE WHEN NOT contains(joined, '/.') THEN joined
                       ELSE list_reduce(list_prepend('', string_split(substr(joined, 2), '/')),
                                        lambda held, s: CASE WHEN s = '..' THEN regexp_replace(held, '/[^/]*$', '') WHEN s = '.' THEN held ELSE held || '/' || s END)
                            || CASE WHEN regexp_matches(joined, '/[.][.]?$') THEN '/' ELSE '' END END AS asked_path FROM x)
), e1 AS (
  SELECT a, HOST_OF || PATH_OF || QUERY_OF AS b FROM y WHERE rest IS NOT NULL
), e AS (
  SELECT a, b FROM e1 WHERE a <> b AND b <> '' UNION SELECT b, a FROM e1 WHERE a <> b AND b <> ''
), n AS (
  SELECT node, HOST_OF AS host, PATH_OF AS path FROM (SELECT DISTINCT a AS node, a AS rest FROM e)
), r AS (
  SELECT *, RULE_OF AS rule FROM n
), blocked(node) AS (
  SELECT node FROM r WHERE rule IN ('net/', 'example.com/de/') UNION SELECT e.b FROM blocked JOIN e ON e.a = blocked.node
), allowed(node) AS (
  SELECT node FROM r WHERE rule IN ('example.net/en/', 'org/fr/') UNION SELECT e.b FROM allowed JOIN e ON e.a = allowed.node
), j AS (
  SELECT page_id, host, path, RULE_OF AS rule,
         host || path || query IN (SELECT node FROM blocked) AS b, host || path || query IN (SELECT node FROM allowed) AS a FROM q
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN a THEN 'allow' WHEN b THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN a OR b THEN 'alias' ELSE 'default' END AS by
FROM j
"""
for _name, _text in {
    "HOST_OF": "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "PATH_OF": "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)",
    "QUERY_OF": "regexp_extract(rest, '^[^?#]*([?][^#]*)', 1)",
    "RULE_OF": """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END""",
}.items():
    ORACLE = ORACLE.replace(_name, _text)
