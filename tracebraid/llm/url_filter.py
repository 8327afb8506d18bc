"""URL filters with redirect equivalence.

A page's own rule decides: the longest of the rules whose host is the page's
host or a parent of it and whose path begins the page's path.  Pages without a
rule take the decision of their aliases: redirects and canonical links are
edges between addresses (host, path and query, without scheme and fragment),
and a component of these with an explicitly blocked address is blocked, unless
it has an explicitly allowed one, which takes precedence.  Otherwise the page is
allowed.

Cases: a null url and one without ``://`` has empty host and path, no rule and no
aliases; null html has no links; targets without a page count as addresses of
their own, with the rule they would have; only a scheme at the start makes a target
absolute, others are resolved against the page's first ``<base>``, if that has an
address, or its own, dot segments removed, as ``urljoin`` does; ``mailto:``, ``data:``
and the like have no address; links to the page itself add nothing; comments, an open
one up to the end, hold no links; a ``>`` in a quoted value ends no tag, a quote in a tag
opens a value wherever it stands;
repeated rows get equal verdicts; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .store import bounded_broadcast, written

#: (verdict, host, path); a list of this kind is part of the plan, for up to a few hundred rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COMMENT = "(?s)<!--.*?(?:-->|\\z)"
#: Links, redirects and bases, found in one search; the SQL's has no possessive repeats, which change no match here.
TAGS = "(?i)<(?:link|meta|base)\\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: What stands before an attribute's name.
AT = "[\\s\"'/]"
CANONICAL = f"(?i){AT}rel\\s*=\\s*(?:\"(?:[^\">]*\\s)?canonical(?:\\s[^\">]*)?\"|'(?:[^'>]*\\s)?canonical(?:\\s[^'>]*)?'|canonical[\\s/>])"
HREF = f"(?i){AT}href\\s*=\\s*[\"']?([^\"'\\s>]+)"
REFRESH = f"(?i){AT}http-equiv\\s*=\\s*[\"']?refresh\\b"
TARGET = f"(?i){AT}content\\s*=\\s*[\"'][^\"'>]*\\burl\\s*=\\s*[\"']?([^\"'>\\s]+)"
#: The escapes that addresses need; the ampersand's own comes last.
ESCAPES = (("(?i)&(?:#0*38|#x0*26);", "&amp;"), ("(?i)&(?:#0*47|#x0*2f|sol);", "/"), ("(?i)&(?:#0*58|#x0*3a|colon);", ":"), ("(?i)&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query; null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in longest_first(rules)
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def longest_first(rules) -> list[tuple[str, str, str]]:
    """Of rules of one length those that allow come first."""
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r))


def resolved(target: Column, url: Column) -> Column:
    """The url that a link's target means on the page ``url``; the same as urllib's ``urljoin`` on http and https."""
    # A url: scheme, authority, path, query; without a host no target can be resolved.
    part = lambda pattern, x: F.regexp_extract(x, pattern, 1)
    base = part("^([^#]*)", url)
    scheme, host, path = part("^([A-Za-z][A-Za-z0-9+.-]*:)//", base), part("^[^:/?#]*://([^/?#]*)", base), part("^[^:/?#]*://[^/?#]*([^?]*)", base)
    target = part("^([^#]*)", target)
    own, query = part("^([^?]*)", target), part("^[^?]*(\\?.*)$", target)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.coalesce(F.nullif(part("^(.*/)[^/]*$", path), F.lit("")), F.lit("/")), own))
    merged = F.concat(scheme, F.lit("//"), host, without_dots(joined), query)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target == "", base)
        .when(own == "", F.concat(scheme, F.lit("//"), host, path, query))
        .otherwise(merged)
    )


def without_dots(path: Column) -> Column:
    """A path with its segments ``.`` and ``..`` carried out."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    # The first segment is the empty one before the first slash; it stays.
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    ends = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    clean = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), ends), "^//$", "/")
    return F.when(path.rlike("(^|/)\\.\\.?(/|$)"), clean).otherwise(path)


def unescaped(target: Column) -> Column:
    for escape, char in ESCAPES:
        target = F.regexp_replace(target, escape, char)
    return target


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (source, target) between addresses, from canonical links and refresh redirects in the html."""
    html = F.col("html")
    shown = F.when(html.contains("<!--"), F.regexp_replace(html, COMMENT, "")).otherwise(html)
    tags = pages.filter(html.rlike("(?i)canonical|http-equiv")).select("url", F.regexp_extract_all(shown, F.lit(TAGS), F.lit(0)).alias("tags"))
    base = F.regexp_extract(F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base")), F.lit(0)), HREF, 1)
    tags = tags.filter("size(tags) > 0").select("url", "tags", unescaped(base).alias("base"))
    # Generators stand between the steps, so that no expression is carried into another, or into a filter, more than once.
    against = F.when(F.col("base") != "", F.coalesce(resolved(F.col("base"), F.col("url")), F.col("url"))).otherwise(F.col("url"))
    tag = tags.select("url", against.alias("base"), F.explode("tags").alias("tag"))
    target = F.when(F.col("tag").rlike("(?i)^<base"), F.lit(None)).when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", HREF, 1)).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    tag = tag.select("url", "base", F.explode(F.array(unescaped(target))).alias("target")).filter("target <> ''").distinct()
    edge = F.struct(address_of(F.col("url")).alias("source"), address_of(resolved(F.col("target"), F.col("base"))).alias("target"))
    edges = tag.select(F.inline(F.array(edge)))
    return edges.dropna().filter("source <> target")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component; ``redirects`` (source and target urls) add to the pages' own links."""
    edges = link_edges(pages)
    if redirects is not None:
        source, target = redirects.columns[:2]
        more = redirects.select(address_of(F.col(f"`{source}`")).alias("source"), address_of(F.col(f"`{target}`")).alias("target"))
        edges = edges.unionByName(more.dropna().filter("source <> target"))
    parts = connected_components(edges.distinct())
    # An address reads like an url behind "://".
    url = F.concat(F.lit("://"), F.col("node"))
    ruled = parts.withColumn("own", rule_of(host_of(url), path_of(url), rules))
    decided = ruled.groupBy("component").agg(
        F.max(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allowed"),
        F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"),
    )
    parts = written(parts.join(decided.filter("blocked AND NOT allowed"), "component").select("node", "component"), "blocked-aliases")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("address"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    joined = own.join(bounded_broadcast(parts), F.col("address") == F.col("node"), "left")
    inherited = F.when(F.col("component").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", inherited).alias("verdict"), F.col("component").alias("blocked_component"))


def op8_url_filter(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql_rule(host: str, path: str) -> str:
    fits = ", ".join(
        f"CASE WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}} END"
        for v, h, p in longest_first(RULES)
    )
    return f"coalesce({fits})"


_TR = f"'{UPPER}', '{LOWER}'"
def _quoted(pattern: str) -> str:
    """A pattern as a SQL string, its possessive repeats as plain ones."""
    return "'" + pattern.replace("++", "+").replace("*+", "*").replace("'", "''") + "'"


def _unescaped(x: str) -> str:
    for escape, char in ESCAPES:
        x = f"regexp_replace({x}, '{escape}', '{char}', 'g')"
    return x


def _resolved(target: str, url: str) -> str:
    """``resolved`` in SQL."""
    part = lambda pattern, x: f"regexp_extract({x}, '{pattern}', 1)"
    base, t = part("^([^#]*)", url), part("^([^#]*)", target)
    scheme, host, path = (part(x, base) for x in ("^([A-Za-z][A-Za-z0-9+.-]*:)//", "^[^:/?#]*://([^/?#]*)", "^[^:/?#]*://[^/?#]*([^?]*)"))
    own, query = part("^([^?]*)", t), part("^[^?]*([?].*)$", t)
    joined = f"CASE WHEN starts_with({own}, '/') THEN {own} ELSE coalesce(nullif({part('^(.*/)[^/]*$', path)}, ''), '/') || {own} END"
    kept = f"""list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({joined}, '/')[2:], lambda x: [x])),
      lambda done, x: CASE WHEN x[1] = '..' THEN done[1:greatest(len(done) - 1, 0)] WHEN x[1] = '.' THEN done ELSE list_concat(done, x) END)"""
    ends = f"CASE WHEN regexp_matches({joined}, '(^|/)[.][.]?$') THEN '/' ELSE '' END"
    clean = f"""CASE WHEN regexp_matches({joined}, '(^|/)[.][.]?(/|$)') THEN regexp_replace('/' || array_to_string({kept}, '/') || {ends}, '^//$', '/') ELSE {joined} END"""
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t} WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN starts_with({t}, '//') THEN {scheme} || {t} WHEN {t} = '' THEN {base} WHEN {own} = '' THEN {scheme} || '//' || {host} || {path} || {query}
      ELSE {scheme} || '//' || {host} || {clean} || {query} END"""


ORACLE = rf"""
WITH RECURSIVE own AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_TR}), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS tail FROM pages),
addressed AS (SELECT *, CASE WHEN host <> '' THEN host || tail END AS address, {_sql_rule('host', 'path')} AS own_rule FROM own),
tagged AS (
  SELECT url, address, regexp_extract_all(CASE WHEN contains(html, '<!--') THEN regexp_replace(html, {_quoted(COMMENT)}, '', 'g') ELSE html END, {_quoted(TAGS)}) AS tags
  FROM addressed WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
named AS (
  SELECT *, {_unescaped(f"regexp_extract(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base'))[1], {_quoted(HREF)}, 1)")} AS base FROM tagged),
based AS (SELECT address, url, tags, CASE WHEN base <> '' THEN coalesce({_resolved('base', 'url')}, url) ELSE url END AS base FROM named),
spread AS (SELECT address, base, unnest(tags) AS tag FROM based),
targets AS (
  SELECT address, base, CASE WHEN regexp_matches(tag, '(?i)^<base') THEN NULL
    WHEN regexp_matches(tag, {_quoted(CANONICAL)}) THEN regexp_extract(tag, {_quoted(HREF)}, 1)
    WHEN regexp_matches(tag, {_quoted(REFRESH)}) THEN regexp_extract(tag, {_quoted(TARGET)}, 1) END AS t FROM spread),
meant AS (SELECT address, base, {_unescaped('t')} AS t FROM targets WHERE t <> ''),
whole AS (SELECT address AS a, {_resolved('t', 'base')} AS u FROM meant),
links AS (
  SELECT a, translate(regexp_extract(u, '://([^/?#]*)', 1), {_TR}) || regexp_extract(u, '://[^/?#]*([^#]*)', 1) AS b FROM whole
  WHERE a IS NOT NULL AND regexp_extract(u, '://([^/?#]*)', 1) <> ''),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
alias_rules AS (
  SELECT node, {_sql_rule("regexp_extract(other, '^([^/?#]*)', 1)", "regexp_extract(other, '^[^/?#]*([^?#]*)', 1)")} AS r FROM reach),
decided AS (
  SELECT node, coalesce(bool_or(r.verdict = 'block'), false) AND NOT coalesce(bool_or(r.verdict = 'allow'), false) AS blocked
  FROM alias_rules GROUP BY node)
SELECT page_id, host, path, own_rule.rule AS rule,
  coalesce(own_rule.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM addressed LEFT JOIN decided ON node = address
"""
