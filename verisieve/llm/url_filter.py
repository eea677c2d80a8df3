"""URL filter by redirect equivalence.

Rules give a host and a path prefix with a decision; the longest rule that fits
a url decides.  Urls that redirect to each other, or that name each other as
canonical, are aliases: distributed connected components over those edges carry
the rules' decisions to members that no rule fits.  An explicit allow takes
precedence: a page's own rule always stands, and a component with an explicitly
allowed member blocks none of its undecided aliases.

Everything is a native column expression or join.  Defined results: a null url,
or one without ``://``, has an empty host and path, fits no rule, and is
allowed; a null html has no edges; repeated rows are judged each; an empty
table gives an empty result; further columns, also ones named like the
results, do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds host, path and node, each with ``prefix``, of column ``url``.

    A node names a page in the graph: host, path and query, null without a host.
    """
    rest = f"{prefix}rest"
    at = F.instr(url, "://")
    df = df.withColumn(rest, F.when(at > 0, F.substring(F.col(url), at + F.lit(3), F.length(url))).otherwise(F.lit("")))
    df = df.withColumn(f"{prefix}host", F.coalesce(_ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")))
    df = df.withColumn(f"{prefix}path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))
    host = F.col(f"{prefix}host")
    return df.withColumn(f"{prefix}node", F.when(host != "", F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)))).drop(rest)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ranked]
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, f: F.when(f[0], f[1]).otherwise(rest), reversed(fits), none)


def resolved(target: Column) -> Column:
    """``target`` as found on the page of ``url``, ``host``, ``path``: absolute, ``//host``, ``/path`` or relative."""
    scheme = F.regexp_extract("url", r"^([^:/?#]*:)//", 1)
    folder = F.regexp_replace("path", r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(scheme, F.lit("//"), F.col("host"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(scheme, F.lit("//"), F.col("host"), F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from canonical links and meta refreshes in the pages' html.

    Filters stand on generated columns, so that they are not pushed below the
    expressions and evaluate them again.
    """
    marked = pages.select("url", "html").where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    live = marked.select("url", F.regexp_replace("html", r"(?s)<!--.*?-->", "").alias("html"))
    tags = live.select("url", F.explode(F.expr(r"regexp_extract_all(html, r'(?i)<(?:link|meta)[^>]*>', 0)")).alias("tag"))
    attr = r"""(?i)[\s"']{}\s*=\s*["']?([^"'\s>]*)"""
    target = F.when(
        F.col("tag").rlike(r"(?i)^<link") & (F.lower(F.regexp_extract("tag", attr.format("rel"), 1)) == "canonical"), F.regexp_extract("tag", attr.format("href"), 1)
    ).when(F.col("tag").rlike(r"(?i)^<meta") & (F.lower(F.regexp_extract("tag", attr.format("http-equiv"), 1)) == "refresh"), F.regexp_extract("tag", r"""(?i)url\s*=\s*["']?([^"'\s>;]+)""", 1))
    found = with_parts(tags.select("url", F.explode(F.array(target)).alias("target")).where("target is not null and target <> ''"), "url")
    found = with_parts(found.withColumn("full", resolved(F.col("target"))), "full", "to_")
    pairs = found.select(F.explode(F.array(F.struct(F.col("node").alias("a"), F.col("to_node").alias("b")))).alias("e")).select("e.*")
    return pairs.where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judges each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    ``redirects`` (source_url, target_url) adds edges from a crawl's log.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(with_parts(with_parts(redirects, "source_url", "a_"), "target_url", "b_").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).where("a is not null and b is not null"))
    edges, _ = materialize(edges, "aliases")
    judged = with_parts(pages.select("page_id", "url"), "url").withColumn("_own", rule_for(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        inherited = F.lit(None).cast("string")
    else:
        members = connected_components(edges).withColumn("url", F.concat(F.lit("x://"), F.col("node")))
        members = with_parts(members.withColumnRenamed("node", "member"), "url").withColumn("own", rule_for(F.col("host"), F.col("path"), rules)["verdict"])
        decided = members.groupBy("component").agg(F.max(F.when(F.col("own") == "allow", 1)).alias("allow"), F.max(F.when(F.col("own") == "block", 1)).alias("block")).where("block = 1 and allow is null")
        blocked = members.join(decided, "component", "left_semi").where("own is null").select(F.col("member").alias("node"), F.lit("block").alias("_inherited"))
        judged = judged.join(blocked, "node", "left")
        inherited = F.col("_inherited")
    return judged.select("page_id", "host", "path", F.col("_own.rule").alias("rule"), F.coalesce(F.col("_own.verdict"), inherited, F.lit("allow")).alias("verdict"))


def _sql_url(u: str) -> tuple[str, str, str]:
    rest = f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    node = f"nullif({host}, '') || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"
    return host, path, node


def oracle(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """The same in DuckDB SQL, the components by a recursive closure of the few alias edges."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    host, path, node = _sql_url("url")
    t_host, _, t_node = _sql_url("full_target")
    attr = r"""(?i)[\s"'']{}\s*=\s*["'']?([^"''\s>]*)"""
    scheme = "regexp_extract(url, '^([^:/?#]*:)//', 1)"
    origin = f"{scheme} || '//' || {host}"
    folder = f"regexp_replace({path}, '[^/]*$', '')"
    return f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {values}),
base AS (SELECT row_number() OVER () AS rid, page_id, {host} AS host, {path} AS path, {node} AS node FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:link|meta)[^>]*>')) AS tag
         FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
targets AS (SELECT url, CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND lower(regexp_extract(tag, '{attr.format("rel")}', 1)) = 'canonical' THEN regexp_extract(tag, '{attr.format("href")}', 1)
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower(regexp_extract(tag, '{attr.format("http-equiv")}', 1)) = 'refresh' THEN regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''\\s>;]+)', 1) END AS target FROM tags),
full_targets AS (SELECT url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN {scheme} || target
    WHEN starts_with(target, '/') THEN {origin} || target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || target END AS full_target
    FROM targets WHERE target <> ''),
edges AS (SELECT DISTINCT {node} AS a, {t_node} AS b FROM full_targets),
both_ways AS (SELECT a, b FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
node_hosts AS (SELECT DISTINCT b AS node, 'x://' || b AS url FROM reach),
nodes AS (SELECT node, {host} AS host, {path} AS path FROM node_hosts),
node_rules AS (SELECT node, arg_max(verdict, length(h || p)) AS verdict FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
inherited AS (SELECT r.a AS node FROM reach r JOIN node_rules n ON n.node = r.b GROUP BY r.a HAVING bool_or(n.verdict = 'block') AND NOT bool_or(n.verdict = 'allow')),
own AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
        FROM base JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(own.verdict, CASE WHEN node IN (SELECT node FROM inherited) THEN 'block' END, 'allow') AS verdict
FROM base LEFT JOIN own USING (rid)"""
