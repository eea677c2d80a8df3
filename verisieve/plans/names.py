"""Queries over names, addresses, short forms and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import messages, scoring
from .registry import query


@query(
    """SELECT event_id, CASE WHEN t >= 1000000 THEN printf('%.2fM', t / 1000000.0::DOUBLE) WHEN t >= 1000 THEN printf('%.1fK', t / 1000.0::DOUBLE) ELSE t::VARCHAR END AS tokens, CASE WHEN latency_ms >= 1000 THEN printf('%d.%02ds', (latency_ms + 5) // 1000, ((latency_ms + 5) // 10) % 100) ELSE latency_ms || 'ms' END AS latency,
    greatest(least(round(risk * 10), 10), 0)::INT || '/10' AS risk, round(tokens * 100.0 / 128)::BIGINT AS share FROM (SELECT *, tokens * 4096 AS t FROM scan_log)"""
)
def formatted_fields(v):
    return v.scan_log.select("event_id", naming.tokens_text(F.col("tokens") * 4096).alias("tokens"), naming.latency_text(F.col("latency_ms")).alias("latency"), naming.tenths(F.col("risk")).alias("risk"), naming.percent(F.col("tokens"), F.lit(128)).alias("share"))


@query("SELECT page_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def url_slugs(v):
    return v.pages.select("page_id", naming.url_slug(F.col("url")).alias("slug"))


_LANGUAGE = "CASE p_partkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' WHEN 3 THEN 'java' WHEN 4 THEN 'csharp' WHEN 5 THEN 'go' ELSE 'cpp' END"
_PACKAGE = "CASE p_partkey % 7 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'yaml.loader' ELSE concat(split_part(p_name, ' ', 1), '.x') END WHEN 1 THEN concat('@', replace(p_name, ' ', '/')) WHEN 2 THEN concat(split_part(p_name, ' ', 1), '::y') WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', ':') ELSE p_brand END ELSE concat('Git/', p_brand) END"


@query(
    f"""SELECT id, CASE l WHEN 'python' THEN 'https://pypi.org/pypi/' || CASE WHEN split_part(n, '.', 1) = 'yaml' THEN 'PyYAML' ELSE split_part(n, '.', 1) END || '/json' WHEN 'typescript' THEN 'https://registry.npmjs.org/' || replace(n, '/', '%2F') WHEN 'rust' THEN 'https://crates.io/api/v1/crates/' || split_part(n, '::', 1)
    WHEN 'java' THEN 'https://search.maven.org/solrsearch/select?q=g:' || replace(n, ':', '%20AND%20a:') || '&rows=1&wt=json' WHEN 'csharp' THEN 'https://api.nuget.org/v3/registration5-semver1/' || lower(n) || '/index.json' WHEN 'go' THEN 'https://proxy.golang.org/' || lower(n) || '/@latest' END AS url
    FROM (SELECT p_partkey AS id, {_LANGUAGE} AS l, {_PACKAGE} AS n FROM part)"""
)
def registry_urls(v):
    rows = v.part.select(F.col("p_partkey").alias("id"), F.expr(_LANGUAGE).alias("l"), F.expr(_PACKAGE).alias("n"))
    return rows.select("id", naming.registry_url(F.col("l"), F.col("n")).alias("url"))


@query(
    """SELECT seq, CASE seq % 4 WHEN 0 THEN name || ': void' WHEN 1 THEN 'class ' || name WHEN 2 THEN 'signal ' || name ELSE name || '(a: int, b: str = ' || version || ') -> ' || library END AS signature FROM symbols"""
)
def synthetic_signatures(v):
    kind = F.expr("CASE seq % 4 WHEN 0 THEN 'property' WHEN 1 THEN 'class' WHEN 2 THEN 'signal' ELSE 'method' END")
    p = lambda n, t, d: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type_name"), d.alias("default_value"))
    params = F.array(p("a", "int", F.lit(None).cast("string")), p("b", "str", F.col("version")))
    return v.symbols.select("seq", naming.signature(kind, F.col("name"), params, F.when(F.col("seq") % 4 == 3, F.col("library"))).alias("signature"))


_CALL = "concat('f(', CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN name WHEN 2 THEN concat('[', name, ', 2], g(a, b)') WHEN 3 THEN '\"x, y\", z' ELSE concat(repeat('q, ', CAST(version AS INT) % 7), 'Map<a, b>') END, ') -> r')"


@query("SELECT seq, (CASE seq % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE version::INT % 7 + 1 END)::INT AS arity FROM symbols")
def call_arity(v):
    return v.symbols.select("seq", naming.signature_arity(F.expr(_CALL)).alias("arity"))


@query("SELECT DISTINCT response_id, path FROM (SELECT l_orderkey AS response_id, CASE l_linenumber % 3 WHEN 0 THEN concat('src/f', l_partkey % 9, '.py') WHEN 1 THEN concat('lib/g', l_partkey % 9, '.rs') END AS path FROM lineitem WHERE l_suppkey % 2 = 0) WHERE path IS NOT NULL")
def edited_files(v):
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(F.when(F.col("l_suppkey") % 2 == 0, "write_file").otherwise("read").alias("name"), F.concat(F.lit('{"path":"src/f'), F.col("l_partkey") % 9, F.lit('.py"}')).alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    anthropic = F.to_json(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.when(F.col("l_suppkey") % 2 == 0, "Edit").otherwise("Bash").alias("name"), F.struct(F.concat(F.lit("lib/g"), F.col("l_partkey") % 9, F.when(F.col("l_linenumber") % 3 == 1, ".rs").otherwise(".md")).alias("file_path")).alias("input"))).alias("content")))
    rows = v.lineitem.select(F.col("l_orderkey").alias("response_id"), F.when(F.col("l_linenumber") % 3 == 0, openai).otherwise(anthropic).alias("body"))
    return messages.edited_files(rows, "body", "response_id")


@query(
    """SELECT item_id, CASE item_id % 3 WHEN 2 THEN 'uncertain' WHEN 0 THEN 'verified' ELSE 'hallucinated' END AS verdict, item_id % 3 <> 2 AND item_id % 2 = 0 AS quoted FROM benchmark"""
)
def judge_answers(v):
    said = F.when(F.col("item_id") % 3 == 0, "verified").otherwise("hallucinated")
    quote = F.when(F.col("item_id") % 2 == 0, F.substring("text", 1, 10)).otherwise(F.lit("absent words"))
    body = F.to_json(F.struct(said.alias("verdict"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason"), quote.alias("quote")))
    answer = F.when(F.col("item_id") % 3 == 2, F.lit("no object here")).otherwise(F.concat(F.lit("```json\n<reasoning>{x}</reasoning> so "), body, F.lit("\n```")))
    parsed = v.benchmark.withColumn("p", scoring.parsed_verdict(answer))
    verdict, _ = scoring.finalized(F.coalesce("p.verdict", F.lit("")), F.col("p.confidence"), F.coalesce("p.reason", F.lit("")))
    return parsed.select("item_id", verdict.alias("verdict"), F.coalesce(scoring.quote_found(F.col("p.quote"), F.col("text")), F.lit(False)).alias("quoted"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'skipped-traffic' WHEN tokens < 3 THEN 'skipped-short' ELSE 'scanned' END AS status FROM scan_log) GROUP BY status")
def scan_gate(v):
    rows = v.scan_log.select(F.when(F.col("event_id") % 11 == 0, "compaction").otherwise("chat").alias("class"), "tokens")
    return rows.select(messages.gate(F.col("class"), F.col("tokens")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
