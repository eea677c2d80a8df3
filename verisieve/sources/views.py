"""Projections of the star-schema tables into the engine's tables.

Each is one SQL text that Spark and DuckDB both read, so a query and its
oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_CAP = "concat(upper(substr({0}, 1, 1)), substr({0}, 2))"
_CLASS = f"concat({_CAP.format("split_part(p_name, ' ', 2)")}, {_CAP.format('lower(p_type)')})"
_METHOD = "concat(split_part(p_name, ' ', 1), '_', CAST(p_partkey % 97 AS STRING))"

VIEWS: dict[str, str] = {
    "symbols": f"""SELECT p_partkey AS seq, p_brand AS library, CAST(p_size AS STRING) AS version, {_CLASS} AS class, {_METHOD} AS name,
        concat({_CLASS}, '.', {_METHOD}) AS path, 'method' AS kind, p_partkey % 4 AS arity FROM part""",
    "classes": "SELECT DISTINCT library, version, class AS name FROM symbols",
    "claims": f"""SELECT l_orderkey AS response_id, l_linenumber AS seq, l_partkey AS partkey, l_suppkey AS suppkey,
        CASE WHEN l_linenumber % 4 = 3 THEN concat({_CLASS}, 'X') ELSE {_CLASS} END AS class,
        CASE WHEN l_linenumber % 2 = 0 THEN {_METHOD} WHEN l_linenumber % 4 = 1 THEN concat({_METHOD}, 'x') ELSE concat('q', {_METHOD}) END AS method,
        l_quantity AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "scan_log": """SELECT event_id, event_id % 2500 AS request_id, CAST(ts AS TIMESTAMP) AS ts,
        CASE user_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'egress' ELSE 'deep' END AS phase,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'blocked' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'clean' ELSE 'skipped' END AS scan_result,
        round(least(value / 100.0, 1.0), 4) AS risk, CASE WHEN user_id % 2 = 0 THEN '' ELSE concat('m', CAST(user_id % 5 AS STRING)) END AS model,
        CAST(floor(value * 10) AS BIGINT) AS latency_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS tokens, user_id, event_type, value, props FROM events""",
    "predictions": """SELECT l.doc_id AS case_id, d.lang AS language, d.source AS claim_type, l.quality = 0 AS predicted, l.toxic = 1 AS truth,
        CAST(l.doc_id * 37 % 101 AS DOUBLE) / 100 AS confidence, l.doc_id % 2 = 0 AS flagged_a, l.doc_id % 3 = 0 AS flagged_b FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "findings": """SELECT l_orderkey AS response_id, l_linenumber AS seq, CASE l_suppkey % 12 WHEN 0 THEN concat('forge: hallucinated-method: `m', CAST(l_partkey % 50 AS STRING), '` not a method') WHEN 1 THEN concat('forge: hallucinated-import: `p', CAST(l_partkey % 50 AS STRING), '` not found') WHEN 2 THEN concat('forge: hallucinated-variable: `v', CAST(l_partkey % 50 AS STRING), '` undefined') WHEN 3 THEN concat('compiler: `c', CAST(l_partkey % 50 AS STRING), '` failed') WHEN 4 THEN concat('Unverified API: `u', CAST(l_partkey % 50 AS STRING), '`') WHEN 5 THEN concat('logic: `l', CAST(l_partkey % 50 AS STRING), '` contradicts itself') WHEN 6 THEN concat('logic (uncertain): `k', CAST(l_partkey % 50 AS STRING), '`') WHEN 7 THEN concat('scope-hallucination: `s', CAST(l_partkey % 50 AS STRING), '`') WHEN 8 THEN concat('cached-hallucination: `y', CAST(l_partkey % 50 AS STRING), '` does not exist') WHEN 9 THEN concat('compiler-detected: `c', CAST(l_partkey % 50 AS STRING), '`') WHEN 10 THEN concat('Hallucinated API: `i', CAST(l_partkey % 50 AS STRING), '`') ELSE concat('forge: chain-broken: `b', CAST(l_partkey % 50 AS STRING), '` returns nothing') END AS warning,
        l_returnflag = 'R' AND l_linenumber = 1 AS blocked, l_linestatus = 'F' AS scan_failed FROM lineitem""",
    "responses": f"""SELECT doc_id AS response_id, lang, concat(text, chr(10), '```python', chr(10), 'import ', split_part(p_name, ' ', 1), chr(10), split_part(p_name, ' ', 1), '_obj = ', {_CLASS}, '(', CAST(p_size AS STRING), ')', chr(10),
        split_part(p_name, ' ', 1), '_obj.', {_METHOD}, '([1, ', chr(123), '2: 3', chr(125), '], key=4)', chr(10), {_CLASS}, '.', {_METHOD}, '(', CAST(p_size AS STRING), ', missing_', split_part(p_name, ' ', 2), ')', chr(10), '```', chr(10),
        'The method ', {_METHOD}, ' always returns a new list. Call it with ', CAST(p_size AS STRING), ' items; it never raises an error', chr(10),
        '```rust', chr(10), 'fn ', split_part(p_name, ' ', 2), '_go(x: u32) -> u32 ', chr(123), chr(10), '    let total = x;', chr(10), '    total', chr(10), chr(125), chr(10), '```') AS content
        FROM documents JOIN part ON p_partkey = doc_id % 200""",
    "messages": "SELECT conv_id, turn, role, text FROM conversations",
    "judge": """SELECT l_orderkey AS response_id, l_linenumber AS seq, CASE l_suppkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'hallucinated' WHEN 2 THEN 'uncertain' ELSE 'skipped' END AS verdict,
        round(l_discount * 10, 2) AS confidence, concat('c', CAST(l_partkey % 40 AS STRING)) AS claim FROM lineitem""",
    "sections": """SELECT page_id AS doc, 1 AS seq, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_replace(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<[^>]*>', ' '/*all*/) AS body FROM pages
        UNION ALL SELECT item_id AS doc, 2 AS seq, substr(text, 1, 20) AS heading, text AS body FROM benchmark""",
}


def needed(name: str, seen: list[str] | None = None) -> list[str]:
    """The views that a text reads, each after those it reads itself."""
    seen = [] if seen is None else seen
    for other in VIEWS:
        if other not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", VIEWS.get(name, name)):
            needed(other, seen)
            seen.append(other)
    return seen


def with_views(body: str) -> str:
    """``body`` for DuckDB, with the views it reads as common table expressions; ``/*all*/`` replaces every match there, as Spark does anyway."""
    views = needed(body)
    if not views:
        return body
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views).replace("/*all*/", ", 'g'")
    body = body.strip()
    recursive = "RECURSIVE "
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH {recursive}{heads}, {body[len('WITH RECURSIVE') :]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[len('WITH') :]}"
    return f"WITH {heads} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the Parquet tables of ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, frames = VIEWS[name], {}
    for other in [*VIEWS, *TABLES]:
        found = re.sub(rf"\b(FROM|JOIN)\s+{other}\b", rf"\1 {{{other}}}", text)
        if found != text:
            text, frames[other] = found, view(spark, sf_dir, other)
    return spark.sql(text, **frames)
