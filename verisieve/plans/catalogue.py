"""Queries over the symbol catalogue, lookups and evidence joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import byte_distance
from ..operators import evidence, symbols
from .registry import query

@query(
    """WITH p AS (SELECT DISTINCT class, name AS method FROM symbols), c AS (SELECT DISTINCT class FROM symbols),
    v AS (SELECT claims.class, CASE WHEN p.method IS NOT NULL THEN 'verified' WHEN c.class IS NOT NULL THEN 'hallucinated' ELSE 'unknown' END AS verdict
      FROM claims LEFT JOIN p ON p.class = claims.class AND p.method = claims.method LEFT JOIN c ON c.class = claims.class)
    SELECT class, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'hallucinated') AS hallucinated, count(*) FILTER (verdict = 'unknown') AS unknown,
      min(CASE verdict WHEN 'verified' THEN 1.0::DOUBLE WHEN 'hallucinated' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END) AS least_confidence FROM v GROUP BY class"""
)
def symbol_claim_check(v):
    checked = symbols.check_claims(v.claims, v.symbols)
    count = lambda k: F.count_if(F.col("verdict") == k).alias(k)
    return checked.groupBy("class").agg(count("verified"), count("hallucinated"), count("unknown"), F.min("confidence").alias("least_confidence"))


@query("SELECT library, version, count(*) AS n FROM symbols GROUP BY library, version")
def libraries_count(v):
    return v.symbols.groupBy("library", "version").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM symbols")
def count_symbols(v):
    return v.symbols.agg(F.count("*").alias("n"))


@query("SELECT library, path, max(version) AS version, arg_max(seq, (version, seq)) AS seq FROM symbols GROUP BY library, path")
def latest_version(v):
    return symbols.latest(v.symbols)


@query(
    """WITH best AS (SELECT path, library, max(version) AS version, row_number() OVER (PARTITION BY path ORDER BY library) AS n FROM symbols GROUP BY path, library),
    c AS (SELECT DISTINCT concat(class, '.', method) AS path FROM claims)
    SELECT c.path, b.library, b.version FROM c LEFT JOIN best b ON b.path = c.path AND b.n = 1"""
)
def lookup_path(v):
    return symbols.lookup(v.claims.select(F.concat_ws(".", "class", "method").alias("path")).distinct(), v.symbols, "path")


@query(
    """WITH best AS (SELECT name, library, max(version) AS version, row_number() OVER (PARTITION BY name ORDER BY library) AS n FROM symbols GROUP BY name, library),
    c AS (SELECT DISTINCT method AS name FROM claims) SELECT c.name, b.library, b.version FROM c LEFT JOIN best b ON b.name = c.name AND b.n = 1"""
)
def lookup_name(v):
    return symbols.lookup(v.claims.select(F.col("method").alias("name")).distinct(), v.symbols, "name")


@query("SELECT library, version, path FROM symbols WHERE path ILIKE 'r_ngeconomy.%'")
def lookup_prefix_ilike(v):
    return symbols.by_prefix(v.symbols, "r_ngeconomy.").select("library", "version", "path")


@query("WITH n AS (SELECT DISTINCT method AS name FROM claims) SELECT DISTINCT library, version, path FROM symbols WHERE name IN (SELECT name FROM n) OR path IN (SELECT name FROM n)")
def lookup_global(v):
    names = v.claims.select(F.col("method").alias("name")).distinct()
    return symbols.everywhere(names, v.symbols).select("library", "version", "path").distinct()


@query("SELECT DISTINCT name FROM classes WHERE lower(substr(name, 1, 4)) = 'ring' ORDER BY name LIMIT 50")
def class_prefix_top50(v):
    return symbols.prefix_block(v.classes, "ring")


@query(
    """WITH b AS (SELECT seq, library, version, class, name, path, 'function' AS kind, arity, 1 AS load FROM symbols WHERE seq % 5 = 0),
    u AS (SELECT seq, library, version, class, name, path, kind, arity, 0 AS load FROM symbols UNION ALL SELECT * FROM b)
    SELECT library, version, path, kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY library, version, path ORDER BY load DESC, seq DESC) AS n FROM u) WHERE n = 1"""
)
def upsert_last_wins(v):
    s = v.symbols
    return symbols.upsert(s, s.where("seq % 5 = 0").withColumn("kind", F.lit("function"))).select("library", "version", "path", "kind", "seq")


@query(
    """WITH b AS (SELECT library, version, path, 'class' AS kind, CASE WHEN seq % 10 = 0 THEN '' ELSE name END AS name FROM symbols WHERE seq % 7 = 0), g AS (SELECT * FROM b WHERE name <> '')
    SELECT library, version, path, kind FROM symbols WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.library = symbols.library AND g.version = symbols.version) UNION ALL SELECT library, version, path, kind FROM g"""
)
def bundle_replace(v):
    s = v.symbols.select("library", "version", "path", "kind", "name", "seq")
    bundle = s.where("seq % 7 = 0").withColumn("kind", F.lit("class")).withColumn("name", F.when(F.col("seq") % 10 == 0, "").otherwise(F.col("name")))
    return symbols.replace_bundle(s, bundle).select("library", "version", "path", "kind")


@query("SELECT library, count(*) AS n FROM symbols WHERE library <> 'Brand#2' GROUP BY library")
def remove_library(v):
    return symbols.remove_library(v.symbols, "Brand#2").groupBy("library").agg(F.count("*").alias("n"))


@query(
    """SELECT kind, visibility, count(*) AS n FROM (SELECT CASE seq % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'enum' ELSE 'method' END AS kind, CASE seq % 3 WHEN 0 THEN 'private' ELSE 'public' END AS visibility FROM symbols) GROUP BY kind, visibility"""
)
def kind_visibility_defaults(v):
    raw = v.symbols.withColumn("kind", F.expr("CASE seq % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'enum' WHEN 2 THEN 'thing' END")).withColumn("visibility", F.expr("CASE seq % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'odd' END"))
    return symbols.with_defaults(raw).groupBy("kind", "visibility").agg(F.count("*").alias("n"))


@query("SELECT seq, library, path FROM symbols s WHERE EXISTS (SELECT 1 FROM symbols o WHERE o.path = s.path AND o.library <> s.library)")
def other_library_semi(v):
    s = v.symbols
    return symbols.other_library(s.select("seq", "library", "path"), s).select("seq", "library", "path")


@query(
    """WITH c AS (SELECT DISTINCT class, method FROM claims), s AS (SELECT DISTINCT class, name AS suggestion FROM symbols),
    d AS (SELECT c.class, c.method, levenshtein(c.method, suggestion) AS distance, suggestion FROM c JOIN s ON s.class = c.class AND method <> suggestion
      AND strlen(method) >= 4 AND strlen(suggestion) >= 4 AND least(strlen(method), strlen(suggestion))::DOUBLE / greatest(strlen(method), strlen(suggestion)) >= 0.6),
    r AS (SELECT *, row_number() OVER (PARTITION BY class, method ORDER BY distance, suggestion) AS n FROM d WHERE distance <= 2)
    SELECT class, method, distance::INT AS distance, suggestion, round(0.95 - 0.05 * (distance - 1), 6)::DOUBLE AS confidence FROM r WHERE n = 1"""
)
def fuzzy_method(v):
    return symbols.nearest_method(v.claims.select("class", "method").distinct(), v.symbols)


_COMMON = "coalesce((SELECT min(i) - 1 FROM unnest(range(1, greatest(length({0}), length({1})) + 1)) t(i) WHERE lower(substr({0}, i::INT, 1)) <> lower(substr({1}, i::INT, 1))), length({0}))"


@query(
    f"""WITH c AS (SELECT DISTINCT class FROM claims WHERE strlen(class) >= 5), s AS (SELECT DISTINCT name AS suggestion FROM classes),
    p AS (SELECT class, suggestion, levenshtein(class, suggestion) AS distance FROM c JOIN s ON lower(substr(class, 1, 4)) = lower(substr(suggestion, 1, 4)) AND class <> suggestion),
    q AS (SELECT p.*, {_COMMON.format('class', 'suggestion')} AS common FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY distance, suggestion) AS n FROM q WHERE common >= 4 AND distance <= CASE WHEN common >= 6 THEN 8 ELSE 4 END)
    SELECT class, distance::INT AS distance, suggestion, common::INT AS common, round(0.45 + 0.05 * least(common, 8), 6)::DOUBLE AS confidence FROM r WHERE n = 1"""
)
def fuzzy_class_blocked(v):
    return symbols.nearest_class(v.claims, v.classes)


@query("WITH k AS (SELECT lower(p_name) AS w FROM part), t AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS token FROM part), keys AS (SELECT token AS key FROM t UNION SELECT split_part(token, '_', 2) FROM t WHERE length(split_part(token, '_', 2)) >= 3) SELECT class, count(*) AS n FROM (SELECT class, CASE WHEN seq % 2 = 0 THEN split_part(method, '_', 1) ELSE substr(class, 1, 4) END AS method FROM claims) WHERE lower(method) IN (SELECT key FROM keys) GROUP BY class")
def index_exists(v):
    tokens = v.part.select(F.regexp_replace("p_name", " ", "_").alias("token")).distinct()
    claims = v.claims.select("class", F.when(F.col("seq") % 2 == 0, F.substring_index("method", "_", 1)).otherwise(F.substring("class", 1, 4)).alias("method"))
    return symbols.indexed_claims(claims, tokens).groupBy("class").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT DISTINCT method FROM claims), r AS (SELECT DISTINCT name AS token FROM symbols),
    f AS (SELECT method, 1 AS tier, levenshtein(lower(method), lower(token)) AS distance, token FROM l JOIN r ON lower(substr(method, 1, 1)) = lower(substr(token, 1, 1)) AND method <> token),
    g AS (SELECT method, 2 AS tier, levenshtein(lower(method), lower(token)) AS distance, token FROM l JOIN r ON lower(substr(method, 1, 4)) = lower(substr(token, 1, 4)) AND method <> token AND length(method) >= 4 AND length(token) >= 4 AND abs(strlen(method) - strlen(token)) <= 3),
    u AS (SELECT * FROM f WHERE distance <= CASE WHEN strlen(method) >= 8 THEN 2 ELSE 1 END AND distance::DOUBLE / greatest(strlen(method), strlen(token)) <= 0.2 UNION ALL SELECT * FROM g WHERE distance <= 3)
    SELECT method, tier, distance::INT AS distance, token FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY tier, distance, token) AS n FROM u) WHERE n = 1"""
)
def index_fuzzy_two_tier(v):
    return symbols.nearest_token(v.claims, v.symbols.select(F.col("name").alias("token")))


def _calls(v):
    return v.claims.select("response_id", F.concat(F.lit("v"), F.col("seq")).alias("var"), "method")


@query(
    """WITH calls AS (SELECT response_id, concat('v', seq) AS var, method FROM claims), scope AS (SELECT DISTINCT response_id, concat('v', seq) AS var, class AS type FROM claims),
    s AS (SELECT DISTINCT class AS type, name FROM symbols), m AS (SELECT c.response_id, c.var, sc.type, c.method FROM calls c JOIN scope sc ON sc.response_id = c.response_id AND sc.var = c.var
      WHERE sc.type IN (SELECT type FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.type = sc.type AND s.name = c.method)),
    b AS (SELECT type, method, arg_min(name, (d, name)) AS suggestion FROM (SELECT DISTINCT m.type, m.method, s.name, levenshtein(m.method, s.name) AS d FROM m JOIN s ON s.type = m.type) WHERE d <= 2 GROUP BY type, method)
    SELECT m.response_id, m.var, m.type, m.method, b.suggestion FROM m LEFT JOIN b ON b.type = m.type AND b.method = m.method"""
)
def instance_calls(v):
    scope = v.claims.select("response_id", F.concat(F.lit("v"), F.col("seq")).alias("var"), F.col("class").alias("type")).distinct()
    return evidence.instance_calls(_calls(v), scope, v.symbols)


@query(
    """WITH s AS (SELECT name AS method, count(DISTINCT arity) AS k, max(arity) AS expected, max((seq % 11 = 0)::INT) AS any_variadic FROM symbols GROUP BY name)
    SELECT response_id, c.method, c.quantity::BIGINT % 6 AS actual, expected FROM claims c JOIN s ON s.method = c.method WHERE strlen(c.method) >= 4 AND k = 1 AND any_variadic = 0 AND c.quantity::BIGINT % 6 > expected"""
)
def arity_agreement(v):
    calls = v.claims.select("response_id", "method", (F.col("quantity").cast("bigint") % 6).alias("actual"))
    return evidence.arity_conflicts(calls, v.symbols.select(F.col("name").alias("method"), "arity", (F.col("seq") % 11 == 0).alias("variadic")))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS class, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
    a(class, ancestor, hops) AS (SELECT class, parent, 1 FROM e UNION ALL SELECT a.class, e.parent, a.hops + 1 FROM a JOIN e ON e.class = a.ancestor WHERE a.hops < 12)
    SELECT class, ancestor, min(hops)::INT AS hops FROM a WHERE class <> ancestor GROUP BY class, ancestor"""
)
def inheritance_recursive(v):
    return evidence.ancestors(v.part.where("p_partkey > 0").select(F.col("p_partkey").alias("class"), F.floor(F.col("p_partkey") / 3).alias("parent")))


@query(
    """WITH l AS (SELECT p_brand AS library, count(*) AS n FROM part GROUP BY p_brand), i AS (SELECT DISTINCT concat('brnd#', n_nationkey) AS name FROM nation),
    p AS (SELECT name, library AS suggestion, levenshtein(lower(name), lower(library)) AS distance FROM i, l WHERE n >= 5 AND name <> library),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, suggestion) AS k FROM p WHERE distance <= greatest(least(strlen(name) // 5, 10), 3))
    SELECT name, distance::INT AS distance, suggestion FROM r WHERE k = 1"""
)
def import_suggest(v):
    libraries = v.part.groupBy(F.col("p_brand").alias("library")).agg(F.count("*").alias("n"))
    return evidence.import_suggestions(v.nation.select(F.concat(F.lit("brnd#"), F.col("n_nationkey")).alias("name")), libraries)


@query(
    """WITH r AS (SELECT DISTINCT 'python' AS language, p_name AS name, CASE WHEN min(p_size) % 2 = 0 THEN 'verified' ELSE 'not_found' END AS status FROM part GROUP BY p_name)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'skipped' ELSE coalesce(r.status, 'unknown') END AS status FROM part LEFT JOIN r ON r.name = CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_name END) GROUP BY status"""
)
def registry_lookup(v):
    registry = v.part.groupBy(F.lit("python").alias("language"), F.col("p_name").alias("name")).agg(F.when(F.min("p_size") % 2 == 0, "verified").otherwise("not_found").alias("status"))
    imports = v.part.select(F.lit("python").alias("language"), F.expr("CASE WHEN p_partkey % 9 = 0 THEN './own' WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_name END").alias("name"))
    return evidence.registry_status(imports, registry).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT DISTINCT response_id, concat('r', seq) AS receiver, class AS type FROM claims), m AS (SELECT DISTINCT class AS type, name AS member FROM symbols)
    SELECT c.response_id, concat('r', c.seq) AS receiver, b.type, c.method AS member FROM claims c JOIN b ON b.response_id = c.response_id AND b.receiver = concat('r', c.seq)
    WHERE b.type IN (SELECT type FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.type = b.type AND m.member = c.method)"""
)
def receiver_calls(v):
    calls = v.claims.select("response_id", F.concat(F.lit("r"), F.col("seq")).alias("receiver"), F.col("method").alias("member"))
    bindings = v.claims.select("response_id", F.concat(F.lit("r"), F.col("seq")).alias("receiver"), F.col("class").alias("type")).distinct()
    return evidence.receivers(calls, bindings, v.symbols.select(F.col("class").alias("type"), F.col("name").alias("member")).distinct()).select("response_id", "receiver", "type", "member")


@query("WITH e AS (SELECT l_partkey AS module, md5(CAST(l_suppkey % 20 + l_partkey * (l_linenumber % 2) AS VARCHAR)) AS hash FROM lineitem) SELECT hash, count(DISTINCT module) AS modules, min(module) AS first_module FROM e GROUP BY hash HAVING count(DISTINCT module) > 1")
def checksum_dupes(v):
    return evidence.shared_checksums(v.lineitem.select(F.col("l_partkey").alias("module"), F.md5((F.col("l_suppkey") % 20 + F.col("l_partkey") * (F.col("l_linenumber") % 2)).cast("string")).alias("hash")))


@query(
    """WITH w AS (SELECT DISTINCT response_id, regexp_extract(warning, '`([^`]*)`', 1) AS symbol FROM findings WHERE contains(warning, '`')), c AS (SELECT DISTINCT l_orderkey AS response_id, concat('m', l_partkey % 50) AS symbol FROM lineitem)
    SELECT response_id, symbol, CASE WHEN k THEN 'kept' ELSE 'added' END AS source FROM (SELECT c.response_id, c.symbol, EXISTS (SELECT 1 FROM w WHERE w.response_id = c.response_id AND w.symbol = c.symbol) AS k FROM c)"""
)
def confirm_suppress(v):
    warnings = v.findings.select("response_id", F.regexp_extract("warning", "`([^`]*)`", 1).alias("symbol")).where("symbol <> ''")
    return evidence.confirm(warnings, v.lineitem.select(F.col("l_orderkey").alias("response_id"), F.concat(F.lit("m"), F.col("l_partkey") % 50).alias("symbol")).distinct())


@query("WITH w AS (SELECT response_id, seq, regexp_extract(warning, '`([^`]*)`', 1) AS symbol FROM findings), r AS (SELECT response_id, symbol FROM w WHERE seq % 3 = 0) SELECT response_id, seq, symbol FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.response_id = w.response_id AND r.symbol = w.symbol)")
def lsp_suppress(v):
    w = v.findings.select("response_id", "seq", F.regexp_extract("warning", "`([^`]*)`", 1).alias("symbol"))
    return evidence.suppress(w, w.where("seq % 3 = 0").select("response_id", "symbol").distinct()).select("response_id", "seq", "symbol")


@query("WITH e AS (SELECT DISTINCT class AS package, name FROM symbols) SELECT response_id, class AS package, method AS name FROM claims WHERE seq % 5 <> 0 AND class IN (SELECT package FROM e) AND NOT EXISTS (SELECT 1 FROM e WHERE package = class AND name = method)")
def export_census(v):
    imports = v.claims.select("response_id", F.col("class").alias("package"), F.when(F.col("seq") % 5 == 0, "*").otherwise(F.col("method")).alias("name"))
    return evidence.not_exported(imports, v.symbols.select(F.col("class").alias("package"), F.col("name").alias("export")).distinct()).select("response_id", "package", "name")


@query(
    """WITH p AS (SELECT DISTINCT class AS callable, CASE WHEN seq % 40 = 0 THEN '**rest' ELSE split_part(name, '_', 1) END AS parameter FROM symbols), closed AS (SELECT callable FROM p GROUP BY callable HAVING NOT bool_or(starts_with(parameter, '**'))),
    g AS (SELECT DISTINCT response_id, class AS callable, unnest([split_part(method, '_', 1), concat('k', seq)]) AS parameter FROM claims WHERE class IN (SELECT callable FROM closed))
    SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.callable = g.callable AND p.parameter = g.parameter)"""
)
def kwargs_census(v):
    parameters = v.symbols.select(F.col("class").alias("callable"), F.when(F.col("seq") % 40 == 0, "**rest").otherwise(F.substring_index("name", "_", 1)).alias("parameter")).distinct()
    calls = v.claims.select("response_id", F.col("class").alias("callable"), F.array(F.substring_index("method", "_", 1), F.concat(F.lit("k"), F.col("seq"))).alias("keywords"))
    return evidence.unknown_arguments(calls, parameters).select("response_id", "callable", "parameter")


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INT AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def byte_edit_distance(v):
    a, b = v.nation.select(F.col("n_name").alias("a"), "n_regionkey", F.col("n_nationkey").alias("ka")), v.nation.select(F.col("n_name").alias("b"), "n_regionkey", F.col("n_nationkey").alias("kb"))
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", byte_distance(F.col("a"), F.col("b")).alias("distance"))
