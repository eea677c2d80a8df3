"""Queries over literals, paths and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical
from .registry import query
from .texts import names, q

_NOISY = "concat('a = \"q\\\\\"x\" // ', replace(text, chr(10), ' '), chr(10), '/* ', text, ' */ b = ''c''; ', text)"

_PLAIN = lexical.LITERALS["c"].replace("++", "+").replace("*+", "*")


@query(
    f"""WITH s AS (SELECT doc_id, {_NOISY.replace(chr(92) * 2, chr(92))} AS t FROM documents), p AS (SELECT doc_id, regexp_split_to_array(t, {q(_PLAIN)}) AS g, regexp_extract_all(t, {q(_PLAIN)}) AS m FROM s)
    SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(regexp_replace(m[i], '[^\\n]', ' ', 'g'), '')), '') AS code FROM p"""
)
def blanked_code(v):
    return v.documents.select("doc_id", F.expr(_NOISY).alias("t")).select("doc_id", lexical.blanked("t", "c").alias("code"))


@query("SELECT l_orderkey AS request_id, min(CASE WHEN l_partkey % 3 = 0 THEN '/home/p/src' ELSE '/home/p' END) AS any_folder, count(DISTINCT l_linenumber)::INT AS n FROM lineitem GROUP BY l_orderkey")
def file_path_roots(v):
    folder = F.when(F.col("l_partkey") % 3 == 0, "/home/p/src").otherwise("/home/p")
    one = F.concat(F.when(F.col("l_linenumber") == 1, '{"filePath": "').otherwise('<parameter name="path">'), folder, F.lit("/f"), F.col("l_linenumber"), F.when(F.col("l_linenumber") == 1, '.py"}').otherwise(".py</parameter> \"path\": \"rel/x\""))
    text = v.lineitem.groupBy(F.col("l_orderkey").alias("request_id")).agg(F.array_join(F.collect_set(one), " ").alias("t"), F.min(folder).alias("low"), F.max(folder).alias("high"))
    found = text.select("request_id", "low", "high", lexical.file_paths("t").alias("paths"))
    return found.select("request_id", F.when(lexical.common_parent("paths") == F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("/home/p"), F.col("low")).alias("any_folder"), F.size(F.array_distinct(F.transform("paths", lambda p: F.regexp_extract(p, r"f(\d)", 1)))).alias("n"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN (item_id * 3)::VARCHAR WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'True' END AS predicted FROM benchmark")
def predicted_outputs(v):
    claim = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("It prints "), F.col("item_id") * 3, F.lit(". Then"))).when(F.col("item_id") % 4 == 1, "Outputs [1, 2] since").when(F.col("item_id") % 4 == 2, "logs True").otherwise("prints nothing much")
    return v.benchmark.select("item_id", lexical.predicted_output(claim).alias("predicted"))


_OWNER = "CASE l_suppkey % 5 WHEN 0 THEN 'Date' WHEN 1 THEN 'MAX_SIZE' WHEN 2 THEN 'Path' ELSE class END"


@query(
    f"""WITH c AS (SELECT CASE suppkey % 5 WHEN 0 THEN 'Date' WHEN 1 THEN 'MAX_SIZE' WHEN 2 THEN 'Path' ELSE class END AS owner, CASE WHEN seq = 3 THEN 'clone' ELSE method END AS method, CASE seq % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'unknown' END AS language FROM claims)
    SELECT owner, language, count(*) FILTER (method IN {names(lexical.UNIVERSAL)} OR (owner = 'Date' AND language <> 'python') OR (owner = 'Path' AND language <> 'typescript') OR owner = 'MAX_SIZE') AS trusted, count(*) AS n FROM c GROUP BY owner, language"""
)
def trusted_claims(v):
    c = v.claims.select(F.expr(_OWNER.replace("l_suppkey", "suppkey")).alias("owner"), F.when(F.col("seq") == 3, "clone").otherwise(F.col("method")).alias("method"), F.expr("CASE seq % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'unknown' END").alias("language"))
    return c.groupBy("owner", "language").agg(F.count_if(lexical.trusted(F.col("owner"), F.col("method"), F.col("language"))).alias("trusted"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('x = ', conv_id, chr(10), 'say(\"hi\")') ELSE '' END AS code FROM conversations")
def tool_call_codes(v):
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('prose {"type":"tool_use","input":{"newString":"x = '), F.col("conv_id"), F.lit('\\nsay(\\"hi\\")"}} more'))).otherwise(F.lit('no "content": "call" here'))
    return v.conversations.select("conv_id", "turn", body.alias("t")).select("conv_id", "turn", lexical.tool_call_code("t").alias("code"))
