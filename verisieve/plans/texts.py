"""Queries that extract from responses, messages and documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import delimiter_depth, token_estimate
from ..operators import documents, extract, messages
from ..operators import patterns as P
from ..operators.extract import CODE_LINE, SCORE
from .registry import query


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


_PARTS = f"parts AS (SELECT response_id, content, regexp_split_to_array(chr(10) || content, {q(extract.FENCE)}) AS p FROM responses)"
_BLOCKS = f"""{_PARTS}, raw_blocks AS (SELECT response_id, ((i - 2) // 2)::INT AS block_no, p[i] AS x FROM (SELECT response_id, p, unnest(range(2, len(p), 2)) AS i FROM parts)),
  blocks AS (SELECT response_id, block_no, regexp_extract(x, '^`*[ \\t]*([^\\s,]*)', 1) AS tag, regexp_replace(x, '^[^\\n]*\\n?', '') AS body FROM raw_blocks)"""
_COUNT = "(len(regexp_split_to_array({0}, {1})) - 1)"
_SCORE = " + ".join([f"CASE WHEN regexp_matches(body, {q(rx)}) THEN {n} ELSE 0 END" for rx, n in SCORE] + [f"contains(body, '{m}')::INT" for m in ("=>", "::", "->")] + [f"({_COUNT.format('body', q('(?m)^[^.\\n]*\\.[A-Za-z]'))} >= 2)::INT", f"({_COUNT.format('body', q(';'))} >= 3)::INT", f"({_COUNT.format('body', q('[{}]'))} >= 4)::INT"])
_LINES = "list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '')"
_CODE_LINES = f"list_filter({_LINES}, lambda l: regexp_matches(l, {q(CODE_LINE)}))"
_ACCEPTED = f"len({_LINES}) > 0 AND (len({_LINES}) <= 2 OR {_SCORE} >= 3 OR len({_CODE_LINES}) * 2 >= len({_LINES}))"
_CODE = f"""{_BLOCKS}, code AS (SELECT response_id, string_agg(body, '' ORDER BY block_no) AS code FROM blocks WHERE (tag = '' OR tag IN {names(P.CODE_TAGS)}) AND tag NOT IN {names(P.PROSE_TAGS)} AND {_ACCEPTED} GROUP BY response_id)"""


def matches(table, source: str = "code", text: str = "code", keep: str = "response_id") -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{kind}' AS kind, {n} AS priority, unnest(regexp_extract_all({text}, {q(rx)}, {g})) AS value FROM {source}" for n, (kind, rx, g) in enumerate(table))


def _code(v):
    return extract.code_of(v.responses)


def _noisy(v):
    return v.responses.select("response_id", F.concat(F.lit("<tool_result>x"), F.substring("content", 1, 30), F.lit("</tool_result>"), "content", F.lit('"total_tokens": 55, "other": 1 ```json\n'), F.repeat(F.lit("z"), 600), F.lit("```")).alias("content"))


@query(
    r"""SELECT response_id, regexp_replace(regexp_replace(regexp_replace(concat('<tool_result>x', substr(content, 1, 30), '</tool_result>', content, '"total_tokens": 55, "other": 1 ```json', chr(10), repeat('z', 600), '```'),
    '(?s)<tool_(?:result|response)>.*?</tool_(?:result|response)>', '[tool output stripped]', 'g'), '(?s)```(?:json|xml)\n(.{500,}?)```', '[large code block stripped]', 'g'),
    '"(?:prompt_tokens|completion_tokens|total_tokens|reasoning_tokens|cached_tokens|prompt_tokens_details|completion_tokens_details|system_fingerprint|finish_reason)":\s*[\d"a-z_]+', '', 'g') AS content FROM responses"""
)
def strip_tool_outputs(v):
    return _noisy(v).select("response_id", extract.stripped(F.col("content")).alias("content"))


@query(f"WITH {_BLOCKS} SELECT response_id, block_no, tag, body FROM blocks")
def fence_blocks(v):
    return v.responses.select("response_id", F.posexplode(extract.fences(F.col("content"))).alias("block_no", "b")).select("response_id", "block_no", "b.tag", "b.body")


@query(f"WITH {_BLOCKS} SELECT response_id, block_no, tag, ({_SCORE})::INT AS score, {_ACCEPTED} AS accepted FROM blocks")
def code_survival(v):
    b = v.responses.select("response_id", F.posexplode(extract.fences(F.col("content"))).alias("block_no", "b")).select("response_id", "block_no", "b.tag", "b.body")
    return b.select("response_id", "block_no", "tag", extract.code_score(F.col("body")).alias("score"), extract.accepted(F.col("body")).alias("accepted"))


_VARIABLES = f"""found_vars AS ({matches(P.VARIABLES)}), split_vars AS (SELECT response_id, kind, unnest(CASE WHEN kind IN ('parameter', 'destructured') THEN regexp_split_to_array(value, '[,{{}}\\[\\]]') ELSE [replace(value, '-', '_')] END) AS n FROM found_vars),
  vars AS (SELECT DISTINCT response_id, trim(CASE WHEN kind = 'destructured' THEN regexp_replace(trim(n), '\\s*:.*$', '') ELSE regexp_replace(trim(n), '^(?:const |let )*(?:\\.\\.\\.)?', '') END) AS name FROM split_vars),
  local_vars AS (SELECT * FROM vars WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$'))"""


@query(f"WITH {_CODE}, {_VARIABLES} SELECT response_id, name FROM local_vars")
def local_vars(v):
    return extract.local_variables(_code(v))


@query(
    f"""WITH {_CODE}, {_VARIABLES}, found AS ({matches(P.CLAIMS)}), c AS (SELECT response_id, kind, value, regexp_replace(value, '^[^a-zA-Z_]', '') AS call FROM found),
    r AS (SELECT response_id, kind, value, CASE WHEN kind IN ('class_method', 'obj_method') THEN split_part(call, '.', 1) WHEN kind = 'bare_call' THEN value END AS object, CASE WHEN kind = 'obj_method' THEN regexp_extract(call, '\\.(\\w+)\\($', 1) END AS method,
      CASE WHEN kind IN ('class_method', 'obj_method') THEN call WHEN kind = 'bare_call' THEN value || '(' ELSE 'from ''' || value || '''' END AS claim FROM c)
    SELECT DISTINCT response_id, kind, claim FROM r WHERE NOT coalesce(object IN {names(P.SKIP_NAMES)}, false) AND NOT coalesce(method IN {names(P.SKIP_NAMES)} OR regexp_matches(method, '^(?:is|has)_'), false)
      AND NOT (kind = 'import' AND regexp_matches(value, '^[./]')) AND NOT (kind = 'obj_method' AND EXISTS (SELECT 1 FROM local_vars l WHERE l.response_id = r.response_id AND l.name = object))"""
)
def api_claims(v):
    return extract.api_claims(_code(v))


@query(f"WITH {_CODE}, found AS ({matches(P.LIBRARIES)}) SELECT DISTINCT response_id, lower(CASE WHEN kind IN ('java', 'csharp') THEN array_to_string(string_split(value, '.')[1:2], '.') WHEN kind = 'go' THEN string_split(value, '/')[-1] WHEN kind = 'python' THEN split_part(value, '.', 1) ELSE value END) AS term FROM found")
def lookup_terms(v):
    return extract.lookup_terms(_code(v))


@query(
    f"""WITH {_CODE}, found AS ({matches(P.LIBRARIES)}), n AS (SELECT DISTINCT response_id, kind AS language, CASE WHEN kind = 'python' THEN split_part(value, '.', 1) WHEN kind = 'typescript' THEN regexp_extract(value, '^(@[^/]+/[^/]+|[^/]+)', 1) WHEN kind = 'java' THEN array_to_string(string_split(value, '.')[1:3], '.') ELSE value END AS library FROM found)
    SELECT * FROM n WHERE library NOT IN {names(P.STANDARD)} AND NOT regexp_matches(library, '^[./]')"""
)
def detect_libraries(v):
    return extract.libraries(_code(v))


def _sql_language(c: str) -> str:
    tag = f"lower(regexp_extract({c}, '```(\\w+)', 1))"
    score = lambda s: " + ".join(f"CASE WHEN contains({c}, {q(t)}) THEN {n} ELSE 0 END" for t, n in s)
    whens = [f"WHEN {tag} IN {names(t)} THEN '{n}'" for n, t in P.TAG_LANGUAGE.items()] + [f"WHEN {' AND '.join(f'contains({c}, {q(p)})' for p in parts)} THEN '{n}'" for n, parts in P.DISTINCTIVE]
    return f"CASE {' '.join(whens)} WHEN {score(P.PYTHON_SIGNALS)} >= {P.PYTHON_LEAST} AND {score(P.PYTHON_SIGNALS)} > {score(P.TYPESCRIPT_SIGNALS)} THEN 'python' WHEN {score(P.TYPESCRIPT_SIGNALS)} >= {P.TYPESCRIPT_LEAST} THEN 'typescript' ELSE 'unknown' END"


_CUT = "CASE response_id % 4 WHEN 0 THEN content WHEN 1 THEN replace(content, '```', '') WHEN 2 THEN replace(replace(content, '```', ''), 'fn ', '') ELSE replace(replace(replace(content, '```', ''), 'fn ', ''), 'import ', '') END"


@query(f"SELECT response_id, {_sql_language('c')} AS language FROM (SELECT response_id, {_CUT} AS c FROM responses)")
def detect_language(v):
    return v.responses.select("response_id", F.expr(_CUT).alias("c")).select("response_id", extract.language(F.col("c")).alias("language"))


@query(
    f"""WITH {_CODE}, s AS ({' UNION ALL '.join(f"SELECT response_id, {n} AS priority, i AS position, v[i] AS var, trim(regexp_replace(t[i], '<.*$', '')) AS type FROM (SELECT response_id, v, t, unnest(range(1, len(v) + 1)) AS i FROM (SELECT response_id, regexp_extract_all(code, {q(rx)}, {a}) AS v, regexp_extract_all(code, {q(rx)}, {b}) AS t FROM code))" for n, (_, rx, a, b) in enumerate(P.SCOPE))})
    SELECT response_id, var, arg_max(type, (priority, position)) AS type FROM s GROUP BY response_id, var"""
)
def scope_vars(v):
    return extract.scope(_code(v))


@query("SELECT doc_id, ceil(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) * 0.25 + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))))::BIGINT AS tokens FROM documents")
def token_estimates(v):
    return v.documents.select("doc_id", token_estimate(F.col("text")).alias("tokens"))


_SENTENCES = f"""{_PARTS}, outside AS (SELECT response_id, array_to_string(list_transform(range(1, len(p) + 1, 2), lambda i: CASE WHEN i = 1 THEN p[i] ELSE regexp_replace(p[i], '^[^\\n]*', '') END), chr(10)) AS t FROM parts),
  chunks AS (SELECT response_id, l, unnest(range(1, len(l) + 1)) AS seq FROM (SELECT response_id, regexp_split_to_array(t, '[\\n.;]') AS l FROM outside)),
  sentences AS (SELECT response_id, seq, trim(l[seq]) AS sentence FROM chunks WHERE strlen(trim(l[seq])) BETWEEN 12 AND 280 AND contains(trim(l[seq]), ' '))"""
_FIRST = "SELECT response_id, n::INT AS n, sentence || '.' AS claim FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY seq) AS n FROM {}) WHERE n <= 8"


@query(f"WITH {_SENTENCES}, hit AS (SELECT * FROM sentences WHERE regexp_matches(lower(sentence), '{'|'.join(P.TRIGGERS)}')) " + _FIRST.format("hit"))
def prose_claims(v):
    return extract.prose_claims(v.responses)


@query(
    f"WITH {_CODE}, {_SENTENCES.replace(_PARTS + ', ', '')}, ids AS (SELECT DISTINCT response_id, lower(unnest(regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]{{3,}}'))) AS name FROM code), words AS (SELECT response_id, seq, sentence, unnest(regexp_extract_all(lower(sentence), '[a-z0-9_]{{4,}}')) AS name FROM sentences), hit AS (SELECT DISTINCT response_id, seq, sentence FROM words w WHERE EXISTS (SELECT 1 FROM ids i WHERE i.response_id = w.response_id AND i.name = w.name AND i.name NOT IN {names(P.COMMON)})) "
    + _FIRST.format("hit")
)
def anchored_claims(v):
    return extract.anchored_claims(v.responses, _code(v))


@query(f"WITH {_BLOCKS}, f AS ({matches(P.DEFINITIONS, 'blocks', 'body', 'response_id, tag')}) SELECT DISTINCT response_id, tag, value AS name FROM f WHERE tag <> 'python' AND tag <> ''")
def cross_lang_defs(v):
    return extract.foreign_definitions(v.responses, "python")


@query(f"WITH {_CODE}, f AS ({matches(P.INDEX)}) SELECT DISTINCT response_id, kind, value AS name FROM f WHERE value NOT IN {names(P.SKIP_NAMES)}")
def index_entries(v):
    return extract.index_entries(_code(v))


@query(
    f"""WITH {_CODE}, {_VARIABLES}, lists AS (SELECT response_id, unnest(regexp_extract_all(code, '\\(([^()]*)\\)', 1)) AS l FROM code), used AS (SELECT DISTINCT response_id, trim(n) AS name FROM (SELECT response_id, unnest(string_split(l, ',')) AS n FROM lists) WHERE regexp_matches(trim(n), '^[a-z_][a-z0-9_]{{2,}}$')),
    known AS (SELECT response_id, name FROM local_vars UNION ALL SELECT response_id, value FROM ({matches(P.INDEX)}) UNION ALL SELECT response_id, unnest(regexp_extract_all(code, '([A-Za-z_]\\w*)[ \\t]*\\(', 1)) FROM code)
    SELECT * FROM used u WHERE name NOT IN {names(P.SKIP_NAMES)} AND NOT EXISTS (SELECT 1 FROM known k WHERE k.response_id = u.response_id AND k.name = u.name)"""
)
def undefined_names(v):
    return extract.undefined_names(_code(v))


@query(
    """WITH c AS (SELECT response_id, regexp_replace(content, '[^(){}\\[\\]]', '', 'g') AS s FROM responses), d AS (SELECT response_id, list_reduce(list_prepend([0, 0], list_transform(string_split(s, ''), lambda c: CASE WHEN c IN ('(', '{', '[') THEN [1, 0] WHEN c IN (')', '}', ']') THEN [-1, 0] ELSE [0, 0] END)),
      lambda a, x: [greatest(a[1] + x[1], 0), greatest(a[2], a[1] + x[1])]) AS r FROM c) SELECT response_id, least(r[2], 5000)::INT AS depth FROM d"""
)
def delimiter_depths(v):
    return v.responses.select("response_id", delimiter_depth(F.col("content")).alias("depth"))


_MARKED = "CASE WHEN role = 'user' AND turn % 7 = 0 THEN text || ' Suggest a title' WHEN role = 'user' AND turn % 5 = 0 THEN text || ' ## Goal ## Progress ## Key Decisions' WHEN role = 'system' AND conv_id % 2 = 0 THEN text || ' Summarise' ELSE text END"
_ANY = lambda words: " OR ".join(f"contains(b, {q(w)})" for w in words)


@query(
    f"""WITH u AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS u, coalesce(arg_min(text, turn) FILTER (role = 'system'), '') AS s, count(*) AS turns FROM (SELECT conv_id, turn, role, {_MARKED} AS text FROM messages) GROUP BY conv_id), b AS (SELECT *, lower(s || chr(10) || u) AS b FROM u)
    SELECT conv_id, CASE WHEN {_ANY(messages.COMPACTION)} OR {' OR '.join('(' + ' AND '.join(f'contains(b, {q(w)})' for w in g) + ')' for g in messages.COMPACTION_GROUPS)} THEN 'compaction' WHEN {_ANY(messages.BACKGROUND)} OR (turns <= 3 AND regexp_matches(lower(s), 'summari|compact')) THEN 'background' ELSE 'chat' END AS class FROM b"""
)
def classify_requests(v):
    return messages.classify(v.messages.withColumn("text", F.expr(_MARKED)))


@query(
    """SELECT event_id, coalesce(k, 0)::BIGINT AS prompt, floor(value * 10)::BIGINT AS completion, (coalesce(k, 0) + floor(value * 10))::BIGINT AS total FROM (SELECT event_id, value, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""
)
def usage_normalize(v):
    raw = v.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.format_string('{"prompt_tokens": %s, "completion_tokens": %d}', F.regexp_extract("props", "([0-9]+)", 1), F.floor(F.col("value") * 10))).otherwise(F.format_string('{"input_tokens": %s, "output_tokens": %d}', F.regexp_extract("props", "([0-9]+)", 1), F.floor(F.col("value") * 10))).alias("usage"))
    return messages.usage(raw, "usage").select("event_id", "prompt", "completion", "total")


@query("SELECT doc, seq, heading, substr(body, 1, CASE WHEN heading <> '' THEN 2000 ELSE 500 END) AS body FROM sections")
def doc_sections(v):
    return documents.sections(v.sections)


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda x: length(x) >= 4))"
_TOKENS = "SELECT item_id AS claim, unnest({}) AS token FROM benchmark".format(_WORDS.format("text"))


@query(
    f"""WITH t AS ({_TOKENS}), h AS (SELECT doc, seq, unnest({_WORDS.format('heading')}) AS token, 1 AS in_heading FROM sections UNION ALL SELECT doc, seq, unnest({_WORDS.format('body')}), 0 FROM sections)
    SELECT claim, doc, seq, max(in_heading)::INT AS in_heading, count(*) FILTER (in_heading = 0) AS in_body FROM h JOIN t USING (token) GROUP BY claim, doc, seq HAVING max(in_heading) = 1 OR count(*) FILTER (in_heading = 0) >= 2"""
)
def focused_sections(v):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z0-9_]+"), lambda x: F.length(x) >= 4))
    return documents.focused(v.sections, v.benchmark.select(F.col("item_id").alias("claim"), F.explode(words).alias("token")))


@query(
    """WITH w AS (SELECT item_id AS claim, lower(split_part(text, ' ', 2)) AS word FROM benchmark), s AS (SELECT claim, unnest(list_distinct([word, regexp_replace(word, '(?:s|ed|ing)$', '')])) AS key FROM w), b AS (SELECT doc, seq, lower(regexp_extract(heading, '^([A-Za-z0-9_]+)', 1)) AS key FROM sections)
    SELECT claim, doc, seq FROM (SELECT claim, doc, seq, row_number() OVER (PARTITION BY claim ORDER BY doc, seq) AS n FROM s JOIN b USING (key) WHERE key <> '') WHERE n = 1"""
)
def doc_exact_gate(v):
    return documents.exact_gate(v.benchmark.select(F.col("item_id").alias("claim"), F.split_part(F.col("text"), F.lit(" "), F.lit(2)).alias("word")), v.sections)


_TOKENS_OF = "ceil(length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) * 0.25 + (length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g'))))::BIGINT"


@query(
    f"""WITH s AS (SELECT lang AS library, doc_id AS seq, {_TOKENS_OF.format('text')} AS tokens FROM documents), r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY library ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s)
    SELECT library, seq, tokens, least(tokens, 4000 - used)::BIGINT AS taken, tokens > 4000 - used AS truncated FROM r WHERE used < 4000"""
)
def doc_budget(v):
    return documents.budgeted(v.documents.select(F.col("lang").alias("library"), F.col("doc_id").alias("seq"), F.col("text").alias("body")), 4000).select("library", "seq", "tokens", "taken", "truncated")


@query("SELECT library, seq, rank::INT AS rank FROM (SELECT library, seq, row_number() OVER (PARTITION BY library ORDER BY (seq % 3 <> 0)::INT, seq) AS rank FROM symbols) WHERE rank <= 5")
def prioritized_symbols(v):
    return documents.prioritized(v.symbols.withColumn("kind", F.when(F.col("seq") % 3 == 0, "class").otherwise("method")), 5).select("library", "seq", "rank")
