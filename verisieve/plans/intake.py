"""Queries over readers, sinks, rules and streaming actions: rows go through files or the forms that files have, and come back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import documents, evidence, extract, lexical, messages, rules
from ..operators import patterns as P
from ..sources import readers, sinks
from ..streaming import sessions, sse
from .registry import query
from .texts import names, q


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="verisieve-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/verisieve-files/{name}-{uuid.uuid4().hex}"


def written(lines: DataFrame, name: str, files: int | None = None) -> str:
    """A column of lines as text files; their folder."""
    path = scratch(lines.sparkSession, name)
    (lines if files is None else lines.coalesce(files)).write.text(path)
    return path


# -- logs, transcripts, corpora, events

@query("SELECT phase, scan_result, count(*) AS n, sum(latency_ms)::BIGINT AS latency, min(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.5 END)::DOUBLE AS least_confidence FROM scan_log GROUP BY phase, scan_result")
def scan_log_lines(v):
    line = F.to_json(F.struct("phase", "scan_result", "latency_ms", F.col("risk").alias("risk_score"), F.when(F.col("event_id") % 4 != 0, 0.5).alias("confidence")))
    damaged = F.explode(F.array(line, F.lit('{"phase": "deep", '), F.lit(""), F.lit("# note"), F.lit("[1]")))
    log = readers.scan_log(v.spark, written(v.scan_log.select(damaged.alias("value")), "scan_log"))
    return log.groupBy("phase", "scan_result").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency"), F.min("confidence").alias("least_confidence"))


@query("SELECT 2 * (row_number() OVER (ORDER BY conv_id, turn) - 1) AS number, md5(text) AS content FROM conversations WHERE text <> '' QUALIFY true")
def transcript_lines(v):
    rows = v.conversations.where("text <> ''").orderBy("conv_id", "turn").select(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))).alias("line"))
    path = written(rows.coalesce(1).select(F.explode(F.array("line", F.lit("not json"))).alias("value")), "transcript", 1)
    return readers.transcript(v.spark, path).select("number", F.md5("content").alias("content"))


@query("SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END AS ground_truth, md5('```python' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'claim ' || item_id) AS rendered FROM benchmark")
def corpus_samples(v):
    sample = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("python").alias("language"), F.when(F.col("item_id") % 2 == 0, "TRUE").otherwise("false").alias("ground_truth"), F.col("text").alias("code"), F.concat(F.lit("claim "), F.col("item_id")).alias("prose_claim"))
    return readers.corpus(v.spark, written(v.benchmark.select(F.to_json(sample).alias("value")), "corpus")).select("id", "ground_truth", F.md5("rendered").alias("rendered"))


@query("SELECT md5(text) AS text, count(*) AS n FROM conversations WHERE turn % 3 <> 2 AND text IS NOT NULL GROUP BY 1")
def agent_event_texts(v):
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.struct("text").alias("part")))
    used = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.struct(F.struct(F.struct(F.col("text").alias("newString")).alias("input")).alias("state")).alias("part")))
    line = F.when(F.col("turn") % 3 == 0, said).when(F.col("turn") % 3 == 1, used).otherwise('{"type": "step"}')
    return readers.agent_events(v.spark, written(v.conversations.select(line.alias("value")), "events")).groupBy(F.md5("text").alias("text")).agg(F.count("*").alias("n"))


# -- files: their listing is a table (path, modificationTime, content)

_FOLDER = "CASE doc_id % 7 WHEN 0 THEN '/p/node_modules/x' WHEN 1 THEN '/p/.hidden' ELSE concat('/p/src', CAST(doc_id % 5 AS STRING)) END"
_SUFFIX = "CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'md' WHEN 2 THEN 'ts' WHEN 3 THEN 'txt' WHEN 4 THEN 'go' ELSE 'bin' END"
_PATH = f"concat({_FOLDER}, '/f', CAST(doc_id AS STRING), '.', {_SUFFIX})"


def files(v) -> DataFrame:
    return v.documents.select(F.expr(_PATH).alias("path"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("modificationTime"), F.encode("text", "UTF-8").alias("content"))


@query(f"SELECT suffix, count(*) AS n, sum(length(text))::BIGINT AS chars, epoch(max(modified))::BIGINT AS newest FROM (SELECT {_PATH} AS path, {_SUFFIX} AS suffix, text, to_timestamp(1700000000 + doc_id) AS modified FROM documents) WHERE suffix IN ('py', 'ts', 'go') AND NOT contains(path, '/node_modules/') GROUP BY suffix")
def source_files(v):
    return readers.sources(files(v)).groupBy("suffix").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("modified").cast("long").alias("newest"))


@query(f"SELECT path, md5(text) AS text FROM (SELECT {_PATH} AS path, text, strlen(text) AS n FROM documents) WHERE (path LIKE '%.md' OR path LIKE '%.txt') AND NOT contains(path, '/.hidden/') AND n <= 10240")
def docs_files(v):
    return readers.docs(files(v).where(F.length("content") <= 10_240)).select("path", F.md5("text").alias("text"))


_DECLARED = "concat('import os', chr(10), 'class C', CAST(p_partkey AS STRING), '(Base):', chr(10), '    def m', CAST(p_size AS STRING), '(self, a: Dict[str, int], b=(1, 2)):', chr(10), '        pass', chr(10), 'def top', CAST(p_partkey AS STRING), '():', chr(10), '    return 1')"
_GO = "concat('package p', chr(10), 'func Run', CAST(p_partkey AS STRING), '(x int) error {', chr(10), '}', chr(10), 'func (t T) Do', CAST(p_size AS STRING), '() {}', chr(10), 'type T', CAST(p_partkey AS STRING), ' struct {}')"


@query("""SELECT 'python' AS language, p_partkey, unnest(['class', 'method', 'function']) AS kind, unnest([concat('C', p_partkey), concat('m', p_size), concat('top', p_partkey)]) AS name FROM part
    UNION ALL SELECT 'go', p_partkey, unnest(['function', 'method', 'class']), unnest([concat('Run', p_partkey), concat('Do', p_size), concat('T', p_partkey)]) FROM part""")  # fmt: skip
def declared_symbols(v):
    def of(suffix, language, text):
        rows = v.part.select(F.concat(F.lit("/s/"), "p_partkey", F.lit(f".{suffix}")).alias("path"), F.lit(suffix).alias("suffix"), F.expr(text).alias("text"))
        return readers.local_symbols(rows).select(F.lit(language).alias("language"), F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("p_partkey"), "kind", "name")

    return of("py", "python", _DECLARED).unionByName(of("go", "go", _GO))


@query("""SELECT p_partkey, ['self', 'a: Dict[str, ' || p_size || ']', 'b=(1, 2)', 'c' || p_partkey] AS params FROM part""")
def split_parameters(v):
    text = F.concat(F.lit("self, a: Dict[str, "), "p_size", F.lit("], b=(1, 2), c"), "p_partkey")
    return v.part.select("p_partkey", readers.split_params(text).alias("params"))


@query("""SELECT 'typescript' AS language, replace(lower(n_name), ' ', '-') AS library, '^' || n_regionkey AS version FROM nation UNION ALL SELECT 'rust', replace(lower(n_name), ' ', '-'), n_nationkey || '.0' FROM nation
    UNION ALL SELECT 'go', 'example.com/' || replace(lower(n_name), ' ', '-'), 'v' || n_nationkey FROM nation""")  # fmt: skip
def manifest_libraries(v):
    name = F.regexp_replace(F.lower("n_name"), " ", "-")
    node = F.to_json(F.struct(F.create_map(name, F.concat(F.lit("^"), "n_regionkey")).alias("dependencies")))
    cargo = F.concat(F.lit('[package]\nname = "p"\n[dependencies]\n'), name, F.lit(' = "'), "n_nationkey", F.lit('.0"\n[features]\nx = "1"\n'))
    go = F.concat(F.lit("module m\nrequire example.com/"), name, F.lit(" v"), "n_nationkey", F.lit("\n"))
    rows = [v.nation.select(F.concat(F.lit("/r"), "n_nationkey", F.lit(f"/{f}")).alias("path"), text.alias("text")) for f, text in (("package.json", node), ("Cargo.toml", cargo), ("go.mod", go))]
    return readers.manifests(rows[0].unionByName(rows[1]).unionByName(rows[2])).select("language", "library", "version")


@query("SELECT concat('K', s_suppkey) AS class, unnest(['class', 'method', 'signal']) AS kind, unnest([concat('K', s_suppkey), concat('go_', s_nationkey), 'ready']) AS name FROM supplier")
def engine_classes(v):
    xml = F.concat(F.lit('<class name="K'), "s_suppkey", F.lit('" inherits="Object"><methods><method name="go_'), "s_nationkey", F.lit('"/></methods><signals><signal name="ready"/></signals></class>'))
    return readers.class_members(v.supplier.select(xml.alias("text")))


@query("SELECT concat('crate', s_suppkey) AS library, unnest(['class', 'function', 'method']) AS kind, unnest([concat('S', s_suppkey), concat('f', s_nationkey), 'm']) AS name, unnest(['a struct', NULL, 'other']) AS docs FROM supplier")
def crate_items(v):
    item = lambda name, kind, docs: F.concat(F.lit('{"name":"'), name, F.lit('","docs":' + (f'"{docs}"' if docs else "null") + ',"visibility":"public","inner":{"' + kind + '":"x"}}'))
    body = F.concat(F.lit('{"index":{"0":'), item(F.concat(F.lit("S"), "s_suppkey"), "struct", "a struct"), F.lit(',"1":'), item(F.concat(F.lit("f"), "s_nationkey"), "function", None), F.lit(',"2":'), item(F.lit("m"), "variant", "other"), F.lit(',"3":{"name":null}},"crate_version":"1"}'))
    return readers.rustdoc(v.supplier.select(F.concat(F.lit("/d/crate"), "s_suppkey", F.lit(".json")).alias("path"), body.alias("text")))


@query("SELECT case_id, verdict, language, md5(diff) AS diff FROM (SELECT concat(item_id, '-x') AS case_id, CASE item_id % 2 WHEN 0 THEN 'ALLOW' ELSE 'BLOCK' END AS verdict, 'go' AS language, text AS diff FROM benchmark)")
def case_folders(v):
    root = F.concat(F.lit("/c/cases/"), "item_id", F.lit("-x/"))
    parts = (("diff.patch", F.col("text")), ("after.go", F.lit("x")), ("expected.json", F.concat(F.lit('{"verdict":"'), F.when(F.col("item_id") % 2 == 0, "ALLOW").otherwise("BLOCK"), F.lit('"}'))), ("meta.json", F.lit('{"language":"go","library":"l"}')))
    listed = F.explode(F.array(*[F.struct(F.concat(root, F.lit(n)).alias("path"), F.encode(t, "UTF-8").alias("content")) for n, t in parts]))
    return readers.cases(v.benchmark.select(listed.alias("f")).select("f.*")).select("case_id", "verdict", "language", F.md5("diff").alias("diff"))


@query("""WITH r AS (SELECT CASE user_id % 3 WHEN 0 THEN 'npm' ELSE 'url' END AS source, concat('l', user_id % 40) AS library, ts, event_id FROM events), n AS (SELECT max(ts) AS now FROM events), a AS (SELECT r.* FROM r, n WHERE ts > now - INTERVAL 24 HOURS)
    SELECT source, library, arg_max(event_id, (ts, event_id)) AS body FROM a GROUP BY source, library""")
def fetched_docs(v):
    raw = v.events.select(F.expr("CASE user_id % 3 WHEN 0 THEN 'npm' ELSE 'url' END").alias("source"), F.concat(F.lit("l"), F.col("user_id") % 40).alias("library"), F.lit("1").alias("version"), F.col("event_id").alias("body"), F.col("ts").alias("fetched_at"))
    newest = raw.agg(F.max("fetched_at").alias("now"))
    return readers.fresh_docs(raw.crossJoin(F.broadcast(newest)), F.col("now")).select("source", "library", "body")


_INPUT = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('npm:', CAST(page_id AS STRING)) WHEN 2 THEN concat('https://github.com/a/b', CAST(page_id AS STRING)) WHEN 3 THEN concat('context7:/', CAST(page_id AS STRING)) ELSE concat('/docs/', CAST(page_id AS STRING)) END"


@query("SELECT CASE page_id % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'npm' WHEN 2 THEN 'github' WHEN 3 THEN 'context7' ELSE 'path' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def input_kinds(v):
    return v.pages.select(readers.input_kind(F.expr(_INPUT)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# -- sinks

@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM scan_log WHERE ts::DATE > (SELECT max(ts)::DATE FROM scan_log) - 3 GROUP BY 1")
def audit_days(v):
    path = scratch(v.spark, "audit")
    sinks.append_audit(v.scan_log.select("ts", "event_id"), path)
    audit = v.spark.read.parquet(path)
    last = audit.agg(F.max("day")).first()[0]  # one value
    return sinks.kept_days(audit, F.lit(last), 3).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS responses, count(*) FILTER (clean) AS clean, sum(n)::BIGINT AS warnings FROM (SELECT response_id, bool_and(warning = '') AS clean, count(*) FILTER (warning <> '') AS n FROM findings GROUP BY response_id)")
def response_report(v):
    rows = v.findings.groupBy("response_id").agg(F.filter(F.collect_list("warning"), lambda w: w != "").alias("warnings")).withColumn("clean", F.size("warnings") == 0)
    return sinks.report(rows, scratch(v.spark, "report"))


@query("SELECT count(*) AS requests, count(*) FILTER (scan_result = 'blocked') AS blocked, sum(tokens)::BIGINT AS tokens FROM scan_log")
def stats_object(v):
    parsed = sinks.stats_json(v.scan_log).select(F.from_json("json", "requests long, blocked long, tokens long").alias("s"))
    return parsed.select("s.*")


@query("SELECT version = 'agent_pending' AS own, count(*) AS n FROM (SELECT CASE WHEN seq % 9 = 0 THEN 'agent_pending' ELSE version END AS version FROM symbols WHERE seq % 9 <> 1 UNION ALL SELECT 'agent_pending' FROM symbols WHERE seq % 9 = 1) GROUP BY 1")
def pending_symbols(v):
    old = v.symbols.where("seq % 9 <> 1").withColumn("version", F.when(F.col("seq") % 9 == 0, "agent_pending").otherwise(F.col("version")))
    agent = v.symbols.where("seq % 9 in (0, 1)").withColumn("version", F.lit("0"))
    return sinks.pending(old, agent).groupBy((F.col("version") == "agent_pending").alias("own")).agg(F.count("*").alias("n"))


# -- messages, names, sections

@query("SELECT CASE page_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'openai' ELSE 'unknown' END AS provider, count(*) AS n FROM pages GROUP BY 1")
def providers(v):
    path = F.expr("CASE page_id % 4 WHEN 0 THEN '/v1/chat/completions' WHEN 1 THEN '/v1/messages' WHEN 2 THEN '/v1/responses' ELSE '/v1/models' END")
    return v.pages.select(messages.provider(path).alias("provider")).groupBy("provider").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, md5(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'more' ELSE '' END) AS text FROM conversations")
def reply_texts(v):
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    part = lambda text, kind="text": F.struct(F.lit(kind).alias("type"), text.alias("text"))
    anthropic = F.to_json(F.struct(F.array(part(F.col("text")), part(F.lit("hidden"), "thinking"), part(F.lit("more"))).alias("content")))
    body = F.when(F.col("turn") % 3 == 0, openai).when(F.col("turn") % 3 == 1, anthropic).otherwise("no reply")
    return v.conversations.select("conv_id", "turn", F.md5(messages.reply_text(body)).alias("text"))


_VAR = "CASE l_partkey % 6 WHEN 0 THEN 'i' WHEN 1 THEN 'return' WHEN 2 THEN 'row' ELSE concat('v', CAST(l_partkey % 90 AS STRING)) END"
_TYPE = "CASE l_suppkey % 4 WHEN 0 THEN 'String' WHEN 1 THEN 'T' ELSE concat('Type', CAST(l_suppkey % 30 AS STRING)) END"


@query(f"SELECT DISTINCT var, type FROM (SELECT {_VAR} AS var, {_TYPE} AS type FROM lineitem) WHERE strlen(var) >= 2 AND strlen(type) >= 2 AND var NOT IN {names(lexical.NO_VARIABLES)} AND type NOT IN {names(lexical.NO_TYPES)}")
def plausible_scope(v):
    return lexical.plausible(v.lineitem.select(F.expr(_VAR).alias("var"), F.expr(_TYPE).alias("type"))).distinct()


_LIBRARY = "CASE p_partkey % 8 WHEN 0 THEN 'pypi.requests' WHEN 1 THEN 'local.rs.tool' WHEN 2 THEN 'System.Text' WHEN 3 THEN '@types/node' WHEN 4 THEN 'github.com/a/b' WHEN 5 THEN 'NumPy ' WHEN 6 THEN 'go.uber' ELSE 'zzz' END"


@query(f"SELECT CASE p_partkey % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'csharp' WHEN 3 THEN 'typescript' WHEN 4 THEN 'go' WHEN 5 THEN 'python' WHEN 6 THEN 'go' ELSE 'unknown' END AS language, count(*) AS n FROM part GROUP BY 1")
def library_languages(v):
    language = naming.library_language(F.expr(_LIBRARY), P.LIBRARY_PREFIXES, P.LOCAL_LANGUAGES, {"numpy": "python", "react": "typescript"})
    return v.part.select(language.alias("language")).groupBy("language").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT doc_id AS doc, 'A' || doc_id AS a, text AS x FROM documents WHERE NOT contains(text, '#'))
    SELECT doc, 2 AS level, 'B' AS heading, length('## B' || chr(10) || 'two')::INT AS n FROM s UNION ALL SELECT doc, 1, a, length('# ' || a || chr(10) || x || chr(10) || '## B' || chr(10) || 'two')::INT FROM s UNION ALL SELECT doc, 1, 'C', length('# C' || chr(10) || 'end')::INT FROM s""")
def section_ends(v):
    text = F.concat(F.lit("before\n# A"), "doc_id", F.lit("\n"), "text", F.lit("\n## B\ntwo\n# C\nend"))
    rows = v.documents.where(~F.col("text").contains("#")).select(F.col("doc_id").alias("doc"), text.alias("text"))
    return documents.headings(rows).select("doc", "level", "heading", F.length("body").alias("n"))


_PROJECT = "CASE l_suppkey % 6 WHEN 0 THEN '/w/windows/a.py' WHEN 1 THEN concat('/w/p', CAST(l_partkey % 20 AS STRING), '/Cargo.toml') WHEN 2 THEN concat('/w/q', CAST(l_partkey % 20 AS STRING), '/x.test.ts') WHEN 3 THEN concat('/w/r', CAST(l_partkey % 20 AS STRING), '/main.go') WHEN 4 THEN concat('/w/s', CAST(l_partkey % 20 AS STRING), '/notes.md') ELSE '/home/me/a.py' END"


@query("SELECT DISTINCT CASE l_suppkey % 6 WHEN 1 THEN concat('/w/p', l_partkey % 20) ELSE concat('/w/r', l_partkey % 20) END AS root FROM lineitem WHERE l_suppkey % 6 IN (1, 3)")
def root_folders(v):
    return lexical.project_roots(v.lineitem.select(F.expr(_PROJECT).alias("path")), home="/home/me")


_SHAPE = "CASE doc_id % 4 WHEN 0 THEN concat('import java.util.List;', chr(10), text) WHEN 1 THEN concat('func _ready():', chr(10), '    call(1, [2', chr(10)) WHEN 2 THEN concat('def f(x):', chr(10), '    return g(x)', chr(10), 'import os', chr(10), 'class A:', chr(10), '    pass') ELSE text END"


@query("SELECT doc_id, doc_id % 4 = 0 AS java, doc_id % 4 = 1 AS cut_off, doc_id % 4 = 2 AS real FROM documents WHERE doc_id % 4 <> 3 AND regexp_full_match(text, '[^(){}\\[\\]''\"#]*')")
def shape_guards(v):
    rows = v.documents.where("doc_id % 4 <> 3").where(~F.col("text").rlike("""[(){}\\[\\]'"#]""")).select("doc_id", F.expr(_SHAPE).alias("t"))
    real = lexical.real_code(F.col("t"), extract.CODE_LINE)
    return rows.select("doc_id", lexical.java_shaped(F.col("t")).alias("java"), lexical.truncated("t").alias("cut_off"), F.when(F.col("doc_id") % 4 == 2, real).otherwise(F.lit(False)).alias("real"))


# -- language rules

_MODULE = "CASE l_suppkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'os' ELSE concat('lib', CAST(l_suppkey % 5 AS STRING)) END"
_MEMBER = "CASE l_partkey % 4 WHEN 0 THEN 'loads' WHEN 1 THEN 'lods' ELSE concat('name', CAST(l_partkey % 9 AS STRING)) END"
_PYTHON = f"concat('import ', {_MODULE}, chr(10), 'from ', {_MODULE}, ' import ', {_MEMBER}, ' as other', chr(10), 'value = ', {_MODULE}, '.', {_MEMBER}, '(1, key=missing_', CAST(l_linenumber AS STRING), ')', chr(10))"
_KNOWN = "(VALUES ('json', 'loads'), ('json', 'dumps'), ('os', 'name1'), ('os', 'path'))"


def python_facts(v) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return rules.python(v.lineitem.select(key.alias("response_id"), F.expr(_PYTHON).alias("code")))


def members(v) -> DataFrame:
    return v.spark.createDataFrame([("json", "loads"), ("json", "dumps"), ("os", "name1"), ("os", "path")], "module string, name string")


@query(f"""WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS response_id, {_MODULE} AS module, {_MEMBER} AS member, l_linenumber AS n FROM lineitem)
    SELECT kind, name, count(*) AS n FROM (SELECT unnest(['import', 'import_from', 'method_call', 'undefined']) AS kind, unnest([module, member, member, concat('missing_', n)]) AS name FROM c) GROUP BY kind, name""")
def python_syntax(v):
    return python_facts(v).groupBy("kind", "name").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS response_id, {_MODULE} AS module, {_MEMBER} AS member FROM lineitem), k AS (SELECT * FROM {_KNOWN} t(module, name))
    SELECT response_id, concat('hallucinated-import: `', module, '.', member, '` not found') AS warning FROM c WHERE module IN (SELECT module FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE k.module = c.module AND k.name = c.member)""")
def python_imports(v):
    return rules.imports(python_facts(v), members(v))


@query(f"""WITH c AS (SELECT concat_ws('-', l_orderkey, l_linenumber) AS response_id, {_MODULE} AS module, {_MEMBER} AS member FROM lineitem), k AS (SELECT * FROM {_KNOWN} t(module, name)),
    m AS (SELECT * FROM c WHERE module IN (SELECT module FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE k.module = c.module AND k.name = c.member)),
    b AS (SELECT DISTINCT m.module, m.member, first_value(k.name) OVER (PARTITION BY m.module, m.member ORDER BY levenshtein(m.member, k.name), k.name) AS suggestion FROM m JOIN k ON k.module = m.module AND levenshtein(m.member, k.name) <= 4)
    SELECT DISTINCT response_id, concat('hallucinated-method: `', m.module, '.', m.member, '` is not defined', coalesce(', did you mean `' || suggestion || '`?', '')) AS warning FROM m LEFT JOIN b USING (module, member)""")
def python_methods(v):
    return rules.module_methods(python_facts(v), members(v))


def _bare_sql(language: str, limit: str, needed: bool) -> str:
    return f"""WITH c AS (SELECT DISTINCT response_id, method AS name FROM claims), k AS (SELECT DISTINCT name FROM symbols), m AS (SELECT * FROM c WHERE name NOT IN (SELECT name FROM k)),
    d AS (SELECT DISTINCT m.name, k.name AS other, levenshtein(m.name, k.name) AS d FROM (SELECT DISTINCT name FROM m) m JOIN k ON lower(substr(m.name, 1, 3)) = lower(substr(k.name, 1, 3))),
    b AS (SELECT name, arg_min(other, (d, other)) AS suggestion FROM d WHERE d <= {limit} GROUP BY name)
    SELECT response_id, concat('hallucinated-function: `', m.name, '` is not defined', coalesce(', did you mean `' || suggestion || '`?', '')) AS warning FROM m {'JOIN' if needed else 'LEFT JOIN'} b USING (name)"""


def _bare(v, language):
    return rules.bare_functions(v.claims.select("response_id", F.col("method").alias("name")), v.symbols.select("name").distinct(), language)


@query(_bare_sql("go", "CASE WHEN strlen(name) <= 6 THEN 4 ELSE strlen(name) // 3 + 2 END", False))
def go_functions(v):
    return _bare(v, "go")


@query(_bare_sql("cpp", "CASE WHEN strlen(name) <= 6 THEN 3 ELSE strlen(name) // 3 + 1 END", True))
def cpp_functions(v):
    return _bare(v, "cpp")


@query("""WITH f AS (SELECT DISTINCT response_id, concat(lower(class), '.h') AS header FROM claims), k AS (SELECT DISTINCT concat(lower(class), '.h') AS header FROM symbols), m AS (SELECT * FROM f WHERE header NOT IN (SELECT header FROM k)),
    d AS (SELECT m.header, k.header AS other, levenshtein(m.header, k.header) AS d FROM (SELECT DISTINCT header FROM m) m, k WHERE abs(strlen(m.header) - strlen(k.header)) <= 3 + strlen(m.header) // 4),
    b AS (SELECT header, arg_min(other, (d, other)) AS suggestion FROM d WHERE d <= CASE WHEN strlen(header) >= 10 THEN 3 + strlen(header) // 4 ELSE 3 END GROUP BY header)
    SELECT response_id, concat('hallucinated-import: `', m.header, '` not found, did you mean `', suggestion, '`?') AS warning FROM m JOIN b USING (header)""")
def unknown_headers(v):
    header = F.concat(F.lower("class"), F.lit(".h")).alias("header")
    return rules.includes(v.claims.select("response_id", header), v.symbols.select(header).distinct())


@query("""SELECT tool, code, count(DISTINCT symbol) AS symbols FROM (SELECT 'rustc' AS tool, 'error[E0425]' AS code, concat('fn_', l_partkey % 70) AS symbol FROM lineitem WHERE l_suppkey % 3 = 0
    UNION ALL SELECT 'tsc', 'error TS2339', concat('prop', l_partkey % 50) FROM lineitem WHERE l_suppkey % 3 = 1) GROUP BY tool, code""")
def compiler_diagnostics(v):
    line = F.expr("CASE l_suppkey % 3 WHEN 0 THEN concat('error[E0425]: cannot find function `fn_', CAST(l_partkey % 70 AS STRING), '` in this scope') WHEN 1 THEN concat('a.ts(1,2): error TS2339: Property ''prop', CAST(l_partkey % 50 AS STRING), ''' does not exist') ELSE 'warning: unused' END")
    tool = F.expr("CASE l_suppkey % 3 WHEN 0 THEN 'rustc' ELSE 'tsc' END")
    found = rules.diagnostics(v.lineitem.select(F.col("l_orderkey").alias("response_id"), tool.alias("tool"), line.alias("line")))
    return found.groupBy("tool", "code").agg(F.count_distinct("symbol").alias("symbols"))


_LIMIT = "CASE WHEN strlen(m.member) <= 6 THEN {} ELSE strlen(m.member) // {} END"


def _members_sql(language: str, kind: str) -> str:
    limit = _LIMIT.format(*rules.MEMBER_LIMITS[language])
    return f"""WITH c AS (SELECT DISTINCT response_id, class AS type, method AS member FROM claims), k AS (SELECT DISTINCT class AS type, name AS member FROM symbols), m AS (SELECT * FROM c WHERE type IN (SELECT type FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE k.type = c.type AND k.member = c.member)),
    b AS (SELECT m.type, m.member, arg_min(k.member, (levenshtein(m.member, k.member), k.member)) AS suggestion FROM (SELECT DISTINCT type, member FROM m) m JOIN k ON k.type = m.type AND levenshtein(m.member, k.member) <= {limit} GROUP BY m.type, m.member)
    SELECT response_id, '{kind}: `' || m.type || '.' || m.member || '` not in known methods' || coalesce(', did you mean `' || suggestion || '`?', '') AS warning FROM m LEFT JOIN b USING (type, member)"""


def _members(v, language: str, kind: str) -> DataFrame:
    known = v.symbols.select(F.col("class").alias("type"), F.col("name").alias("member")).distinct()
    return rules.members(v.claims.select("response_id", F.col("class").alias("type"), F.col("method").alias("member")), known, language, kind)


@query(_members_sql("rust", "hallucinated-method"))
def rust_static_methods(v):
    return _members(v, "rust", "hallucinated-method")


@query(_members_sql("go", "hallucinated-import-name"))
def go_symbols(v):
    return _members(v, "go", "hallucinated-import-name")


@query(_members_sql("java", "hallucinated-import"))
def java_classes(v):
    return _members(v, "java", "hallucinated-import")


@query("""WITH k AS (SELECT DISTINCT 'System.' || class AS namespace FROM symbols), f AS (SELECT DISTINCT response_id, 'System.' || class AS namespace FROM claims), m AS (SELECT * FROM f WHERE namespace NOT IN (SELECT namespace FROM k)),
    d AS (SELECT m.namespace, k.namespace AS other, levenshtein(m.namespace, k.namespace) AS d FROM (SELECT DISTINCT namespace FROM m) m, k WHERE levenshtein(m.namespace, k.namespace) <= 3 + strlen(m.namespace) // 4),
    b AS (SELECT namespace, arg_min(other, (d, other)) AS suggestion FROM d GROUP BY namespace)
    SELECT response_id, 'hallucinated-namespace: `' || m.namespace || '` not found, did you mean `' || suggestion || '`?' AS warning FROM m JOIN b USING (namespace)""")
def csharp_namespaces(v):
    name = F.concat(F.lit("System."), "class").alias("namespace")
    return rules.namespaces(v.claims.select("response_id", name), v.symbols.select(name).distinct())


@query("""WITH n AS (SELECT l_orderkey AS response_id, concat(l_linenumber, '-', l_suppkey, '-', l_partkey) AS chain, l_suppkey % 4 AS s, l_partkey % 3 AS p FROM lineitem)
    SELECT response_id, chain, CASE WHEN s = 0 THEN 'chain-phantom-member: `Client.missing` does not exist' WHEN s = 1 THEN 'chain-broken: `Opaque` is unknown' WHEN p = 0 THEN 'chain-phantom-member: `Row.vanish` does not exist' END AS warning
    FROM n WHERE s IN (0, 1) OR p = 0""")
def call_chains(v):
    returns = v.spark.createDataFrame([("Client", "query", "Result"), ("Client", "raw", "Opaque"), ("Result", "first", "Row"), ("Row", "get", "str"), ("str", "strip", "str")], "type string, member string, returned string")
    members_of = F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit("missing"), F.lit("first"))).when(F.col("l_suppkey") % 4 == 1, F.array(F.lit("raw"), F.lit("x"))).when(F.col("l_partkey") % 3 == 0, F.array(F.lit("query"), F.lit("first"), F.lit("vanish"))).otherwise(F.array(F.lit("query"), F.lit("first"), F.lit("get"), F.lit("strip")))
    chain = F.concat_ws("-", "l_linenumber", "l_suppkey", "l_partkey").alias("chain")
    calls = v.lineitem.select(F.col("l_orderkey").alias("response_id"), chain, F.lit("Client").alias("type"), members_of.alias("members"))
    return rules.chains(calls, returns)


@query("""WITH s AS (SELECT class, min(arity) AS least, max(arity) + 1 AS most FROM symbols GROUP BY class)
    SELECT DISTINCT response_id, concat('hallucinated-constructor: `', c.class, '` takes ', least, ' to ', most, ' arguments') AS warning FROM claims c JOIN s USING (class) WHERE c.quantity::BIGINT % 9 < least OR c.quantity::BIGINT % 9 > most""")
def constructor_calls(v):
    signatures = v.symbols.select("class", F.col("arity").alias("least"), (F.col("arity") + 1).alias("most"))
    return rules.constructors(v.claims.select("response_id", "class", (F.col("quantity").cast("bigint") % 9).alias("arguments")), signatures)


@query("""WITH f AS (SELECT DISTINCT name, 'h' || seq % 7 || '.h' AS header FROM symbols), i AS (SELECT DISTINCT response_id, 'h' || suppkey % 7 || '.h' AS header FROM claims), c AS (SELECT DISTINCT response_id, method AS name FROM claims), n AS (SELECT * FROM c JOIN f USING (name)),
    g AS (SELECT response_id, name, min(header) AS header, bool_or(EXISTS (SELECT 1 FROM i WHERE i.response_id = n.response_id AND i.header = n.header)) AS have FROM n GROUP BY response_id, name)
    SELECT response_id, 'hallucinated-function: `' || name || '` needs `' || header || '`' AS warning FROM g WHERE NOT have""")
def c_headers(v):
    header = lambda c: F.concat(F.lit("h"), F.col(c) % 7, F.lit(".h")).alias("header")
    calls = v.claims.select("response_id", F.col("method").alias("name"))
    return rules.missing_headers(calls, v.symbols.select("name", header("seq")).distinct(), v.claims.select("response_id", header("suppkey")).distinct())


# -- responses: signals and code without fences

_SNIPPETS = {
    0: "```rust\\nasync fn go() { let x = 0..=3; go().await }\\nfn go2() {\\n    go2()\\n}\\n```",
    1: "```rust\\nimpl Drop for A {}\\nlet a = Rc::new(RefCell::new(1)); unsafe { f() }\\n```",
    2: "```python\\nasync def load(u):\\n    time.sleep(1)\\n    return load(u)\\n```",
    3: "```ts\\nconst p = Promise.all(xs)\\n```",
    4: "```ts\\nasync function f() { await db.save(); fs.readFileSync(p) }\\n```",
    5: "```cpp\\nstd::lock_guard<std::mutex> guard(mtx); mtx.lock(); int n = (int) x; malloc(3);\\n```",
    6: "```csharp\\nawait db.SaveChangesAsync(); await db.Load();\\n```",
    7: "```go\\nfunc run() {\\n    go func() { run() }()\\n}\\n```",
    8: "```c\\nchar *p = malloc(1); free(p); q = calloc(2);\\n```",
}
_EXPECTED = {
    0: ("async-scope", "off-by-one", "recursion"), 1: ("lifetime", "borrow-check", "drop-order", "unsafe"), 2: ("async-scope", "event-loop-blocking"), 3: ("unhandled-promise", "concurrency"),
    4: ("async-scope", "event-loop-blocking", "async-sync-mismatch"), 5: ("double-lock", "c-style-cast", "memory-leak"), 6: ("async-sync-mismatch",), 7: ("async-scope", "concurrency", "recursion"), 8: ("memory-leak",),
}
_CLEAN = "regexp_replace(text, '[^A-Za-z ]', ' '/*all*/)"
_SNIPPET = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN {q(t)}" for k, t in _SNIPPETS.items()) + " ELSE '' END"


@query("SELECT response_id, unnest(kinds) AS kind FROM (SELECT doc_id AS response_id, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN [{', '.join(map(q, kinds))}]" for k, kinds in _EXPECTED.items()) + " END AS kinds FROM documents)")
def behavioral_signals(v):
    content = F.concat(F.regexp_replace(F.expr(_SNIPPET), r"\\n", "\n"), F.lit("\n"), F.expr(_CLEAN))
    return extract.signals(v.documents.select(F.col("doc_id").alias("response_id"), content.alias("content")))


@query("SELECT response_id, CASE response_id % 4 WHEN 0 THEN 'fences' WHEN 1 THEN 'tool call' ELSE 'raw' END AS source, length(code)::INT AS n FROM (SELECT doc_id AS response_id, CASE doc_id % 4 WHEN 0 THEN 'x = f(' || doc_id || ')' WHEN 1 THEN 'y = g(' || doc_id || ')' WHEN 2 THEN 'import os' || chr(10) || 'def f' || doc_id || '(a):' || chr(10) || '    return a' END AS code FROM documents) WHERE code IS NOT NULL")
def code_sources(v):
    text = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN concat(regexp_replace(text, '[^A-Za-z ]', ' '), '\\n```python\\nx = f(', doc_id, ')\\n```\\n') WHEN 1 THEN concat('note {\"type\":\"tool_use\",\"input\":{\"content\":\"y = g(', doc_id, ')\"}}') "
        "WHEN 2 THEN concat('import os\\ndef f', doc_id, '(a):\\n    return a') ELSE regexp_replace(text, '[^A-Za-z ]', ' ') END"
    )
    return extract.code_or_raw(v.documents.select(F.col("doc_id").alias("response_id"), text.alias("content"))).select("response_id", "source", F.length("code").alias("n"))


# -- streaming actions

@query("SELECT request_id, max(risk) AS risk, CASE WHEN max(risk) >= 0.3 AND bool_or(event_id % 3 = 0) THEN 'block' ELSE 'flush' END AS action FROM scan_log GROUP BY request_id")
def held_calls(v):
    token = F.concat(F.lit("sym"), "event_id")
    rows = v.scan_log.select("request_id", "risk", F.concat(F.lit("hallucinated-method: `"), token, F.lit("` unknown")).alias("warning"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x."), token, F.lit("()"))).otherwise("pass").alias("new_code"))
    return sse.actions(rows).select("request_id", "risk", "action")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'anthropic' ELSE 'openai' END AS wire, concat('w', event_id) AS warning FROM scan_log WHERE scan_result = 'warning'")
def warning_events(v):
    wire = F.when(F.col("event_id") % 2 == 0, "anthropic").otherwise("openai")
    rows = v.scan_log.where("scan_result = 'warning'").select("event_id", wire.alias("wire"), sse.warning_event(F.concat(F.lit("w"), "event_id"), wire).alias("event"))
    return sse.deltas(rows.select(F.col("event_id").alias("request_id"), F.lit(0).alias("event_no"), "event", "wire")).select(F.col("request_id").alias("event_id"), "wire", F.col("content").alias("warning"))


@query("SELECT conv_id AS root, count(DISTINCT md5(text)) AS results FROM conversations GROUP BY conv_id")
def new_tool_results(v):
    rows = v.conversations.select(F.col("conv_id").alias("root"), F.col("text").alias("content"), F.timestamp_seconds(F.col("turn")).alias("ts"))
    return sessions.new_results(rows, "1 hour").groupBy("root").agg(F.count("*").alias("results"))


@query("SELECT l_orderkey AS response_id, CASE WHEN l_suppkey % 3 = 0 THEN 'not_exported' END AS verdict, count(*) AS n FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1, 2")
def go_import_symbols(v):
    imports = v.lineitem.select(F.col("l_orderkey").alias("response_id"), F.lit("fmt").alias("package"), F.when(F.col("l_suppkey") % 3 == 0, "Prinln").otherwise("Println").alias("name"))
    exports = v.spark.createDataFrame([("fmt", "Println"), ("fmt", "Printf")], "package string, export string")
    return evidence.not_exported(imports, exports).groupBy("response_id", F.lit("not_exported").alias("verdict")).agg(F.count("*").alias("n"))
