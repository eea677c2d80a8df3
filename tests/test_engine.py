"""Operators on written rows: extraction, rules, readers, streaming, and parity with DuckDB."""

import json
import os

import pytest
from pyspark.sql import functions as F

from verisieve.functions import naming
from verisieve.functions.text import byte_distance, common_prefix, delimiter_depth, token_estimate
from verisieve.operators import documents, evidence, extract, lexical, messages, rules, scoring, symbols, telemetry
from verisieve.plans import ORACLE, QUERIES
from verisieve.sources import readers, sinks
from verisieve.sources.views import TABLES
from verisieve.streaming import sessions, sse

DATA = "/root/testdata/sf0.001"


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    cursor = con.execute(ORACLE[name])
    titles = [c[0] for c in cursor.description]
    assert sorted(titles) == columns
    want = sorted(repr([dict(zip(titles, r))[c] for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in frame.collect()) == want


def test_fuzzy_lookups_do_not_meet_all_pairs(spark):
    for name in ("fuzzy_method", "fuzzy_class_blocked", "index_fuzzy_two_tier", "import_suggest"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_text_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, byte_distance(a, b), a="é", b="e") == 2
    assert one(spark, byte_distance(a, b, 2), a="abcdef", b="x") == 3
    assert one(spark, common_prefix(a, b), a="HashMap", b="hashSet") == 4 and one(spark, common_prefix(a, b), a="ab", b="abc") == 2
    assert one(spark, token_estimate(a), a="abcd é") == 3
    assert one(spark, delimiter_depth(a), a=")(({[x]") == 4 and one(spark, delimiter_depth(a), a="{" * 6000) == 5000


RESPONSE = """Use `fetch_rows` here. It always returns a list of rows; never call it twice.
```python
import pandas as pd
from os import path
frame = DataFrame(1)
def load(self, name):
    return pd.read_cvs(name, missing)
frame.to_parquet(x)
Client.connect(url)
```
```text
not code(
```
```rust
fn other(a: u32) {}
```
```python
unclosed.call(
"""


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame([(1, RESPONSE), (2, ""), (3, "no fence, just load(x)"), (4, "```python\r\nx = 1\n```")], "response_id long, content string")


def test_fences_and_claims(spark, responses):
    blocks = {(r["response_id"], r["tag"]) for r in extract.code_blocks(responses).collect()}
    assert blocks == {(1, "python"), (1, "rust"), (4, "python")}
    code = extract.code_of(responses)
    claims = {(r["kind"], r["claim"]) for r in extract.api_claims(code).where("response_id = 1").collect()}
    assert ("class_method", "Client.connect(") in claims and ("obj_method", "pd.read_cvs(") in claims and ("import", "from 'os'") in claims
    assert not any(c.startswith("frame.") or "unclosed" in c for _, c in claims)
    assert {r["library"] for r in extract.libraries(code).collect()} == {"pandas"}
    assert ("frame", "DataFrame") in {(r["var"], r["type"]) for r in extract.scope(code).collect()}
    assert "other" in {r["name"] for r in extract.foreign_definitions(responses, "python").collect()}
    assert [r["claim"] for r in extract.prose_claims(responses).collect()] == ["It always returns a list of rows.", "never call it twice."]
    assert {r["response_id"]: r["l"] for r in responses.select("response_id", extract.language(F.col("content")).alias("l")).collect()} == {1: "python", 2: "unknown", 3: "unknown", 4: "python"}


def test_python_rules(spark):
    code = spark.createDataFrame([(1, "import json\nfrom os import paht, path\nx = json.lods(y)\n"), (2, "def f(:\n"), (3, None)], "response_id long, code string")
    facts = rules.python(code)
    members = spark.createDataFrame([("json", "loads"), ("json", "dumps"), ("os", "path")], "module string, name string")
    assert [r["warning"] for r in rules.undefined_variables(facts).collect()] == ["hallucinated-variable: `y` is not defined"]
    assert [r["warning"] for r in rules.imports(facts, members).collect()] == ["hallucinated-import: `os.paht` not found"]
    assert [r["warning"] for r in rules.module_methods(facts, members).collect()] == ["hallucinated-method: `json.lods` is not defined, did you mean `loads`?"]


def test_other_language_rules(spark):
    calls = spark.createDataFrame([(1, "Prinln"), (1, "Zqwx"), (2, "Println")], "response_id long, name string")
    known = spark.createDataFrame([("Println",), ("Printf",)], "name string")
    assert sorted(r["warning"] for r in rules.bare_functions(calls, known, "go").collect()) == ["hallucinated-function: `Prinln` is not defined, did you mean `Println`?", "hallucinated-function: `Zqwx` is not defined"]
    assert [r["warning"] for r in rules.bare_functions(calls, known, "cpp").collect()] == ["hallucinated-function: `Prinln` is not defined, did you mean `Println`?"]
    headers = spark.createDataFrame([(1, "vectr"), (1, "mine/own.hpp")], "response_id long, header string")
    assert [r["warning"] for r in rules.includes(headers, spark.createDataFrame([("vector",)], "header string")).collect()] == ["hallucinated-import: `vectr` not found, did you mean `vector`?"]
    lines = spark.createDataFrame([(1, "rustc", "error[E0425]: cannot find function `foo` in this scope"), (1, "tsc", "a.ts(1,2): error TS2339: Property 'bar' does not exist"), (1, "go", "ok")], "response_id long, tool string, line string")
    assert {(r["code"], r["symbol"]) for r in rules.diagnostics(lines).collect()} == {("error[E0425]", "foo"), ("error TS2339", "bar")}


def test_missing_evidence_stays_unknown(spark):
    imports = spark.createDataFrame([("go", "a/b"), ("go", "./x"), ("go", "c/d")], "language string, name string")
    registry = spark.createDataFrame([("go", "c/d", "not_found")], "language string, name string, status string")
    assert {r["name"]: r["status"] for r in evidence.registry_status(imports, registry).collect()} == {"a/b": "unknown", "./x": "skipped", "c/d": "not_found"}


def test_ancestors_end_in_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "class string, parent string")
    assert {(r["class"], r["ancestor"], r["hops"]) for r in evidence.ancestors(parents).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2)}


def test_collapse_equals_a_fold(spark):
    import random

    rng = random.Random(1)
    rows = [(i, i % 40, rng.choice(["clean", "warning", "blocked", "error", "skipped"]), rng.choice([0.0, 0.5]), rng.choice(["", "m1", "m2"]), rng.choice([0, 5]), rng.choice([0, 7])) for i in range(400)]
    log = spark.createDataFrame(rows, "event_id long, request_id long, scan_result string, risk double, model string, tokens long, latency_ms long")
    want = {}
    for key in range(40):
        run = None
        for e, _, result, risk, model, tokens, latency in sorted((r for r in rows if r[1] == key), reverse=True):
            line = [e, telemetry.SEVERITY.get(result, 0), risk, model, tokens, latency, result]
            if run is None:
                run = line
                continue
            better = line[1] > run[1] or line[1] == run[1] and (line[2] > run[2] or line[2] == run[2] and run[3] == "" and model != "")
            keep, other = (line, run) if better else (run, line)
            run = [*keep[:3], keep[3] or other[3], keep[4] or other[4], keep[5] or other[5], keep[6]]
        want[key] = run
    got = {r["request_id"]: [r["event_id"], telemetry.SEVERITY.get(r["scan_result"], 0), r["risk"], r["model"], r["tokens"], r["latency_ms"], r["scan_result"]] for r in telemetry.collapse(log).collect()}
    assert got == want


def test_risk_floors_and_caps(spark):
    rows = [(1, "logic: a", False, False)] * 6 + [(2, "Unverified API: x", False, True), (3, "other", True, False), (4, "nothing: z", False, False), (5, "logic: y", False, True), (6, "forge: hallucinated-method: `m`", False, False)]
    got = {r["response_id"]: (r["risk"], r["confidence"]) for r in scoring.risk(spark.createDataFrame(rows, "response_id long, warning string, blocked boolean, scan_failed boolean")).collect()}
    assert got == {1: (0.6, 1.0), 2: (0.4, 0.6), 3: (1.0, 0.1), 4: (0.0, 1.0), 5: (0.15, 1.0), 6: (0.4, 0.6)}


def test_readers(spark, tmp_path):
    bundle = tmp_path / "b.jsonl"
    bundle.write_text('# note\n\n{"library":"l","version":"1","path":"A.b","name":"b","kind":"odd","params_json":"[{\\"name\\":\\"x\\"}]","is_deprecated":1}\n{broken\n{"name":""}\n[1]\n')
    rows = symbols.with_defaults(readers.bundle(spark, str(bundle))).collect()
    assert len(rows) == 1 and rows[0]["kind"] == "method" and rows[0]["is_deprecated"] and rows[0]["params"][0]["name"] == "x"
    (tmp_path / "t.jsonl").write_text(json.dumps({"choices": [{"message": {"content": "hi"}}]}) + "\nno\n{}\n")
    assert [r["content"] for r in readers.transcript(spark, str(tmp_path / "t.jsonl")).collect()] == ["hi"]
    (tmp_path / "e.jsonl").write_text(json.dumps({"type": "text", "part": {"text": "a"}}) + "\n" + json.dumps({"type": "tool_use", "part": {"state": {"input": {"newString": "code"}}}}) + "\n{}\n")
    assert {r["text"] for r in readers.agent_events(spark, str(tmp_path / "e.jsonl")).collect()} == {"a", "code"}
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("class A:\n    def m(self): pass\ndef f(): pass\n")
    (src / "b.go").write_text("package x\nfunc Run() {}\nfunc (t T) Do() {}\ntype T struct{}\n")
    (src / "node_modules" / "c.py").write_text("def hidden(): pass\n")
    (src / "notes.md").write_text("# T\n")
    found = {(r["kind"], r["name"]) for r in readers.local_symbols(readers.source_tree(spark, str(src))).collect()}
    assert found == {("class", "A"), ("method", "m"), ("function", "f"), ("function", "Run"), ("method", "Do"), ("class", "T")}
    assert readers.docs_folder(spark, str(src)).count() == 1
    files = spark.createDataFrame([("/x/package.json", '{"dependencies":{"react":"^1"},"devDependencies":{"jest":"2"}}'), ("/x/Cargo.toml", '[package]\nname = "p"\n[dependencies]\nserde = "1"\ntokio = { version = "2", features = [] }\n'), ("/x/go.mod", "module m\nrequire github.com/a/b v1.2.3\n"), ("/x/requirements.txt", "numpy==2\n")], "path string, text string")
    assert {(r["library"], r["version"]) for r in readers.manifests(files).collect()} == {("react", "^1"), ("jest", "2"), ("serde", "1"), ("tokio", "2"), ("github.com/a/b", "v1.2.3"), ("numpy", "2")}
    assert one(spark, readers.split_params(F.col("a")), a="x: Map<a, b>, y = (1, 2), z") == ["x: Map<a, b>", "y = (1, 2)", "z"]
    case = tmp_path / "cases" / "01-x"
    case.mkdir(parents=True)
    (case / "expected.json").write_text('{"verdict":"ALLOW"}')
    (case / "meta.json").write_text('{"language":"go","library":"l"}')
    (case / "diff.patch").write_text("+x")
    (case / "after.go").write_text("x")
    assert tuple(readers.eval_cases(spark, str(tmp_path / "cases")).first())[1:] == ("01-x", "+x", "x", "ALLOW", "go", "l")
    (tmp_path / "n.xml").write_text('<class name="Node" inherits="Object"><methods><method name="add_child"/></methods><signals><signal name="ready"/></signals></class>')
    assert {(r["kind"], r["name"]) for r in readers.class_xml(spark, str(tmp_path / "n.xml")).collect()} == {("class", "Node"), ("method", "add_child"), ("signal", "ready")}


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("2026-01-01 00:00:00", 1), ("2026-01-05 00:00:00", 2)], "ts string, n int").withColumn("ts", F.to_timestamp("ts"))
    sinks.append_audit(log, str(tmp_path / "audit"))
    assert [r["n"] for r in sinks.kept_days(spark.read.parquet(str(tmp_path / "audit")), F.to_date(F.lit("2026-01-05")), 2).collect()] == [2]
    results = spark.createDataFrame([(1, True, []), (2, False, ["w", "x"])], "response_id long, clean boolean, warnings array<string>")
    assert tuple(sinks.report(results, str(tmp_path / "r")).first()) == (2, 1, 2)


def test_messages(spark):
    rows = spark.createDataFrame([('{"choices":[{"message":{"content":"a","tool_calls":[{"function":{"name":"w","arguments":"{}"}}]}}]}',), ('{"content":[{"type":"text","text":"b"},{"type":"tool_use","name":"edit","input":{"x":1}}]}',), ("nonsense",)], "body string")
    assert [r[0] for r in rows.select(messages.reply_text(F.col("body"))).collect()] == ["a", "b", ""]
    assert [(r["name"], r["arguments"]) for r in messages.tool_calls(rows, "body").collect()] == [("w", "{}"), ("edit", '{"x":1}')]


def test_headings_end_at_their_level(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\ntext\n## B\nmore\n# C\nend")], "doc long, text string")
    assert [(r["level"], r["heading"], r["body"]) for r in documents.headings(docs).orderBy("seq").collect()] == [(1, "A", "# A\ntext\n## B\nmore"), (2, "B", "## B\nmore"), (1, "C", "# C\nend")]


@pytest.mark.parametrize("language", sorted(lexical.LITERALS))
def test_blanking_keeps_length_and_lines(spark, language):
    for text in ["a = 'x\\'y' # c\n// d\n/* e\n f */ g \"h\"", '"' + "q" * 100_000, "/* " + "* / " * 30_000, '"""' + "\n" * 50_000, "'" * 999, ""]:
        out = spark.createDataFrame([(text,)], "t string").select(lexical.blanked("t", language)).first()[0]
        assert len(out) == len(text) and out.count("\n") == text.count("\n") and all(a in (b, " ") for a, b in zip(out, text))
    assert one(spark, lexical.blanked("t", "c"), t="x /* \"no */ y 'a\\'b' z") == "x           y        z"


def test_long_tool_calls_and_arguments(spark):
    code = "line\\n" * 50_000
    got = one(spark, lexical.tool_call_code("t"), t='{"type":"tool_use","input":{"content":"' + code)
    assert got == "line\n" * 50_000
    assert one(spark, naming.argument_count(F.col("a")), a='"' + "x,y" * 50_000 + '", b') == 2


def test_paths_and_parents(spark):
    text = '{"filePath": "C:\\\\p\\\\src\\\\a.rs"} <parameter name="path">C:/p/lib/b.rs</parameter> read("rel.py") "path": "https://x/y"'
    assert one(spark, lexical.file_paths("t"), t=text) == ["C:/p/src/a.rs", "C:/p/lib/b.rs"]
    assert one(spark, lexical.common_parent(F.array(F.lit("/a/b/c.py"), F.lit("/a/b/d/e.py")))) == "/a/b" and one(spark, lexical.common_parent(F.array().cast("array<string>"))) == ""


def test_difference_keeps_whole_characters(spark):
    d = sessions.difference(F.col("a"), F.col("b"))
    assert one(spark, d, a="hello world", b="hello") == " world"
    assert one(spark, d, a="0123456789x", b="0123456789y") == "x"
    assert one(spark, d, a="abcdefgé", b="abcdefgè") == "abcdefgé"
    assert one(spark, d, a="new", b="") == "new" and one(spark, d, a="zzz", b="yyy") == "zzz"


def chunk_rows(texts, width=23):
    out = []
    for i, words in enumerate(texts):
        body = "".join('data: {"choices":[{"delta":{"content":"%s "}}]}\n\n' % w for w in words) + 'data: {"usage":{"total_tokens":3}}\n\ndata: [DONE]\n\n'
        out += [(i, n, body[n * width : (n + 1) * width]) for n in range(-(-len(body) // width))]
    return out


TEXTS = [["word"] * 5, ["word"] * 30, ["longer-word"] * 200, ["x"] * 260, []]


def test_stream_equals_batch(spark, tmp_path):
    chunks = spark.createDataFrame(chunk_rows(TEXTS), "request_id long, seq int, data string")
    want = sorted(tuple(r) for r in sse.scan_points(sse.deltas(sse.events(chunks))).select("request_id", "scan_no", "event_no", "content_len").collect())
    for k in range(3):
        chunks.where((F.col("seq") >= k * 100) & (F.col("seq") < (k + 1) * 100 if k < 2 else F.lit(True))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sse.scan_stream(stream, idle_ms=None).writeStream.format("memory").queryName("scans").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("scans").collect()) == want and len(want) == 4


def test_state_drops_an_endless_event():
    state, fired = sse.advance(("", 0, 0, False, 0, 0, False), "data: " + "x" * (sse.BUFFER_BYTES + 1))
    assert state[0] == "" and not fired


def test_sessions_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("u", "2026-01-01 00:00:00", "a"), ("u", "2026-01-01 00:20:00", "b"), ("u", "2026-01-01 02:00:00", "c"), ("v", "2026-01-02 00:00:00", "d")], "user string, ts string, symbol string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.session_symbols(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user", "symbol", watermark="10 minutes")
    q = stream.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["symbols"] for r in spark.table("sess").collect()) == [["a", "b"], ["c"]]


def test_entry_module_without_the_subpackage(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['verisieve.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; assert e.llm_queries is None and 'risk_score' in e.queries() and 'op1_quality' not in e.queries()" % str(root)
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=100).returncode == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "t.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "t.txt"))
        assert spark.read.text(str(tmp_path / "t.txt")).rdd.getNumPartitions() > 1
        assert all(r["line"].startswith(f"line {r['number']} ") for r in rows.collect()) and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_code_without_fences(spark):
    rows = [(1, "import pandas\npandas.read_cvs()"), (2, "A long story.\nWith many lines.\nAnd no code.\nAt all here.\nNothing.\nReally."), (3, "\n".join(["Some words first."] * 3 + ["import os", "x = 1;", "def f():", "    return 2"])), (4, "")]
    got = {r["response_id"]: (r["source"], r["code"]) for r in extract.code_or_raw(spark.createDataFrame(rows, "response_id long, content string")).collect()}
    assert got == {1: ("raw", rows[0][1]), 3: ("raw", "import os\nx = 1;\ndef f():\n    return 2")}


def test_guards_and_roots(spark):
    real = lexical.real_code(F.col("a"), extract.CODE_LINE)
    assert one(spark, real, a="import os\nclass A:\n    pass\ndef f():\n    return 1")
    assert not one(spark, real, a="This is prose. It has no code.\nNone at all.")
    assert one(spark, lexical.truncated("a"), a="call(1, [2") and not one(spark, lexical.truncated("a"), a='call("(") # [')
    files = spark.createDataFrame([("/w/Temp/a.py",), ("/w/p/a.test.ts",), ("/w/q/go.mod",), ("C:\\w\\r\\main.rs",), ("/home/me/x.py",)], "path string")
    assert {r["root"] for r in lexical.project_roots(files, "/home/me").collect()} == {"/w/q", "C:/w/r"}
