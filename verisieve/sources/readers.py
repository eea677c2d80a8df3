"""Readers: bundles, logs, transcripts, source trees, manifests, declaration files.

Malformed rows are left out, as a filter on what the parser returns; nothing is
inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARAM = "array<struct<name:string,type_name:string,default_value:string>>"
SYMBOL = "library string, version string, path string, name string, kind string, signature string, params_json string, return_type string, doc_text string, source_file string, visibility string, is_deprecated int, deprecated_message string, extracted_at long"
SCAN_LOG = (
    "ts string, request_id string, phase string, scan_result string, risk_score double, scan_details array<string>, validator_response string, model string, streaming boolean, status int, latency_ms int, "
    "prompt_tokens long, completion_tokens long, reasoning_tokens long, total_tokens long, confidence double"
)
CHAT = "choices array<struct<message:struct<content:string>>>"
CORPUS = "id string, language string, claim_type string, ground_truth string, library string, imports array<string>, code string, prose_claim string, citation string, rationale string, expected_layer string, tags array<string>, vector string, render string"
SOURCE_SUFFIXES = ("py", "rs", "ts", "tsx", "js", "jsx", "go", "java", "cs", "cpp", "cc", "c", "h", "hpp", "gd", "rb", "lua", "php")
SKIPPED_FOLDERS = ("node_modules", "target", ".git", "dist", "build", "vendor", "__pycache__", ".venv")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def json_lines(df: DataFrame, schema: str) -> DataFrame:
    """Objects of the lines that parse; blank lines, comments and others are left out."""
    kept = df.where(F.col("line").rlike(r"^\s*\{"))
    parsed = kept.withColumn("_r", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("_r is not null and _r._bad is null").select("_r.*").drop("_bad")


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a JSONL bundle: rows without a name are dropped, parameters parsed."""
    rows = json_lines(lines(spark, path), SYMBOL).where("name is not null and name <> ''")
    return rows.withColumn("params", F.from_json("params_json", PARAM)).withColumn("is_deprecated", F.coalesce(F.col("is_deprecated") == 1, F.lit(False))).drop("params_json")


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the scan log; confidence is 1 where it lacks."""
    return json_lines(lines(spark, path), SCAN_LOG).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line): lines with their numbers from 0 on, however a file is split for reading.

    Lines are counted split by split; only the counts are summed up over a file.
    """
    rows = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    split = rows.withColumnsRenamed({"file_path": "file", "file_block_start": "block"})
    within = split.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("id")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy("file", "block").agg(F.count("*").alias("size")).select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return within.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("n") - 1).alias("number"), "line")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, content) of chat completions, one a line, with the number of the line; rows without content are left out."""
    rows = numbered_lines(spark, path).withColumn("content", F.from_json("line", CHAT)["choices"][0]["message"]["content"])
    return rows.where("content is not null and content <> ''").select("file", "number", "content")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples; the ground truth in lower case, and the text under test."""
    rows = json_lines(lines(spark, path), CORPUS)
    return rows.withColumn("ground_truth", F.lower("ground_truth")).withColumn("rendered", F.concat(F.lit("```"), "language", F.lit("\n"), "code", F.lit("\n```\n\n"), F.coalesce("prose_claim", F.lit(""))))


def agent_events(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of agent events: text parts, and the code of tool uses."""
    return event_texts(lines(spark, path).withColumn("file", F.input_file_name())).select("file", "text")


def event_texts(rows: DataFrame) -> DataFrame:
    """Adds the text of each event (line); others are left out."""
    v = F.try_parse_json(F.col("line"))
    get = lambda p: F.try_variant_get(v, p, "string")
    code = F.coalesce(get("$.part.state.input.content"), get("$.part.state.input.newString"), get("$.part.state.input.command"))
    return rows.withColumn("text", F.when(get("$.type") == "text", get("$.part.text")).when(get("$.type") == "tool_use", code)).where("text is not null")


def files_below(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def source_tree(spark: SparkSession, root: str, suffixes: Sequence[str] = SOURCE_SUFFIXES, most: int | None = None) -> DataFrame:
    """(path, suffix, modified, text) of source files below a folder, by path; generated folders are skipped."""
    return sources(files_below(spark, root, "*.{" + ",".join(suffixes) + "}"), suffixes, most)


def sources(files: DataFrame, suffixes: Sequence[str] = SOURCE_SUFFIXES, most: int | None = None) -> DataFrame:
    """The source files among ``files``."""
    skipped = "/(?:" + "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS) + ")/"
    rows = files.where(~F.col("path").rlike(skipped) & F.col("path").rlike(r"\.(?:" + "|".join(suffixes) + ")$")).select("path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    return rows if most is None else rows.orderBy("path").limit(most)


def docs_folder(spark: SparkSession, root: str, cap: int = 10_240) -> DataFrame:
    """(path, text) of Markdown and text files, the first bytes of each; hidden folders are skipped."""
    return docs(files_below(spark, root, "*.{md,txt}"), cap)


def docs(files: DataFrame, cap: int = 10_240) -> DataFrame:
    """The documentation among ``files``."""
    return files.where(~F.col("path").rlike(r"/\.[^/]+/") & F.col("path").rlike(r"\.(?:md|txt)$")).select("path", F.decode(F.substring("content", 1, cap), "UTF-8").alias("text"))


def manifests(files: DataFrame) -> DataFrame:
    """(path, language, library, version) of dependencies in package.json, Cargo.toml, go.mod and requirements files."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pair = lambda rx: F.transform(F.expr(f"regexp_extract_all(text, r'{rx}', 0)"), lambda m: F.struct(F.regexp_extract(m, rx, 1).alias("library"), F.regexp_extract(m, rx, 2).alias("version")))
    node = F.flatten(F.transform(F.array("dependencies", "devDependencies"), lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("library"), e["value"].alias("version")))))
    package = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.withColumn("_p", package).withColumn("dependencies", F.col("_p.dependencies")).withColumn("devDependencies", F.col("_p.devDependencies"))
    section = F.regexp_extract("text", r"(?s)\[dependencies\]\n(.*?)(?:\n\[|$)", 1)
    rows = rows.withColumn("text", F.when(name == "Cargo.toml", section).otherwise(F.col("text")))
    found = F.when(name == "package.json", node).when(name == "Cargo.toml", pair(r'(?m)^([a-zA-Z0-9_-]+)\s*=\s*(?:\{[^}\n]*version\s*=\s*)?"([^"]*)"')).when(name == "go.mod", pair(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[^\s]+)")).when(name.rlike("^requirements.*txt$"), pair(r"(?m)^([A-Za-z0-9._-]+)\s*(?:[=<>~!]=\s*([^\s;#]*))?"))
    language = F.when(name == "package.json", "typescript").when(name == "Cargo.toml", "rust").when(name == "go.mod", "go").otherwise("python")
    return rows.select("path", language.alias("language"), F.explode(found).alias("d")).select("path", "language", "d.library", "d.version").where("library <> ''")


#: Declarations of local sources: language, kind, pattern, group.
DECLARATIONS = (
    ("py", "class", r"(?m)^class\s+([A-Za-z_]\w*)"),
    ("py", "function", r"(?m)^(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    ("py", "method", r"(?m)^[ \t]+(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    ("rs", "class", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)"),
    ("rs", "function", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)"),
    ("ts", "class", r"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?(?:abstract\s+)?(?:class|interface)\s+([A-Za-z_$][\w$]*)"),
    ("ts", "function", r"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("ts", "constant", r"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?const\s+([A-Za-z_$][\w$]*)"),
    ("ts", "type_alias", r"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+([A-Za-z_$][\w$]*)"),
    ("go", "function", r"(?m)^func\s+([A-Za-z_]\w*)"),
    ("go", "method", r"(?m)^func\s+\([^)]*\)\s+([A-Za-z_]\w*)"),
    ("go", "class", r"(?m)^type\s+([A-Za-z_]\w*)"),
    ("java", "class", r"(?m)^[ \t]*(?:public\s+|abstract\s+|final\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"),
    ("java", "method", r"(?m)^[ \t]+(?:public|protected|private)\s+(?:static\s+|final\s+)*[\w<>\[\], ]+\s+([a-z]\w*)\s*\("),
    ("cs", "class", r"(?m)^[ \t]*(?:public\s+|internal\s+|static\s+|abstract\s+|sealed\s+|partial\s+)*(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)"),
    ("cs", "method", r"(?m)^[ \t]+(?:public|protected|private|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\], ?]+\s+([A-Z]\w*)\s*\("),
    ("gd", "class", r"(?m)^class_name\s+([A-Za-z_]\w*)"),
    ("gd", "method", r"(?m)^(?:static\s+)?func\s+([A-Za-z_]\w*)"),
    ("gd", "signal", r"(?m)^signal\s+([A-Za-z_]\w*)"),
    ("rb", "class", r"(?m)^[ \t]*(?:class|module)\s+([A-Z]\w*)"),
    ("rb", "method", r"(?m)^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"),
    ("lua", "function", r"(?m)^[ \t]*(?:local\s+)?function\s+([A-Za-z_][\w.:]*)"),
    ("php", "class", r"(?m)^[ \t]*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+([A-Za-z_]\w*)"),
    ("php", "function", r"(?m)^[ \t]*(?:public\s+|protected\s+|private\s+|static\s+)*function\s+([A-Za-z_]\w*)"),
)
ALIASES = {"tsx": "ts", "js": "ts", "jsx": "ts", "d.ts": "ts"}


def local_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name) of declarations in source files, by the patterns of their language, in one pass."""

    def found(language: str, kind: str, rx: str) -> Column:
        names = F.expr("regexp_extract_all(text, r'" + rx.replace("'", r"\x27") + "', 1)")
        rows = F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
        return F.when(F.col("_language") == language, rows).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))

    language = F.col("suffix")
    for a, b in ALIASES.items():
        language = F.when(F.col("suffix") == a, b).otherwise(language)
    rows = files.withColumn("_language", language)
    return rows.select("path", F.explode(F.concat(*[found(*d) for d in DECLARATIONS])).alias("d")).select("path", "d.*").distinct()


def split_params(text: Column) -> Column:
    """Parameters at the top level of a list: commas within brackets do not part them."""
    depth = lambda a, c: F.when(c.isin("(", "[", "{", "<"), a["depth"] + 1).when(c.isin(")", "]", "}", ">"), F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])

    def step(a: Column, c: Column) -> Column:
        cut = (c == ",") & (a["depth"] == 0)
        return F.struct(depth(a, c).alias("depth"), F.when(cut, F.concat(a["out"], F.array(F.trim(a["now"])))).otherwise(a["out"]).alias("out"), F.when(cut, F.lit("")).otherwise(F.concat(a["now"], c)).alias("now"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))
    return F.aggregate(F.split(text, ""), start, step, lambda a: F.filter(F.concat(a["out"], F.array(F.trim(a["now"]))), lambda p: p != ""))


def rustdoc(files: DataFrame) -> DataFrame:
    """(library, kind, name, docs) of a rustdoc JSON's index."""
    body = F.from_json("text", "index map<string,struct<name:string,docs:string,visibility:string,inner:map<string,string>>>, crate_version string")
    rows = files.select("path", F.explode(body["index"]).alias("id", "item")).where("item.name is not null")
    kind = F.map_keys("item.inner")[0]
    return rows.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("library"), F.when(kind.isin("struct", "trait", "union"), "class").when(kind.isin("function", "enum", "constant", "module", "type_alias"), kind).otherwise("method").alias("kind"), F.col("item.name").alias("name"), F.col("item.docs").alias("docs"))


def class_xml(spark: SparkSession, path: str) -> DataFrame:
    """(class, kind, name) of engine class descriptions in XML, one a file."""
    return class_members(files_below(spark, path).select(F.decode("content", "UTF-8").alias("text")))


def class_members(files: DataFrame) -> DataFrame:
    """The classes and members of descriptions (text)."""
    member = "array<struct<_name:string>>"
    schema = f"_name string, _inherits string, methods struct<method:{member}>, members struct<member:{member}>, signals struct<signal:{member}>, constants struct<constant:{member}>"
    rows = files.select(F.from_xml("text", schema).alias("c")).select("c.*")
    each = lambda col, kind: F.transform(F.coalesce(F.col(col), F.array().cast(member)), lambda m: F.struct(F.lit(kind).alias("kind"), m["_name"].alias("name")))
    parts = F.concat(each("methods.method", "method"), each("members.member", "property"), each("signals.signal", "signal"), each("constants.constant", "constant"))
    members = rows.select(F.col("_name").alias("class"), F.explode(parts).alias("m")).select("class", "m.*")
    return rows.select(F.col("_name").alias("class"), F.lit("class").alias("kind"), F.col("_name").alias("name")).unionByName(members)


def fresh_docs(raw: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The newest copy of each fetched document that is not too old (source, library, version, body, fetched_at)."""
    alive = raw.where(F.col("fetched_at") > now - F.expr(f"INTERVAL {hours} HOURS"))
    return alive.groupBy("source", "library", "version").agg(F.max_by("body", "fetched_at").alias("body"), F.max("fetched_at").alias("fetched_at"))


def input_kind(source: Column) -> Column:
    """What an input names: npm:…, github:… or a repository, context7:…, a url, or a path."""
    return (
        F.when(source.startswith("npm:"), "npm").when(source.startswith("github:") | source.rlike(r"^https?://github\.com/[^/]+/[^/]+/?$"), "github").when(source.startswith("context7:"), "context7").when(source.rlike("^https?://"), "url").otherwise("path")
    )


def eval_cases(spark: SparkSession, root: str) -> DataFrame:
    """A row for each numbered case folder: diff, after_content, verdict, language, library."""
    return cases(files_below(spark, root))


def cases(files: DataFrame) -> DataFrame:
    """The numbered case folders among ``files``."""
    rows = files.select(F.regexp_extract("path", r"/([^/]+)/(\d+[^/]*)/[^/]+$", 1).alias("corpus"), F.regexp_extract("path", r"/(\d+[^/]*)/[^/]+$", 1).alias("case_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.decode("content", "UTF-8").alias("text")).where("case_id <> ''")
    pick = lambda rx: F.max(F.when(F.col("file").rlike(rx), F.col("text")))
    g = rows.groupBy("corpus", "case_id").agg(pick(r"^diff\.patch$").alias("diff"), pick(r"^after\.").alias("after_content"), pick(r"^expected\.json$").alias("expected"), pick(r"^meta\.json$").alias("meta"))
    return g.select("corpus", "case_id", "diff", "after_content", F.get_json_object("expected", "$.verdict").alias("verdict"), F.get_json_object("meta", "$.language").alias("language"), F.get_json_object("meta", "$.library").alias("library"))
