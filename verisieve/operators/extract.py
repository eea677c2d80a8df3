"""Extraction from texts by pattern tables, in one pass over each text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_matches
from . import patterns as P
from .lexical import tool_call_code

FENCE = r"\n[ \t]*```"


def extract(df: DataFrame, text: str, table: Sequence[tuple[str, str, int]]) -> DataFrame:
    """A row (kind, priority, position, value) for each match of each pattern; the other columns stay."""

    def found(n: int, kind: str, rx: str, group: int) -> Column:
        return F.transform(all_matches(text, rx, group), lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("priority"), i.alias("position"), x.alias("value")))

    rows = [found(n, *row) for n, row in enumerate(table)]
    return df.select("*", F.explode(F.concat(*rows)).alias("_m")).drop(text).select("*", "_m.*").drop("_m")


def first_seen(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal rows by their keys once, in the place of the first."""
    return df.groupBy(*keys).agg(F.min(F.struct("priority", "position")).alias("at"))


def stripped(content: Column) -> Column:
    """Without tool outputs, large JSON and XML fences, and usage fields."""
    out = F.regexp_replace(content, r"(?s)<tool_(?:result|response)>.*?</tool_(?:result|response)>", "[tool output stripped]")
    out = F.regexp_replace(out, r"(?s)```(?:json|xml)\n(.{500,}?)```", "[large code block stripped]")
    names = "prompt_tokens|completion_tokens|total_tokens|reasoning_tokens|cached_tokens|prompt_tokens_details|completion_tokens_details|system_fingerprint|finish_reason"
    return F.regexp_replace(out, rf'"(?:{names})":\s*[\d"a-z_]+', "")


def fences(content: Column) -> Column:
    """The closed fenced blocks: array of (tag, body). An unclosed one is left out."""
    parts = F.split(F.concat(F.lit("\n"), content), FENCE, -1)
    closed = F.filter(parts, lambda x, i: (i % 2 == 1) & (i < F.size(parts) - 1))
    tag = lambda x: F.regexp_extract(x, r"^`*[ \t]*([^\s,]*)", 1)
    return F.transform(closed, lambda x: F.struct(tag(x).alias("tag"), F.regexp_replace(x, r"^[^\n]*\n?", "").alias("body")))


def prose(content: Column) -> Column:
    """The text outside fences, its parts joined by line breaks."""
    parts = F.split(F.concat(F.lit("\n"), content), FENCE, -1)
    outside = F.filter(parts, lambda x, i: i % 2 == 0)
    return F.array_join(F.transform(outside, lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(x, r"^[^\n]*", ""))), "\n")


#: Patterns of the code score, with their points.
SCORE = (
    (r"(?m)^[ \t]*(?:import|from|use|using|#include|package|require)\b", 3),
    (r"(?m)^[ \t]*(?:pub[ \t]+|public[ \t]+|private[ \t]+|static[ \t]+|async[ \t]+|export[ \t]+)*(?:def|fn|func|function|class|struct|enum|trait|interface|impl)[ \t]", 3),
    (r"(?m)^[ \t]*(?:\[gd_scene|\[node|shader_type|extends[ \t])", 3),
)
#: What a line of code looks like.
CODE_LINE = (
    r"^[ \t]*(?:$|(?:import|from|use|using|def|fn|func|function|class|struct|enum|trait|impl|interface|let|const|var|if|else|elif|for|while|return|match|switch|case|try|except|catch|finally|with|pub|public|private|static|async|await|export|"
    r"package|raise|throw|yield|break|continue|pass|type|mod|extends|signal|@|#|//|/\*|\*|<!--)(?:\W|$).*|.*(?:::|=>|->|&&|\|\||== |!= |\+=|-=|\*=).*|[()\[\]{}]+[;,]?[ \t]*|.*[;{}][ \t]*|[A-Za-z_][\w.\[\]]*[ \t]*=[^=].*[^.]|"
    r"""[\[{"'].*|[a-z_][\w.]*\(.*|\.[A-Za-z_].*|[A-Za-z_]\w*,)$"""
)


def count(text: Column, pattern: str) -> Column:
    return F.size(F.split(text, pattern, -1)) - 1


def code_score(block: Column) -> Column:
    """Points for what makes a block code; three are enough."""
    score = reduce(lambda a, p: a + F.when(block.rlike(p[0]), p[1]).otherwise(0), SCORE, F.lit(0))
    for mark in ("=>", "::", "->"):
        score = score + F.when(block.contains(mark), 1).otherwise(0)
    score = score + F.when(count(block, r"(?m)^[^.\n]*\.[A-Za-z]") >= 2, 1).otherwise(0)
    return score + F.when(count(block, ";") >= 3, 1).otherwise(0) + F.when(count(block, r"[{}]") >= 4, 1).otherwise(0)


def accepted(block: Column) -> Column:
    """Two lines at most, a code score of three, or half of the lines like code."""
    lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
    code = F.filter(lines, lambda x: x.rlike(CODE_LINE))
    return (F.size(lines) > 0) & ((F.size(lines) <= 2) | (code_score(block) >= 3) | (F.size(code) * 2 >= F.size(lines)))


def code_blocks(responses: DataFrame) -> DataFrame:
    """The accepted blocks of each response: (…, block_no, tag, body)."""
    blocks = responses.select("*", F.posexplode(fences(F.col("content"))).alias("block_no", "b")).select("*", "b.*").drop("b", "content")
    return blocks.where(((F.col("tag") == "") | F.col("tag").isin(*P.CODE_TAGS)) & ~F.col("tag").isin(*P.PROSE_TAGS) & accepted(F.col("body")))


def fenced_code(content: Column) -> Column:
    """The accepted blocks of a response in order, joined; empty without any."""
    fit = lambda b: ((b["tag"] == "") | b["tag"].isin(*P.CODE_TAGS)) & ~b["tag"].isin(*P.PROSE_TAGS) & accepted(b["body"])
    return F.array_join(F.transform(F.filter(fences(content), fit), lambda b: b["body"]), "")


def raw_code(content: Column) -> Column:
    """A response without fences that looks like code: whole if it is short, else its lines of code where enough of them survive."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    code = F.filter(lines, lambda x: x.rlike(CODE_LINE))
    n, kept = F.size(lines), F.size(code)
    enough = ((kept == n) & (kept > 0)) | ((kept >= 3) & (kept * 2 >= n)) | (kept >= 50)
    return F.when(code_score(content) < 3, "").when(n <= 5, content).when(enough, F.array_join(code, "\n")).otherwise("")


def code_of(responses: DataFrame) -> DataFrame:
    """Each response's code: its accepted blocks in order. Nothing is shuffled.

    The filter stands in a generator, so that it is not pushed below the
    expression and evaluates it again.
    """
    return responses.select("response_id", F.explode(F.filter(F.array(fenced_code(F.col("content"))), lambda c: c != "")).alias("code"))


def code_or_raw(responses: DataFrame) -> DataFrame:
    """Each response's code with what it was taken from: its fences, else the code of tool calls, else its raw lines."""
    rows = responses.select("response_id", "content", F.explode(F.array(fenced_code(F.col("content")))).alias("fenced"))
    found = lambda source, code: F.struct(F.lit(source).alias("source"), code.alias("code"))
    called = tool_call_code("content")
    other = F.when(called != "", found("tool call", called)).otherwise(found("raw", raw_code(F.col("content"))))
    one = F.when(F.col("fenced") != "", found("fences", F.col("fenced"))).otherwise(other)
    return rows.select("response_id", F.explode(F.filter(F.array(one), lambda x: x["code"] != "")).alias("x")).select("response_id", "x.source", "x.code")


def local_variables(code: DataFrame) -> DataFrame:
    """(response_id, name) of variables that the code declares."""
    found = extract(code, "code", P.VARIABLES)
    many = F.col("kind").isin("parameter", "destructured")
    names = found.select("response_id", "kind", F.explode(F.when(many, F.split("value", r"[,{}\[\]]")).otherwise(F.array(F.regexp_replace("value", "-", "_")))).alias("name"))
    clean = F.when(F.col("kind") == "destructured", F.regexp_replace(F.trim("name"), r"\s*:.*$", "")).otherwise(F.regexp_replace(F.trim("name"), r"^(?:const |let )*(?:\.\.\.)?", ""))
    return names.select("response_id", F.trim(clean).alias("name")).where(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).distinct()


def api_claims(code: DataFrame) -> DataFrame:
    """(response_id, kind, claim): calls and imports that the code makes, without skipped names and calls on its own variables."""
    found = extract(code, "code", P.CLAIMS)
    call = F.regexp_replace("value", r"^[^a-zA-Z_]", "")
    dotted = F.col("kind").isin("class_method", "obj_method")
    rows = found.select(
        "response_id", "kind", "priority", "position", F.when(dotted, F.substring_index(call, ".", 1)).when(F.col("kind") == "bare_call", F.col("value")).alias("object"), F.when(F.col("kind") == "obj_method", F.regexp_extract(call, r"\.(\w+)\($", 1)).alias("method"), F.when(dotted, call).when(F.col("kind") == "bare_call", F.concat("value", F.lit("("))).otherwise(F.concat(F.lit("from '"), "value", F.lit("'"))).alias("claim"), "value"
    )
    skipped = F.coalesce(F.col("object").isin(*P.SKIP_NAMES), F.lit(False)) | F.coalesce(F.col("method").isin(*P.SKIP_NAMES) | F.col("method").rlike("^(?:is|has)_"), F.lit(False))
    rows = rows.where(~skipped & ~((F.col("kind") == "import") & F.col("value").rlike("^[./]")))
    own = local_variables(code).select("response_id", F.col("name").alias("object"), F.lit("obj_method").alias("kind"))
    return first_seen(rows.join(own, ["response_id", "object", "kind"], "left_anti"), ["response_id", "kind", "claim"]).drop("at")


def lookup_terms(code: DataFrame) -> DataFrame:
    """(response_id, term): imported names in lower case; two segments of dotted Java and C# names, the last of a Go path."""
    found = extract(code, "code", P.LIBRARIES)
    term = F.when(F.col("kind").isin("java", "csharp"), F.substring_index("value", ".", 2)).when(F.col("kind") == "go", F.substring_index("value", "/", -1)).when(F.col("kind") == "python", F.substring_index("value", ".", 1)).otherwise(F.col("value"))
    return found.select("response_id", F.lower(term).alias("term")).distinct()


def libraries(code: DataFrame) -> DataFrame:
    """(response_id, language, library): normalised, without standard libraries."""
    found = extract(code, "code", P.LIBRARIES)
    scoped = F.regexp_extract("value", "^(@[^/]+/[^/]+|[^/]+)", 1)
    name = F.when(F.col("kind") == "python", F.substring_index("value", ".", 1)).when(F.col("kind") == "typescript", scoped).when(F.col("kind") == "java", F.substring_index("value", ".", 3)).otherwise(F.col("value"))
    return found.select("response_id", F.col("kind").alias("language"), name.alias("library")).where(~F.col("library").isin(*P.STANDARD) & ~F.col("library").rlike("^[./]")).distinct()


def language(content: Column) -> Column:
    """The language of a response: a known fence tag first, then distinctive parts, then the scores."""
    tag = F.lower(F.regexp_extract(content, r"```(\w+)", 1))
    out = F.when(F.lit(False), F.lit(""))
    for name, tags in P.TAG_LANGUAGE.items():
        out = out.when(tag.isin(*tags), name)
    for name, parts in P.DISTINCTIVE:
        out = out.when(reduce(lambda a, b: a & b, [content.contains(p) for p in parts]), name)
    score = lambda signals: reduce(lambda a, s: a + F.when(content.contains(s[0]), s[1]).otherwise(0), signals, F.lit(0))
    python, typescript = score(P.PYTHON_SIGNALS), score(P.TYPESCRIPT_SIGNALS)
    return out.when((python >= P.PYTHON_LEAST) & (python > typescript), "python").when(typescript >= P.TYPESCRIPT_LEAST, "typescript").otherwise("unknown")


def scope(code: DataFrame) -> DataFrame:
    """(response_id, var, type): the type of the last pattern, and its last match, that names a variable."""

    def pairs(n: int, rx: str, var: int, kind: int) -> Column:
        both = F.zip_with(all_matches("code", rx, var), all_matches("code", rx, kind), lambda v, t: F.struct(v.alias("var"), F.trim(F.regexp_replace(t, "<.*$", "")).alias("type")))
        return F.transform(both, lambda x, i: F.struct(F.lit(n).alias("priority"), i.alias("position"), x["var"].alias("var"), x["type"].alias("type")))

    rows = [pairs(n, *row[1:]) for n, row in enumerate(P.SCOPE)]
    found = code.select("response_id", F.explode(F.concat(*rows)).alias("m")).select("response_id", "m.*")
    return found.groupBy("response_id", "var").agg(F.max_by("type", F.struct("priority", "position")).alias("type"))


def sentences(responses: DataFrame) -> DataFrame:
    """(response_id, seq, sentence): chunks of prose of 12 to 280 bytes with a space, outside fences."""
    lines = F.split(prose(F.col("content")), r"[\n.;]")
    rows = responses.select("response_id", F.posexplode(lines).alias("seq", "s")).select("response_id", "seq", F.trim("s").alias("sentence"))
    return rows.where(F.octet_length("sentence").between(12, 280) & F.col("sentence").contains(" "))


def first_claims(rows: DataFrame, most: int = 8) -> DataFrame:
    w = Window.partitionBy("response_id").orderBy("seq")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("response_id", "n", F.concat("sentence", F.lit(".")).alias("claim"))


def prose_claims(responses: DataFrame) -> DataFrame:
    """The first eight sentences of each response that claim a behaviour."""
    return first_claims(sentences(responses).where(F.lower("sentence").rlike("|".join(P.TRIGGERS))))


def identifiers(code: DataFrame) -> DataFrame:
    """(response_id, name) of identifiers of four letters at least in the code, in lower case."""
    return code.select("response_id", F.explode(all_matches("code", r"[A-Za-z_][A-Za-z0-9_]{3,}", 0)).alias("name")).select("response_id", F.lower("name").alias("name")).where(~F.col("name").isin(*P.COMMON)).distinct()


def anchored_claims(responses: DataFrame, code: DataFrame) -> DataFrame:
    """The first eight sentences that mention an identifier of the response's code, by an equi join on words."""
    words = sentences(responses).select("response_id", "seq", "sentence", F.explode(F.array_distinct(all_matches("lower(sentence)", r"[a-z0-9_]{4,}", 0))).alias("name"))
    return first_claims(words.join(identifiers(code), ["response_id", "name"], "left_semi").select("response_id", "seq", "sentence").distinct())


def recursive(content: Column, lang: Column) -> Column:
    """Whether a function's name, with a bracket behind it, stands in two lines at least."""
    lines = F.split(content, "\n")
    named = lambda rx: F.regexp_extract_all(content, F.lit(rf"(?m)^[ \t]*{rx} ([A-Za-z0-9_]{{2,}})"), F.lit(1))
    names = reduce(lambda rest, p: F.when(lang == p[0], named(p[1])).otherwise(rest), P.FUNCTIONS.items(), F.array().cast("array<string>"))
    return F.exists(names, lambda n: F.size(F.filter(lines, lambda x: F.contains(x, F.concat(n, F.lit("("))))) >= 2)


def signals(responses: DataFrame) -> DataFrame:
    """(response_id, kind) of behavioural signals in each response."""
    code, lang = F.col("content"), F.col("lang_")
    has = lambda parts: reduce(lambda a, b: a | b, [code.contains(p) for p in parts])
    kinds = [F.when(has(parts) & (F.lit(True) if not languages else lang.isin(*languages)), kind) for kind, languages, parts in P.SIGNALS]
    kinds += [F.when(lang.isin(*languages) & has(first) & has(second), "event-loop-blocking") for languages, first, second in P.BLOCKING]
    awaited = F.regexp_extract_all(code, F.lit(P.AWAITED), F.lit(1))
    guarded = F.regexp_extract_all(code, F.lit(P.GUARDED), F.lit(1))
    allocations = reduce(lambda a, b: a + b, [count(code, rf"{x}\(") for x in ("malloc", "calloc", "realloc")])
    kinds += [
        F.when(recursive(code, lang), "recursion"),
        F.when((lang == "typescript") & code.contains("Promise") & ~code.contains("await"), "unhandled-promise"),
        F.when(lang.isin("csharp", "typescript") & F.exists(awaited, lambda n: (F.length(n) >= 3) & ~n.endswith("Async")), "async-sync-mismatch"),
        F.when(lang.isin("c", "cpp") & (allocations > count(code, r"free\(")), "memory-leak"),
        F.when((lang == "cpp") & F.exists(guarded, lambda m: F.contains(code, F.concat(m, F.lit(".lock()")))), "double-lock"),
        F.when((lang == "cpp") & code.rlike(P.CAST), "c-style-cast"),
    ]
    found = F.array_distinct(F.filter(F.array(*kinds), lambda x: x.isNotNull()))
    return responses.withColumn("lang_", language(code)).select("response_id", F.explode(found).alias("kind"))


def foreign_definitions(responses: DataFrame, primary: str) -> DataFrame:
    """(response_id, tag, name) defined in fences of another language than the primary one."""
    blocks = responses.select("response_id", F.explode(fences(F.col("content"))).alias("b")).select("response_id", "b.tag", F.col("b.body").alias("body")).where((F.col("tag") != primary) & (F.col("tag") != ""))
    return extract(blocks, "body", P.DEFINITIONS).select("response_id", "tag", F.col("value").alias("name")).distinct()


def index_entries(code: DataFrame) -> DataFrame:
    """(response_id, kind, name) of what the code declares, imports and binds, without skipped names."""
    return extract(code, "code", P.INDEX).where(~F.col("value").isin(*P.SKIP_NAMES)).select("response_id", "kind", F.col("value").alias("name")).distinct()


def undefined_names(code: DataFrame) -> DataFrame:
    """(response_id, name): names referenced as arguments that the code neither defines nor calls."""
    arguments = code.select("response_id", F.explode(all_matches("code", r"\(([^()]*)\)", 1)).alias("list")).select("response_id", F.explode(F.split("list", ",")).alias("name"))
    used = arguments.select("response_id", F.trim("name").alias("name")).where(F.col("name").rlike("^[a-z_][a-z0-9_]{2,}$")).distinct()
    called = code.select("response_id", F.explode(all_matches("code", r"([A-Za-z_]\w*)[ \t]*\(", 1)).alias("name")).distinct()
    defined = local_variables(code).unionByName(extract(code, "code", P.INDEX).select("response_id", F.col("value").alias("name"))).unionByName(called)
    return used.where(~F.col("name").isin(*P.SKIP_NAMES)).join(defined, ["response_id", "name"], "left_anti")
