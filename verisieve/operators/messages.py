"""Requests and replies of chat APIs: classification, usage, content, tool calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases of requests that compact a conversation, groups that must occur together, phrases of background tasks, and the most messages of a short request.
COMPACTION = (
    "summarize the conversation", "compact the conversation", "anchored summary", "context was compacted", "continue if you have next steps", "summarize this conversation", "summarize the following", "compress the context",
    "create a summary of", "here is a summary of the conversation", "previous conversation summary", "summarize chat history",
)
COMPACTION_GROUPS = (("## goal", "## progress", "## key decisions"), ("## critical context", "## relevant files"))
BACKGROUND = ("generate a concise title", "suggest a title", "categorize this", "classify this message", "extract keywords")
SHORT = 3


def classify(messages: DataFrame) -> DataFrame:
    """(conv_id, class) of each request: compaction, background or chat.

    From the last user text and the first system text; a short request without
    tools and streaming whose system text summarises is a background task.
    ``tools`` and ``stream`` count as none where the columns are missing.
    """
    last = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    system = F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn")))
    tools = F.max("tools") if "tools" in messages.columns else F.lit(0)
    stream = F.bool_or("stream") if "stream" in messages.columns else F.lit(False)
    g = messages.groupBy("conv_id").agg(F.coalesce(last, F.lit("")).alias("u"), F.coalesce(system, F.lit("")).alias("s"), F.count("*").alias("turns"), tools.alias("tools_"), stream.alias("stream_"))
    both = F.lower(F.concat_ws("\n", "s", "u"))
    any_of = lambda words: reduce(lambda a, b: a | b, [both.contains(w) for w in words])
    groups = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [both.contains(w) for w in g]) for g in COMPACTION_GROUPS])
    short = (F.col("tools_") == 0) & (F.col("turns") <= SHORT) & ~F.col("stream_") & F.lower("s").rlike("summari|compact")
    return g.select("conv_id", F.when(any_of(COMPACTION) | groups, "compaction").when(any_of(BACKGROUND) | short, "background").otherwise("chat").alias("class"))


def usage(df: DataFrame, column: str) -> DataFrame:
    """Adds prompt, completion and total tokens from either vendor's spelling of a usage object in JSON."""
    u = df.withColumn("_u", F.try_parse_json(F.col(column)))
    get = lambda *paths: F.coalesce(*[F.try_variant_get("_u", f"$.{p}", "bigint") for p in paths], F.lit(0).cast("bigint"))
    out = u.withColumn("prompt", get("prompt_tokens", "input_tokens")).withColumn("completion", get("completion_tokens", "output_tokens"))
    return out.withColumn("total", F.coalesce(F.try_variant_get("_u", "$.total_tokens", "bigint"), F.col("prompt") + F.col("completion"))).drop("_u")


def provider(path: Column) -> Column:
    """Whose API a path belongs to."""
    return F.when(path.contains("/chat/completions") | path.contains("/responses"), "openai").when(path.contains("/messages"), "anthropic").otherwise("unknown")


def reply_text(body: Column) -> Column:
    """The text of a reply in JSON, of either vendor: a string, or its text parts joined."""
    v = F.try_parse_json(body)
    openai = F.try_variant_get(v, "$.choices[0].message.content", "string")
    parts = F.try_variant_get(v, "$.content", "array<struct<type:string,text:string>>")
    return F.coalesce(openai, F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"), F.lit(""))


#: What a reply's tool calls are read by, of either vendor; arguments and inputs stay JSON.
CALLS = "choices array<struct<message:struct<tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>>, content array<struct<type:string,name:string,input:string>>"


def tool_calls(df: DataFrame, body: str) -> DataFrame:
    """A row (name, arguments) for each tool call of a reply, which is parsed once."""
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    called = F.coalesce(F.transform(F.col("_b.choices")[0]["message"]["tool_calls"], lambda c: F.struct(c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments"))), none)
    used = F.coalesce(F.transform(F.filter("_b.content", lambda c: c["type"] == "tool_use"), lambda c: F.struct(c["name"].alias("name"), c["input"].alias("arguments"))), none)
    parsed = df.withColumn("_b", F.from_json(F.col(body), CALLS))
    return parsed.select("*", F.explode(F.concat(called, used)).alias("_c")).select("*", "_c.name", "_c.arguments").drop("_c", "_b")


#: Tools that edit files, argument fields that name them, and suffixes that a compiler reads.
EDIT_TOOLS = ("write", "edit", "multiedit", "create", "apply_patch", "str_replace", "str_replace_editor", "write_file", "edit_file", "create_file", "update_file")
PATH_FIELDS = ("path", "file_path", "filePath", "file", "filename")
COMPILABLE = ("py", "rs", "ts", "tsx", "js", "jsx", "go", "java", "cs", "cpp", "cc", "c", "h", "hpp", "gd")


def edited_files(df: DataFrame, body: str, key: str) -> DataFrame:
    """(key, path) of source files that a reply's tool calls edit, each once."""
    calls = tool_calls(df.select(key, body), body).where(F.lower("name").isin(*EDIT_TOOLS))
    fields = [F.get_json_object("arguments", f"$.{f}") for f in PATH_FIELDS]
    patch = F.nullif(F.regexp_extract(F.get_json_object("arguments", "$.patch"), r"(?m)^(?:\+\+\+ b/|\*\*\* (?:Update|Add) File: )(\S+)", 1), F.lit(""))
    return calls.select(key, F.coalesce(*fields, patch).alias("path")).where(F.col("path").rlike(r"\.(?:" + "|".join(COMPILABLE) + ")$")).distinct()


def gate(request_class: Column, tokens: Column, least: int = 3) -> Column:
    """Whether a reply is scanned: not for compaction and background traffic, and not below a few tokens."""
    return F.when(request_class.isin("compaction", "background"), "skipped-traffic").when(tokens < least, "skipped-short").otherwise("scanned")
