"""Documentation: sections, focused sections, exact gates, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def headings(docs: DataFrame) -> DataFrame:
    """(doc, seq, level, heading, body) of Markdown texts: a section ends at the next heading of its level or above."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n(?=#{1,6} )")
    rows = docs.select("doc", F.concat(F.lit("\n"), "text").alias("text"), F.posexplode(parts).alias("seq", "part"))
    order = Window.partitionBy("doc").orderBy("seq")
    start = F.coalesce(F.sum(F.length("part") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start).where(F.col("part").startswith("#")).withColumn("level", F.length(F.regexp_extract("part", "^#+", 0)))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    stops = F.array(*[F.min(F.when(F.col("level") <= k, F.col("start"))).over(after) for k in range(1, 7)])
    rows = rows.withColumn("stop", F.coalesce(F.element_at(stops, F.col("level")), F.length("text") + 1))
    body = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("stop") - F.col("start") - 1).cast("int"))
    return rows.select("doc", "seq", "level", F.regexp_extract("part", "^#+ *([^\n]*)", 1).alias("heading"), body.alias("body"))


def sections(sections: DataFrame, limit: int = 2000, fallback: int = 500) -> DataFrame:
    """The body of each section up to a limit in characters; without a heading the beginning."""
    return sections.withColumn("body", F.when(F.col("heading") != "", F.substring("body", 1, limit)).otherwise(F.substring("body", 1, fallback)))


def focused(sections: DataFrame, tokens: DataFrame, least: int = 2) -> DataFrame:
    """Sections whose heading has a token of the claim, or whose body has two of them at least."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9_]+"), lambda x: F.length(x) >= 4))
    h = sections.select("doc", "seq", F.explode(words("heading")).alias("token"), F.lit(1).alias("in_heading"))
    b = sections.select("doc", "seq", F.explode(words("body")).alias("token"), F.lit(0).alias("in_heading"))
    hits = h.unionByName(b).join(tokens, "token").groupBy("claim", "doc", "seq").agg(F.max("in_heading").alias("in_heading"), F.count_if(F.col("in_heading") == 0).alias("in_body"))
    return hits.where((F.col("in_heading") == 1) | (F.col("in_body") >= least))


def exact_gate(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """The first section whose heading's first word is a claim's word or its stem (without s, ed or ing)."""
    word = F.lower("word")
    stems = claims.select("claim", F.explode(F.array_distinct(F.array(word, F.regexp_replace(word, "(?:s|ed|ing)$", "")))).alias("key"))
    bases = sections.select("doc", "seq", F.lower(F.regexp_extract("heading", "^([A-Za-z0-9_]+)", 1)).alias("key")).where("key <> ''")
    return stems.join(bases, "key").groupBy("claim").agg(F.min(F.struct("doc", "seq")).alias("m")).select("claim", "m.doc", "m.seq")


def budgeted(snippets: DataFrame, budget: int) -> DataFrame:
    """Snippets of each library in order while tokens last; the one that passes the budget is cut, later ones are left out."""
    w = Window.partitionBy("library").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = snippets.withColumn("tokens", token_estimate(F.col("body"))).withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    left = F.lit(budget) - F.col("before")
    return counted.where(left > 0).withColumn("taken", F.least("tokens", left)).withColumn("truncated", F.col("tokens") > left).drop("before")


def prioritized(symbols: DataFrame, most: int) -> DataFrame:
    """The first symbols of each library: top-level kinds before members."""
    top = F.when(F.col("kind").isin("class", "function", "interface", "enum", "module"), 0).otherwise(1)
    w = Window.partitionBy("library").orderBy(top, "seq")
    return symbols.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
