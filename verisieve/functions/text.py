"""Measures of text as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys over as many tasks as shuffles have, however few its bytes: for rows that cost much more than their size says."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def token_estimate(text: Column) -> Column:
    """A quarter of a token for each ASCII character and one for any other, rounded up."""
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_chars * 0.25 + (F.length(text) - ascii_chars)).cast("long")


def as_bytes(c: Column) -> Column:
    """The text with a character for each of its UTF-8 bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def distance_of_bytes(a: Column, b: Column, cap: int | None = None) -> Column:
    """Edit distance of two texts that :func:`as_bytes` made; with a cap, cap + 1 stands for anything beyond it."""
    if cap is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, cap)
    return F.when(F.abs(F.length(a) - F.length(b)) > cap, cap + 1).when(d < 0, cap + 1).otherwise(d)


def byte_distance(a: Column, b: Column, cap: int | None = None) -> Column:
    """Edit distance over UTF-8 bytes. In a join, convert each side once instead."""
    return distance_of_bytes(as_bytes(a), as_bytes(b), cap)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, ASCII letters in either case."""
    x, y = F.split(F.lower(a), ""), F.split(F.lower(b), "")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & p.isNotNull())
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def delimiter_depth(text: Column, guard: int = 5000) -> Column:
    """Peak depth of unclosed brackets, never below zero and never above the guard."""
    chars = F.split(F.regexp_replace(text, r"[^(){}\[\]]", ""), "")
    step = lambda a, c: F.when(c.isin("(", "{", "["), a + 1).when(c.isin(")", "}", "]"), F.greatest(a - 1, F.lit(0))).otherwise(a)
    return F.least(
        F.aggregate(chars, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda s, c: F.struct(step(s["d"], c).alias("d"), F.greatest(s["m"], step(s["d"], c)).alias("m")), lambda s: s["m"]), F.lit(guard)
    )


def literal(text: str) -> str:
    """A text as a raw string literal of SQL."""
    return "r'" + text.replace("'", r"\x27") + "'"


def all_matches(text: str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in the column ``text``."""
    return F.expr(f"regexp_extract_all({text}, {literal(pattern)}, {group})")
