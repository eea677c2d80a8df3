"""Spans of regular expressions as native column expressions.

A span has ``start`` and ``end`` in code points (end exclusive) and the matched
``value``.  The matches come from ``regexp_extract_all``, the gaps between them
from ``split`` by the same expression; sums of their lengths are the positions.

Costs follow a text's length: positions are summed up block by block, and parts
of a text are cut out of its pieces, not out of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Code points of a piece of a text, and steps that are summed up in one block.
PIECE, BLOCK = 512, 128


def quoted(pattern: str) -> str:
    """``pattern`` as a SQL raw string literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def walk(count: Column, out: str, step: Callable[[Column, Column], Column]) -> Column:
    """What ``count`` steps put out, and how far they came, as struct(at, out).

    ``step`` maps the place reached and a step's number to struct(at, out),
    where ``out``, an array of the type given, is what this step adds.
    """
    empty = F.array().cast(out)

    def one(acc: Column, i: Column) -> Column:
        return bound(step(acc["at"], i), lambda s: F.struct(s["at"].alias("at"), F.concat(acc["out"], s["out"]).alias("out")))

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, count) - 1), F.struct(acc["at"].alias("at"), empty.alias("out")), one)
        return bound(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(acc["out"], F.array(s["out"])).alias("out")))

    blocks = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{out}>").alias("out")), block, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))


def find(text: str, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """The leftmost non-overlapping matches in column ``text`` that are ``valid``, by start.

    Texts without a valid match are not split.
    """
    rx = quoted(pattern)
    matches = F.expr(f"regexp_extract_all({text}, {rx}, 0)")
    gaps = F.expr(f"split({text}, {rx}, -1)")
    empty = F.array().cast(SPAN)

    def step(at: Column, i: Column, m: Column, g: Column) -> Column:
        start = at + F.length(F.get(g, i))
        end = start + F.length(F.get(m, i))
        one = F.struct(start.alias("start"), end.alias("end"), F.get(m, i).alias("value"))
        return F.struct(end.alias("at"), F.when(valid(F.get(m, i)), F.array(one)).otherwise(empty).alias("out"))

    def place(m: Column) -> Column:
        return F.when(F.exists(m, valid), bound(gaps, lambda g: walk(F.size(m), SPAN, lambda at, i: step(at, i, m, g))["out"])).otherwise(empty)

    return bound(matches, place)


def pieces(text: Column) -> Column:
    """A text in pieces of ``PIECE`` code points, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(own: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of a text in pieces; ends beyond the text are its own."""
    low = F.greatest(start, F.lit(0))
    first = F.floor(low / PIECE).cast("int")
    # one piece more than the last code point's is taken, so that none is missed
    count = F.floor(end / PIECE).cast("int") - first + 1
    return F.when(end > low, F.substring(F.array_join(F.slice(own, first + 1, F.greatest(count, F.lit(1))), ""), low % PIECE + 1, end - low)).otherwise(F.lit(""))


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """``spans`` with their kind and its rank: struct(start, rank, kind, end, value)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


_FAR = (1 << 31) - 1


def settled(spans: Column, base: int) -> Column:
    """Labelled spans by start, then rank, without those of rank ``base`` and above that overlap one of a rank below.

    Two passes tell how far the base spans before each one reach, and where the next one after it begins.
    """

    def passed(s: Column, at: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        def step(most: Column, i: Column) -> Column:
            return bound(F.get(s, at(i)), lambda x: F.struct(F.when(x["rank"] < base, F.greatest(most, value(x))).otherwise(most).alias("at"), F.array(most).alias("out")))

        return walk(F.size(s), "array<int>", step)["out"]

    def run(s: Column) -> Column:
        before, after = passed(s, lambda i: i, lambda x: x["end"]), passed(s, lambda i: F.size(s) - 1 - i, lambda x: F.lit(_FAR) - x["start"])
        free = bound(F.struct(before.alias("before"), after.alias("after")), lambda b: F.filter(s, lambda x, i: (x["rank"] < base) | (F.get(b["before"], i) <= x["start"]) & (F.lit(_FAR) - F.get(b["after"], F.size(s) - 1 - i) >= x["end"])))
        return F.when(F.exists(s, lambda x: x["rank"] >= base), free).otherwise(s)

    return bound(F.array_sort(spans), run)


def shown(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
