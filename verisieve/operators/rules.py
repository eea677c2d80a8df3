"""Language rules: names and calls of code against evidence, as warnings.

Python code is read by Python's own parser in an Arrow batch; every other rule
is a join of extracted calls with evidence tables.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_distance, spread
from . import patterns as P

FACTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("receiver", T.StringType()), T.StructField("name", T.StringType()), T.StructField("arguments", T.IntegerType()), T.StructField("line", T.IntegerType())]))
_BUILTINS = frozenset((*P.PYTHON_NAMES, *P.ERROR_NAMES, "__name__", "__file__", "__doc__", "NotImplemented", "Ellipsis", "Warning", "DeprecationWarning", "UserWarning", "FutureWarning"))


#: Codes whose facts a task remembers.
REMEMBERED = 10_000


def python_facts(code: str | None) -> list[tuple]:
    """(kind, receiver, name, arguments, line) of a module's imports, calls, definitions and undefined names; nothing where it does not parse."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    facts: list[tuple] = []
    defined, used = set(_BUILTINS), {}
    for node in ast.walk(tree):
        line = getattr(node, "lineno", 0)
        if isinstance(node, ast.Import):
            for a in node.names:
                facts.append(("import", "", a.name, 0, line))
                defined.add((a.asname or a.name).split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                facts.append(("import_from", node.module or "", a.name, 0, line))
                defined.add(a.asname or a.name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            facts.append(("class" if isinstance(node, ast.ClassDef) else "function", "", node.name, len(node.args.args) if not isinstance(node, ast.ClassDef) else 0, line))
            defined.add(node.name)
        elif isinstance(node, ast.arg):
            defined.add(node.arg)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            defined.add(node.name)
        elif isinstance(node, ast.Call):
            n = len(node.args) + len(node.keywords)
            if isinstance(node.func, ast.Attribute):
                owner = node.func.value
                facts.append(("method_call", owner.id if isinstance(owner, ast.Name) else "", node.func.attr, n, line))
            elif isinstance(node.func, ast.Name):
                facts.append(("call", "", node.func.id, n, line))
        elif isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load):
                used.setdefault(node.id, line)
            else:
                defined.add(node.id)
    return facts + [("undefined", "", n, 0, line) for n, line in sorted(used.items()) if n not in defined]


@F.pandas_udf(FACTS)
def _facts(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names, memory = ("kind", "receiver", "name", "arguments", "line"), {}

    def known(code: str | None) -> list[dict]:
        if code not in memory:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[code] = [dict(zip(names, f)) for f in python_facts(code)]
        return memory[code]

    for c in codes:
        yield pd.Series([known(x) for x in c], dtype=object)


def python(code: DataFrame) -> DataFrame:
    """A row for each fact of Python code (response_id, code)."""
    return code.select("response_id", F.explode(_facts("code")).alias("f")).select("response_id", "f.*")


def warn(kind: str, name: Column, detail: str) -> Column:
    return F.concat(F.lit(f"{kind}: `"), name, F.lit(f"` {detail}"))


def undefined_variables(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'undefined'").select("response_id", warn("hallucinated-variable", F.col("name"), "is not defined").alias("warning"))


def imports(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Names imported from modules whose members (module, name) are known and lack them; others stay unknown."""
    named = facts.where("kind = 'import_from' and name <> '*'").select("response_id", F.col("receiver").alias("module"), "name")
    missing = named.join(members.select("module").distinct(), "module", "left_semi").join(members, ["module", "name"], "left_anti")
    return missing.select("response_id", warn("hallucinated-import", F.concat_ws(".", "module", "name"), "not found").alias("warning"))


def module_methods(facts: DataFrame, members: DataFrame, cap: int = 4) -> DataFrame:
    """Calls module.name where the module is imported and known and lacks the name, with the nearest name within four bytes."""
    modules = facts.where("kind = 'import'").select("response_id", F.col("name").alias("module")).distinct()
    calls = facts.where("kind = 'method_call'").select("response_id", F.col("receiver").alias("module"), "name").distinct().join(modules, ["response_id", "module"], "left_semi")
    missing = calls.join(members.select("module").distinct(), "module", "left_semi").join(members, ["module", "name"], "left_anti")
    near = missing.select("module", "name").distinct().join(members.withColumnRenamed("name", "other"), "module").where("length(name) >= 3 and length(other) >= 3").withColumn("d", byte_distance(F.col("name"), F.col("other"), cap)).where(F.col("d") <= cap)
    best = near.groupBy("module", "name").agg(F.min(F.struct("d", "other")).alias("m")).select("module", "name", F.col("m.other").alias("suggestion"))
    text = F.concat(warn("hallucinated-method", F.concat_ws(".", "module", "name"), "is not defined"), F.coalesce(F.concat(F.lit(", did you mean `"), "suggestion", F.lit("`?")), F.lit("")))
    return missing.join(best, ["module", "name"], "left").select("response_id", text.alias("warning"))


#: Rules by bare function, language by language: the shortest name, the most distance for short and long names, and whether a suggestion is needed.
BARE = {"go": (3, 4, 3, 2, False), "cpp": (3, 3, 3, 1, True), "c": (4, 3, 3, 0, False)}


def bare_functions(calls: DataFrame, known: DataFrame, language: str) -> DataFrame:
    """Calls of functions that no known one names: (response_id, name) against (name), by the language's thresholds."""
    least, short, per, more, needed = BARE[language]
    missing = calls.where(F.octet_length("name") >= least).select("response_id", "name").distinct().join(known, "name", "left_anti")
    limit = F.when(F.octet_length("name") <= 6, short).otherwise(F.floor(F.octet_length("name") / per) + more)
    block = lambda c: F.lower(F.substring(c, 1, 3))
    pairs = missing.select("name").distinct().withColumn("b", block("name")).join(known.select(F.col("name").alias("other"), block("name").alias("b")), "b").withColumn("d", byte_distance(F.col("name"), F.col("other"))).where(F.col("d") <= limit)
    best = pairs.groupBy("name").agg(F.min(F.struct("d", "other")).alias("m")).select("name", F.col("m.other").alias("suggestion"))
    out = missing.join(best, "name", "inner" if needed else "left")
    return out.select("response_id", F.concat(warn("hallucinated-function", F.col("name"), "is not defined"), F.coalesce(F.concat(F.lit(", did you mean `"), "suggestion", F.lit("`?")), F.lit(""))).alias("warning"))


def includes(found: DataFrame, known: DataFrame) -> DataFrame:
    """Headers (response_id, header) that are unknown but close to a known one; lengths within the distance block the join."""
    missing = found.select("response_id", "header").distinct().join(known, "header", "left_anti")
    limit = F.when(F.octet_length("header") >= 10, 3 + F.floor(F.octet_length("header") / 4)).otherwise(3)
    sized = missing.select("header").distinct().withColumn("n", F.explode(F.sequence(F.octet_length("header").cast("long") - limit, F.octet_length("header").cast("long") + limit)))
    near = sized.join(known.select(F.col("header").alias("other"), F.octet_length("header").cast("long").alias("n")), "n").withColumn("d", byte_distance(F.col("header"), F.col("other"))).where(F.col("d") <= limit)
    best = near.groupBy("header").agg(F.min(F.struct("d", "other")).alias("m")).select("header", F.col("m.other").alias("suggestion"))
    return missing.join(best, "header").select("response_id", F.concat(warn("hallucinated-import", F.col("header"), "not found, did you mean"), F.lit(" `"), "suggestion", F.lit("`?")).alias("warning"))


def diagnostics(lines: DataFrame) -> DataFrame:
    """(response_id, tool, code, symbol) of compilers' and checkers' lines (response_id, tool, line)."""
    quoted_name = F.regexp_extract("line", "['`\"‘]([A-Za-z_][\\w:.]*)['`\"’]", 1)
    code = F.regexp_extract("line", r"\b(error(?:\[E\d+\]| TS\d+| CS\d+)?|report\w+)", 1)
    return lines.where(F.lower("line").rlike("error|report")).select("response_id", "tool", code.alias("code"), quoted_name.alias("symbol")).where("symbol <> ''").distinct()


#: How far a suggestion may be from a member's name, language by language: for names of up to six bytes, and the divisor of longer ones.
MEMBER_LIMITS = {"typescript": (2, 4), "rust": (2, 4), "go": (2, 3), "java": (2, 4), "csharp": (2, 4), "cpp": (2, 4), "python": (2, 4)}


def members(calls: DataFrame, known: DataFrame, language: str, kind: str = "hallucinated-method") -> DataFrame:
    """Members that a known type, module, class or package lacks, with the nearest of its own: calls (response_id, type, member) against (type, member).

    Covers methods, static methods, symbols of imports and classes of packages;
    types without evidence stay unknown.
    """
    short, per = MEMBER_LIMITS[language]
    asked = calls.select("response_id", "type", "member").distinct()
    missing = asked.join(known.select("type").distinct(), "type", "left_semi").join(known, ["type", "member"], "left_anti")
    limit = F.when(F.octet_length("member") <= 6, short).otherwise(F.floor(F.octet_length("member") / per))
    named = missing.select("type", "member").distinct()
    near = spread(named, "type", "member").join(known.withColumnRenamed("member", "other"), "type").where(F.abs(F.octet_length("member") - F.octet_length("other")) <= limit)
    near = near.withColumn("d", byte_distance(F.col("member"), F.col("other"))).where(F.col("d") <= limit)
    best = near.groupBy("type", "member").agg(F.min(F.struct("d", "other")).alias("m")).select("type", "member", F.col("m.other").alias("suggestion"))
    text = F.concat(warn(kind, F.concat_ws(".", "type", "member"), "not in known methods"), F.coalesce(F.concat(F.lit(", did you mean `"), "suggestion", F.lit("`?")), F.lit("")))
    return missing.join(best, ["type", "member"], "left").select("response_id", text.alias("warning"))


def chains(calls: DataFrame, returns: DataFrame, hops: int = 6) -> DataFrame:
    """Chains of calls followed from type to type: (response_id, chain, type, members) against (type, member, returned).

    A member that a known type lacks is a phantom; one whose result has no
    evidence breaks the chain. Each hop is one equi join; a chain ends in one
    warning at most.
    """
    known = returns.select("type").distinct().withColumn("is_known", F.lit(True))
    now = calls.select("response_id", "chain", "type", "members")
    found = None
    for hop in range(hops):
        here = now.where(F.size("members") > hop).withColumn("member", F.get("members", F.lit(hop)))
        seen = here.join(known, "type", "left").join(returns, ["type", "member"], "left")
        phantom = seen.where("is_known and returned is null").select("response_id", "chain", warn("chain-phantom-member", F.concat_ws(".", "type", "member"), "does not exist").alias("warning"))
        broken = seen.where("is_known is null").select("response_id", "chain", warn("chain-broken", F.col("type"), "is unknown").alias("warning")) if hop else None
        ended = phantom if broken is None else phantom.unionByName(broken)
        found = ended if found is None else found.unionByName(ended)
        now = seen.where("returned is not null").select("response_id", "chain", F.col("returned").alias("type"), "members")
    return found


def constructors(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """Constructors called with fewer or more arguments than any signature takes: (response_id, class, arguments) against (class, least, most)."""
    bounds = signatures.groupBy("class").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    wrong = calls.join(bounds, "class").where("arguments < least or arguments > most")
    return wrong.select("response_id", F.concat(warn("hallucinated-constructor", F.col("class"), "takes "), "least", F.lit(" to "), "most", F.lit(" arguments")).alias("warning")).distinct()


def missing_headers(calls: DataFrame, functions: DataFrame, included: DataFrame) -> DataFrame:
    """Functions whose header no response's include names: (response_id, name) against (name, header) and (response_id, header)."""
    needed = calls.select("response_id", "name").distinct().join(functions, "name")
    have = needed.join(included, ["response_id", "header"], "left_semi").select("response_id", "name").distinct()
    none = needed.join(have, ["response_id", "name"], "left_anti").groupBy("response_id", "name").agg(F.min("header").alias("header"))
    return none.select("response_id", F.concat(warn("hallucinated-function", F.col("name"), "needs"), F.lit(" `"), "header", F.lit("`")).alias("warning"))


def namespaces(found: DataFrame, known: DataFrame) -> DataFrame:
    """Namespaces (response_id, namespace) that are unknown but near to a known one."""
    near = includes(found.select("response_id", F.col("namespace").alias("header")), known.select(F.col("namespace").alias("header")))
    return near.select("response_id", F.regexp_replace("warning", "^hallucinated-import:", "hallucinated-namespace:").alias("warning"))
