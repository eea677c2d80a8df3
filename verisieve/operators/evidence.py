"""Joins of claims with evidence: types, arities, inheritance, registries, compilers.

Missing evidence is never an error of the claim: it stays unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_bytes, byte_distance, distance_of_bytes, spread


def instance_calls(calls: DataFrame, scope: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls var.method whose variable's type is known but lacks the method, with a suggestion within two bytes."""
    typed = calls.join(scope, ["response_id", "var"])
    known = typed.join(symbols.select(F.col("class").alias("type")).distinct(), "type", "left_semi")
    missing = known.join(symbols.select(F.col("class").alias("type"), F.col("name").alias("method")).distinct(), ["type", "method"], "left_anti")
    names = symbols.select(F.col("class").alias("type"), F.col("name").alias("suggestion"), as_bytes(F.col("name")).alias("s")).distinct()
    asked = missing.select("type", "method", as_bytes(F.col("method")).alias("m")).distinct()
    near = spread(asked, "type", "method").join(names, "type").where(F.abs(F.length("m") - F.length("s")) <= 2).withColumn("d", distance_of_bytes(F.col("m"), F.col("s"), 2)).where("d <= 2")
    best = near.groupBy("type", "method").agg(F.min(F.struct("d", "suggestion")).alias("m")).select("type", "method", F.col("m.suggestion").alias("suggestion"))
    return missing.join(best, ["type", "method"], "left").select("response_id", "var", "type", "method", "suggestion")


def arity_conflicts(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """Calls with more arguments than all signatures of the method agree on; variadic methods and short names are left out."""
    agreed = signatures.groupBy("method").agg(F.count_distinct("arity").alias("n"), F.max("arity").alias("expected"), F.max(F.col("variadic").cast("int")).alias("variadic")).where("n = 1 and variadic = 0")
    return calls.where(F.octet_length("method") >= 4).join(agreed, "method").where("actual > expected").select("response_id", "method", "actual", "expected")


def ancestors(parents: DataFrame, hops: int = 12) -> DataFrame:
    """(class, ancestor, hops) over parent edges (class, parent), by doubling: each round joins paths with paths."""
    found = parents.select("class", F.col("parent").alias("ancestor"), F.lit(1).alias("hops")).where("parent is not null and class <> parent")
    reach = 1
    while reach < hops:
        longer = found.alias("a").join(found.alias("b"), F.col("a.ancestor") == F.col("b.class")).select(F.col("a.class").alias("class"), F.col("b.ancestor").alias("ancestor"), (F.col("a.hops") + F.col("b.hops")).alias("hops"))
        found = found.unionByName(longer.where((F.col("hops") <= hops) & (F.col("class") != F.col("ancestor")))).groupBy("class", "ancestor").agg(F.min("hops").alias("hops"))
        reach *= 2
    return found


def import_suggestions(imports: DataFrame, libraries: DataFrame, least_symbols: int = 5) -> DataFrame:
    """The library nearest to a missing import: libraries of five symbols at least, within a third to ten bytes by length.

    Blocked by length bands, so that no import meets every library.
    """
    big = libraries.where(F.col("n") >= least_symbols).select(F.col("library").alias("suggestion"))
    limit = F.greatest(F.least(F.floor(F.octet_length("name") / 5), F.lit(10)), F.lit(3))
    left = imports.select("name").distinct().withColumn("cap", limit).withColumn("len", F.explode(F.sequence(F.octet_length("name") - F.col("cap"), F.octet_length("name") + F.col("cap"))))
    pairs = left.join(big.withColumn("len", F.octet_length("suggestion").cast("bigint")), "len").where("name <> suggestion")
    pairs = pairs.withColumn("distance", byte_distance(F.lower("name"), F.lower("suggestion"))).where("distance <= cap")
    return pairs.groupBy("name").agg(F.min(F.struct("distance", "suggestion")).alias("m")).select("name", "m.*")


def registry_status(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """Imports with their registry's answer; relative ones are skipped, unanswered ones unknown."""
    skipped = F.col("name").rlike(r"^[./]") | F.col("name").isNull()
    return imports.join(registry, ["language", "name"], "left").withColumn("status", F.when(skipped, "skipped").otherwise(F.coalesce("status", F.lit("unknown"))))


def receivers(calls: DataFrame, bindings: DataFrame, members: DataFrame) -> DataFrame:
    """Calls through an alias or a typed receiver whose members are known and lack the one called."""
    typed = calls.join(bindings, ["response_id", "receiver"])
    known = typed.join(members.select("type").distinct(), "type", "left_semi")
    return known.join(members, ["type", "member"], "left_anti")


def shared_checksums(entries: DataFrame) -> DataFrame:
    """Checksums that several modules claim."""
    return entries.groupBy("hash").agg(F.count_distinct("module").alias("modules"), F.min("module").alias("first_module")).where("modules > 1")


def confirm(warnings: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Warnings whose symbol is confirmed, and a new one for each confirmed symbol that none covers."""
    kept = warnings.join(confirmed, ["response_id", "symbol"], "left_semi").select("response_id", "symbol", F.lit("kept").alias("source"))
    added = confirmed.join(warnings, ["response_id", "symbol"], "left_anti").select("response_id", "symbol", F.lit("added").alias("source"))
    return kept.unionByName(added).distinct()


def suppress(warnings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Warnings whose symbol no language server resolved."""
    return warnings.join(resolved, ["response_id", "symbol"], "left_anti")


def not_exported(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Named imports of packages with a known surface that does not export them; ``*`` never counts."""
    known = imports.where("name <> '*'").join(exports.select("package").distinct(), "package", "left_semi")
    return known.join(exports.select("package", F.col("export").alias("name")), ["package", "name"], "left_anti")


def unknown_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Keyword arguments that a known signature without ``**`` lacks, in order."""
    closed = parameters.groupBy("callable").agg(F.max((F.col("parameter").startswith("**")).cast("int")).alias("open")).where("open = 0")
    given = calls.join(closed, "callable", "left_semi").select("response_id", "callable", F.explode("keywords").alias("parameter")).distinct()
    return given.join(parameters, ["callable", "parameter"], "left_anti")
