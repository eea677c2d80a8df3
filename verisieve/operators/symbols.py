"""The symbol catalogue: loading, lookup, fuzzy lookup.

Lookups take the newest version by text order, libraries in ascending order;
misses keep their row with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_bytes, byte_distance, common_prefix, distance_of_bytes, spread

#: The kinds of symbols and the visibilities that a catalogue knows.
KINDS = ("class", "method", "function", "property", "signal", "constant", "enum", "enum_member", "annotation", "interface", "type_alias", "module", "constructor")
VISIBILITIES = ("public", "protected", "private", "internal")


def upsert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The later row of each (library, version, path) wins; rows carry ``seq``."""
    newest = Window.partitionBy("library", "version", "path").orderBy(F.desc("load"), F.desc("seq"))
    both = existing.withColumn("load", F.lit(0)).unionByName(batch.withColumn("load", F.lit(1)))
    return both.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "load")


def replace_bundle(existing: DataFrame, bundle: DataFrame) -> DataFrame:
    """Every (library, version) of the bundle is replaced as a whole; rows without a name are dropped."""
    good = bundle.where("name is not null and name <> ''")
    return existing.join(good.select("library", "version").distinct(), ["library", "version"], "left_anti").unionByName(good)


def remove_library(existing: DataFrame, library: str) -> DataFrame:
    return existing.where(~F.col("library").eqNullSafe(library))


def with_defaults(symbols: DataFrame) -> DataFrame:
    """Unknown kinds are methods, unknown visibilities public."""
    kind, vis = F.col("kind"), F.col("visibility")
    return symbols.withColumn("kind", F.when(kind.isin(*KINDS), kind).otherwise("method")).withColumn("visibility", F.when(vis.isin(*VISIBILITIES), vis).otherwise("public"))


def latest(symbols: DataFrame, key: str = "path") -> DataFrame:
    """The newest version, in text order, of each (library, key)."""
    return symbols.groupBy("library", key).agg(F.max_by(F.struct("version", "seq"), F.struct("version", "seq")).alias("m")).select("library", key, "m.version", "m.seq")


def lookup(claims: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """The first library by name that has ``key``, and its newest version; null where none does."""
    best = latest(symbols, key).groupBy(key).agg(F.min(F.struct("library", "version")).alias("m")).select(key, F.col("m.library").alias("library"), F.col("m.version").alias("version"))
    return claims.join(best, key, "left")


def check_claims(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """verified where the path exists, hallucinated where only its class does, else unknown; with a confidence."""
    paths = symbols.select("class", F.col("name").alias("method"), F.lit(True).alias("has_path")).distinct()
    classes = symbols.select("class", F.lit(True).alias("has_class")).distinct()
    joined = claims.join(paths, ["class", "method"], "left").join(classes, "class", "left")
    verdict = F.when(F.col("has_path"), "verified").when(F.col("has_class"), "hallucinated").otherwise("unknown")
    return joined.withColumn("verdict", verdict).withColumn("confidence", F.when(F.col("has_path"), 1.0).when(F.col("has_class"), 0.9).otherwise(0.5)).drop("has_path", "has_class")


def by_prefix(symbols: DataFrame, prefix: str) -> DataFrame:
    """Paths that begin with the prefix in either case; an underscore in it stands for any character."""
    return symbols.where(F.col("path").ilike(prefix + "%"))


def everywhere(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of all libraries whose name or path is one of ``names``."""
    by = lambda c: symbols.join(names.withColumnRenamed("name", c), c, "left_semi")
    return by("name").unionByName(by("path")).distinct()


def other_library(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """Claims (library, path) whose path another library has."""
    others = symbols.groupBy("path").agg(F.min("library").alias("low"), F.max("library").alias("high"))
    return claims.join(others, "path").where((F.col("low") != F.col("library")) | (F.col("high") != F.col("library"))).drop("low", "high")


def nearest_method(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """The nearest method of a claim's own class: two bytes apart at most, both names of four bytes, lengths within 0.6; ties by name."""
    left = claims.select("class", "method", as_bytes(F.col("method")).alias("m")).distinct()
    left = spread(left, "class", "method")
    right = symbols.where("kind = 'method'").select("class", F.col("name").alias("suggestion"), as_bytes(F.col("name")).alias("s")).distinct()
    a, b = F.length("m"), F.length("s")
    near = (F.abs(a - b) <= 2) & (a >= 4) & (b >= 4) & (F.least(a, b) / F.greatest(a, b) >= 0.6) & (F.col("m") != F.col("s"))
    pairs = left.join(right, "class").where(near).withColumn("distance", distance_of_bytes(F.col("m"), F.col("s"), 2)).where("distance <= 2")
    best = pairs.groupBy("class", "method").agg(F.min(F.struct("distance", "suggestion")).alias("m")).select("class", "method", "m.*")
    return best.withColumn("confidence", F.round(0.95 - 0.05 * (F.col("distance") - 1), 6))


def nearest_class(names: DataFrame, classes: DataFrame) -> DataFrame:
    """The nearest class over all libraries, blocked by the first four letters.

    Four common letters at least, five bytes at least, four bytes apart at most,
    or eight where six letters are common; ties by name.
    """
    block = lambda c: F.lower(F.substring(c, 1, 4))
    left = names.select("class").distinct().where(F.octet_length("class") >= 5).withColumn("block", block("class"))
    right = classes.select(F.col("name").alias("suggestion")).distinct().withColumn("block", block("suggestion"))
    pairs = left.join(right, "block").where("class <> suggestion").withColumn("common", common_prefix(F.col("class"), F.col("suggestion"))).where("common >= 4")
    pairs = pairs.withColumn("distance", byte_distance(F.col("class"), F.col("suggestion"))).where(F.col("distance") <= F.when(F.col("common") >= 6, 8).otherwise(4))
    best = pairs.groupBy("class").agg(F.min(F.struct("distance", "suggestion", "common")).alias("m")).select("class", "m.*")
    return best.withColumn("confidence", F.round(0.45 + 0.05 * F.least("common", F.lit(8)), 6))


def prefix_block(classes: DataFrame, prefix: str, limit: int = 50) -> DataFrame:
    """The first class names under a prefix, in order."""
    return classes.where(F.lower("name").startswith(prefix.lower())).select("name").distinct().orderBy("name").limit(limit)


def indexed_claims(claims: DataFrame, tokens: DataFrame) -> DataFrame:
    """Claims whose name is an index token in either case, or the part after a token's last underscore (three letters at least)."""
    keys = tokens.select(F.explode(F.array(F.lower("token"), F.when(F.length(F.substring_index("token", "_", -1)) >= 3, F.lower(F.substring_index("token", "_", -1))))).alias("key")).where("key is not null").distinct()
    return claims.withColumn("key", F.lower("method")).join(keys, "key", "left_semi").drop("key")


def nearest_token(claims: DataFrame, tokens: DataFrame) -> DataFrame:
    """The nearest index token in two tiers.

    First within one byte (two from eight on) and a fifth of the length, among
    tokens of the same first letter; then, with four common letters and lengths
    within three, within three bytes. Ties by token.
    """
    left = claims.select("method").distinct()
    right = tokens.select("token").distinct()
    low = lambda c: F.lower(c)
    first = left.withColumn("b", low(F.substring("method", 1, 1))).join(right.withColumn("b", low(F.substring("token", 1, 1))), "b").where("method <> token")
    first = first.withColumn("distance", byte_distance(low("method"), low("token"), 2)).where((F.col("distance") <= F.when(F.octet_length("method") >= 8, 2).otherwise(1)) & (F.col("distance") / F.greatest(F.octet_length("method"), F.octet_length("token")) <= 0.2))
    second = left.withColumn("b", low(F.substring("method", 1, 4))).join(right.withColumn("b", low(F.substring("token", 1, 4))), "b").where("method <> token and length(method) >= 4 and length(token) >= 4")
    second = second.where(F.abs(F.octet_length("method") - F.octet_length("token")) <= 3).withColumn("distance", byte_distance(low("method"), low("token"), 3)).where("distance <= 3")
    both = first.select("method", F.lit(1).alias("tier"), "distance", "token").unionByName(second.select("method", F.lit(2).alias("tier"), "distance", "token"))
    return both.groupBy("method").agg(F.min(F.struct("tier", "distance", "token")).alias("m")).select("method", "m.*")
