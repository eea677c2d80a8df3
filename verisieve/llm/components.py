"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins.  The minimum of a node's
neighbours is summed up on the map side, so a hub is no problem there; in the
joins the hub's rows stand on one side only, and adaptive execution may split
them.  Nothing comes to the driver but whether all is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """One half of a round, as a written table and its path.

    The minima are written first: a join of two tables that are only exchanged
    is one whose large partitions adaptive execution can split.
    """
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest, path = materialize(pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")), "minima")
    joined = pairs.join(lowest, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
    stepped = materialize(out.where("a <> b").distinct(), "edges")
    discard(edges.sparkSession, path)
    return stepped


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge downwards at most, to a node that has none: then that is the smallest of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    wrong = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down > 0 and up > 0")
    return wrong.isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component), with the smallest node of its component for every node of ``edges``.

    ``edges`` has columns a and b of one orderable type.  Nulls and loops are
    left out; repeated edges count once.  An empty table gives an empty result.
    Raises when ``max_rounds`` rounds were not enough: an unfinished result is
    never returned.
    """
    spark = edges.sparkSession
    now, path = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        half, half_path = _stars(now, True)
        stepped, new_path = _stars(half, False)
        discard(spark, half_path)
        discard(spark, path)
        now, path = stepped, new_path
    else:
        raise RuntimeError(f"components not complete after {max_rounds} rounds")
    return now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.*").distinct()
