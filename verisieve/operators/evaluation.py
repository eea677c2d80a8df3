"""Quality of predictions: confusion, intervals, calibration, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson


def _cells() -> list:
    p, t = F.col("predicted"), F.col("truth")
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")]


def confusion(predictions: DataFrame) -> DataFrame:
    """Cells, precision, recall and F1, zero where undefined."""
    c = predictions.agg(*_cells())
    c = c.withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6))
    return c.withColumn("f1", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def intervals(predictions: DataFrame, by: str) -> DataFrame:
    """Share of predictions that are right, with its Wilson interval, for each group."""
    g = predictions.groupBy(by).agg(F.count_if(F.col("predicted") == F.col("truth")).alias("hits"), F.count("*").alias("n"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return g.select(by, "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def recall_by(predictions: DataFrame) -> DataFrame:
    """Cells and recall over all, by language and by claim type, from one pass of grouping sets."""
    g = predictions.groupingSets([[], [F.col("language")], [F.col("claim_type")]], "language", "claim_type").agg(*_cells())
    return g.select(F.coalesce("language", F.lit("*")).alias("language"), F.coalesce("claim_type", F.lit("*")).alias("claim_type"), "tp", "fp", "fn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


def set_difference(predictions: DataFrame) -> DataFrame:
    """Two flaggers against each other and the truth."""
    a, b, t = F.col("flagged_a"), F.col("flagged_b"), F.col("truth")
    return predictions.agg(
        F.count_if(a & ~b & t).alias("only_a_true"), F.count_if(a & ~b & ~t).alias("only_a_false"), F.count_if(b & ~a & t).alias("only_b_true"), F.count_if(b & ~a & ~t).alias("only_b_false"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither")
    )


def calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width, the last one closed."""
    binned = predictions.withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)))
    g = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("truth").cast("double")).alias("a"))
    return g.agg(F.round(F.coalesce(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), F.lit(0.0)), 6).alias("ece"), F.count("*").alias("bins"))


def brier(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.round(F.avg(F.pow(F.col("confidence") - F.col("truth").cast("double"), F.lit(2.0))), 6).alias("brier"))


def newest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each task and arm."""
    return runs.groupBy("task", "arm").agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"))


def layer_hits(findings: DataFrame) -> DataFrame:
    """How many responses each layer hit, and any did."""
    each = findings.groupBy("response_id").agg(F.bool_or(F.col("kind") == "cached").alias("l15"), F.bool_or(F.col("kind") == "forge").alias("l2"), F.bool_or(F.col("kind") == "logic").alias("l3"))
    return each.agg(F.count_if("l15").alias("l15"), F.count_if("l2").alias("l2"), F.count_if("l3").alias("l3"), F.count_if(F.col("l15") | F.col("l2") | F.col("l3")).alias("hit"), F.count("*").alias("responses"))
