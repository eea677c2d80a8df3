"""Logs of scans: collapsing, counters, percentiles, histograms, retention, exposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank

#: Severity of a result, and upper bounds of the latency histogram in milliseconds.
SEVERITY = {"blocked": 4, "error": 3, "warning": 2, "clean": 1}
BOUNDS = (50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000)


def severity(result: Column) -> Column:
    out = F.lit(0)
    for k, v in SEVERITY.items():
        out = F.when(result == k, v).otherwise(out)
    return out


def collapse(log: DataFrame) -> DataFrame:
    """One row for each request: an ordered fold over its lines, the newest first.

    The running line is replaced by one that is more severe, or as severe and
    riskier, or as risky and names a model where it names none; what the running
    line lacks (model, tokens, latency) is filled from the other.  The lines of
    one request are few; they meet in one row.
    """
    line = F.struct(F.col("event_id").alias("event_id"), severity(F.col("scan_result")).alias("sev"), "risk", "model", "tokens", "latency_ms", "scan_result")
    filled = lambda a, b, c: F.when(a[c].isNull() | (a[c] == F.lit(0)), b[c]).otherwise(a[c])

    def fill(a: Column, b: Column) -> Column:
        model = F.when(a["model"] == "", b["model"]).otherwise(a["model"])
        return F.struct(a["event_id"].alias("event_id"), a["sev"].alias("sev"), a["risk"].alias("risk"), model.alias("model"), filled(a, b, "tokens").alias("tokens"), filled(a, b, "latency_ms").alias("latency_ms"), a["scan_result"].alias("scan_result"))

    def step(a: Column, b: Column) -> Column:
        better = (b["sev"] > a["sev"]) | ((b["sev"] == a["sev"]) & (b["risk"] > a["risk"])) | ((b["sev"] == a["sev"]) & (b["risk"] == a["risk"]) & (a["model"] == "") & (b["model"] != ""))
        return F.when(better, fill(b, a)).otherwise(fill(a, b))

    lines = log.groupBy("request_id").agg(F.sort_array(F.collect_list(line), asc=False).alias("lines"))
    folded = lines.select("request_id", F.aggregate(F.slice("lines", F.lit(2), F.size("lines")), F.get("lines", F.lit(0)), step).alias("w"))
    return folded.select("request_id", F.col("w.event_id").alias("event_id"), F.col("w.scan_result").alias("scan_result"), F.col("w.risk").alias("risk"), F.col("w.model").alias("model"), F.col("w.tokens").alias("tokens"), F.col("w.latency_ms").alias("latency_ms"))


def newest(log: DataFrame, n: int) -> DataFrame:
    """The newest lines."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def counters(log: DataFrame) -> DataFrame:
    """One row of counts and sums."""
    return log.agg(
        F.count("*").alias("requests"),
        *[F.count_if(F.col("scan_result") == r).alias(r) for r in ("clean", "warning", "blocked", "error", "skipped")],
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.avg("risk"), F.lit(0.0)), 6).alias("avg_risk"),
    )


def percentiles(log: DataFrame, points: Sequence[float] = (0.5, 0.95, 0.99), window: int = 200) -> DataFrame:
    """Nearest-rank percentiles of the latency of the newest lines."""
    values = newest(log, window).agg(F.sort_array(F.collect_list("latency_ms")).alias("v"))
    return values.select(*[nearest_rank(F.col("v"), p).alias(f"p{round(100 * p)}") for p in points])


def histogram(log: DataFrame, bounds: Sequence[int] = BOUNDS) -> DataFrame:
    """Cumulative counts up to each bound and over all, with the sum."""
    counts = log.agg(*[F.count_if(F.col("latency_ms") <= b).alias(f"b{b}") for b in bounds], F.count("latency_ms").alias("all"), F.sum("latency_ms").alias("total"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in bounds], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return counts.select(F.explode(rows).alias("r"), "total").select("r.le", "r.n", "total")


def ring(log: DataFrame, key: str, n: int = 50) -> DataFrame:
    """The newest lines of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def retain(log: DataFrame, most: int = 1000, keep: int = 500) -> DataFrame:
    """All lines while there are few, else the newest ones: a count decides, then a bounded sort."""
    total = log.agg(F.count("*").alias("n")).first()["n"]
    return log if total <= most else newest(log, keep)


def exposition(counts: DataFrame) -> DataFrame:
    """Lines of the text exposition format from one row of counters."""
    names = [c for c in counts.columns if c != "avg_risk"]
    rows = F.array(*[F.struct(F.lit(i).alias("n"), F.concat(F.lit(f"scan_{c}_total "), F.col(c).cast("string")).alias("line")) for i, c in enumerate(names)])
    return counts.select(F.explode(rows).alias("r")).select("r.n", "r.line")


def cached(log: DataFrame, ttl_seconds: int, most: int) -> DataFrame:
    """What a cache with a time to live and a bound, oldest insertion out first, holds at the newest line.

    A key's newest line renews it.  The clock is one row.
    """
    now = log.agg(F.max("ts").alias("now"))
    keys = log.groupBy("user_id").agg(F.max("ts").alias("inserted_at"), F.count("*").alias("lines"))
    alive = keys.crossJoin(F.broadcast(now)).where(F.col("inserted_at").cast("double") > F.col("now").cast("double") - ttl_seconds).drop("now")
    return alive.orderBy(F.desc("inserted_at"), "user_id").limit(most)
