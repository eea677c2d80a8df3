"""Sinks: append logs with retention, audits by day, reports, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.telemetry import counters


def append_log(rows: DataFrame, path: str) -> None:
    """Appends lines of JSON."""
    rows.write.mode("append").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Appends audit rows, by day, so that old ones go as whole partitions."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def kept_days(audit: DataFrame, today: Column, days: int) -> DataFrame:
    """The audit's newest days; a filter on the partition alone."""
    return audit.where(F.col("day") > F.date_sub(today, days))


def report(results: DataFrame, path: str) -> DataFrame:
    """Writes a JSON line for each response and returns the summary."""
    results.write.mode("overwrite").json(path)
    return results.agg(F.count("*").alias("responses"), F.count_if("clean").alias("clean"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))


def stats_json(log: DataFrame) -> DataFrame:
    """The counters as one JSON object."""
    return counters(log).select(F.to_json(F.struct("*")).alias("json"))


def pending(symbols: DataFrame, agent: DataFrame) -> DataFrame:
    """Symbols with those of the agent's own code, which replace its earlier ones under the version ``agent_pending``."""
    return symbols.where(F.col("version") != "agent_pending").unionByName(agent.withColumn("version", F.lit("agent_pending")))
