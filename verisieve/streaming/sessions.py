"""Sessions: symbols of a conversation, deferred warnings, differences since the last scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A session ends after so long without activity, and holds so many symbols.
GAP, MOST_SYMBOLS = "30 minutes", 10_000


def session_symbols(events: DataFrame, user: str, symbol: str, watermark: str | None = None) -> DataFrame:
    """(user, started, ended, symbols, lines) of each session; the same for a batch and, with a watermark, for a stream."""
    timed = events.withWatermark("ts", watermark) if watermark else events
    w = F.session_window("ts", GAP)
    g = timed.groupBy(F.col(user).alias("user"), w.alias("w")).agg(F.slice(F.array_sort(F.collect_set(symbol)), 1, MOST_SYMBOLS).alias("symbols"), F.count("*").alias("lines"))
    return g.select("user", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "symbols", "lines")


def new_results(results: DataFrame, watermark: str) -> DataFrame:
    """Tool results that were not seen before, by their content's hash; of a stream, not within the watermark."""
    hashed = results.withColumn("hash", F.sha2("content", 256))
    return hashed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["root", "hash"]) if results.isStreaming else hashed.dropDuplicates(["root", "hash"])


def deferred(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """Each queued warning (client, ts, warning) with the client's first request after it."""
    asks = requests.select("client", F.col("ts").alias("at"), "request_id").withColumn("kind", F.lit(1))
    rows = queue.select("client", F.col("ts").alias("at"), F.lit(None).cast("long").alias("request_id"), F.lit(0).alias("kind"), "warning").unionByName(asks.withColumn("warning", F.lit(None).cast("string")))
    w = Window.partitionBy("client").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("drained_by", F.first("request_id", ignorenulls=True).over(w)).where("kind = 0").select("client", "warning", "drained_by")


def _bytes(c: Column) -> Column:
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def difference(new: Column, old: Column) -> Column:
    """What is new since the last text.

    The rest after the last text where that is a prefix; the rest after the
    common prefix where it has more than six tenths of the shorter one's bytes;
    else all. A cut within a character gives all.
    """
    n, o = _bytes(new), _bytes(old)
    shorter = F.least(F.length(n), F.length(o))
    same = F.zip_with(F.split(n, ""), F.split(o, ""), lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, False)
    common = F.when(at == 0, shorter).otherwise(at.cast("int") - 1)
    rest = F.substring(n, common + 1, F.length(n))
    tail = F.when(rest.rlike("^[\\x{80}-\\x{BF}]"), new).otherwise(F.decode(F.encode(rest, "ISO-8859-1"), "UTF-8"))
    return F.when(F.coalesce(old, F.lit("")) == "", new).when(new.startswith(old), F.substring(new, F.length(old) + 1, F.length(new))).when(common > F.floor(shorter * 6 / 10), tail).otherwise(new)


def since_last(texts: DataFrame, project: str, order: str, text: str, cap: int = 8000) -> DataFrame:
    """Adds ``diff``: each text against its project's last one, of which so many bytes are remembered."""
    w = Window.partitionBy(project).orderBy(order)
    return texts.withColumn("_old", F.lag(F.substring(text, 1, cap)).over(w)).withColumn("diff", difference(F.col(text), F.col("_old"))).drop("_old")
