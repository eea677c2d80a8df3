"""Partial responses: server-sent events from arbitrary chunks, and when to scan them.

The batch forms are windows and folds over ordered chunks; the streaming form
keeps one small state for each request and emits the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spread

#: A partial event may hold so many bytes before it is dropped.
BUFFER_BYTES = 1_048_576
#: Content length of the first scan, the least length of any, and the least growth of another.
FIRST_SCAN, LEAST_SCAN, LEAST_GROWTH = 500, 50, 50
#: A request without chunks for so long is forgotten.
IDLE_MS = 30 * 60 * 1000


def events(chunks: DataFrame) -> DataFrame:
    """(request_id, event_no, event): complete events of the chunks in order; what is left at the end is forwarded too."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]), "")
    parts = F.filter(F.split(F.col("text"), "\r\n\r\n|\n\n"), lambda x: x != "")
    return spread(chunks, "request_id").groupBy("request_id").agg(text.alias("text")).select("request_id", F.posexplode(parts).alias("event_no", "event"))


def deltas(events: DataFrame) -> DataFrame:
    """Adds content, total tokens and done of each event, of either vendor; reasoning is left out."""
    events = events.withColumn("_body", F.regexp_extract("event", r"(?s)data: ?(.*)$", 1)).withColumn("_v", F.try_parse_json("_body"))  # parsed once
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    content = F.coalesce(get("$.choices[0].delta.content", "string"), F.when(get("$.delta.type", "string") == "text_delta", get("$.delta.text", "string")), F.lit(""))
    tokens = F.coalesce(get("$.usage.total_tokens", "bigint"), get("$.usage.output_tokens", "bigint"))
    done = (F.col("_body") == "[DONE]") | F.coalesce(get("$.type", "string") == "message_stop", F.lit(False))
    return events.withColumns({"content": content, "tokens": tokens, "done": done}).drop("_body", "_v")


def scan_points(parsed: DataFrame) -> DataFrame:
    """(request_id, scan_no, event_no, content_len): when a response is scanned.

    First once the content has 500 bytes, or more than 50 when usage arrives or
    the end does; again at the end if it has grown by a tenth, and 50 bytes,
    since.
    """
    w = Window.partitionBy("request_id").orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    run = parsed.withColumn("len", F.sum(F.octet_length("content")).over(w)).withColumn("usage", F.max(F.col("tokens").isNotNull()).over(w))
    ready = (F.col("len") > LEAST_SCAN) & ((F.col("len") >= FIRST_SCAN) | F.col("usage") | F.col("done"))
    first = run.where(ready).groupBy("request_id").agg(F.min(F.struct("event_no", "len")).alias("f"))
    ends = run.where("done").groupBy("request_id").agg(F.min(F.struct("event_no", "len")).alias("e"))
    both = first.join(ends, "request_id", "left")
    growth = F.col("e.len") - F.col("f.len")
    again = (F.col("e.event_no") > F.col("f.event_no")) & (growth >= F.greatest(F.floor(F.col("f.len") / 10), F.lit(LEAST_GROWTH)))
    scans = F.filter(F.array(F.struct(F.lit(1).alias("scan_no"), F.col("f.event_no").alias("event_no"), F.col("f.len").alias("content_len")), F.when(again, F.struct(F.lit(2).alias("scan_no"), F.col("e.event_no").alias("event_no"), F.col("e.len").alias("content_len")))), lambda x: x.isNotNull())
    return both.select("request_id", F.explode(scans).alias("s")).select("request_id", "s.*")


SCANS = "request_id long, scan_no int, event_no int, content_len long"
_STATE = "buffer string, event_no int, content_len long, usage boolean, scans int, last_len long, done boolean"


def parse_event(event: str) -> tuple[str, bool, bool]:
    """(content, whether usage is given, whether it is the end) of one event."""
    body = event.partition("data:")[2].strip()
    if body == "[DONE]":
        return "", False, True
    try:
        v = json.loads(body)
    except ValueError:
        return "", False, False
    if not isinstance(v, dict):
        return "", False, False
    choices, delta, usage = v.get("choices") or [{}], v.get("delta") or {}, v.get("usage") or {}
    content = (choices[0].get("delta") or {}).get("content") or (delta.get("text") if delta.get("type") == "text_delta" else "") or ""
    return content, "total_tokens" in usage or "output_tokens" in usage, v.get("type") == "message_stop"


def advance(state: tuple, data: str) -> tuple[tuple, list[tuple[int, int, int]]]:
    """The state after more data, and the scans that it fires: (scan_no, event_no, content_len)."""
    buffer, number, length, usage, scans, last, done = state
    buffer += data
    fired = []
    while True:
        cuts = [(buffer.find(b), len(b)) for b in ("\n\n", "\r\n\r\n") if b in buffer]
        if not cuts:
            break
        at, size = min(cuts)
        event, buffer = buffer[:at], buffer[at + size :]
        if not event:
            continue
        content, has_usage, end = parse_event(event)
        length, usage = length + len(content.encode()), usage or has_usage
        first = not scans and length > LEAST_SCAN and (length >= FIRST_SCAN or usage or end)
        again = end and not done and scans == 1 and length - last >= max(last // 10, LEAST_GROWTH)
        if first or again:
            scans, last = scans + 1, length
            fired.append((scans, number, length))
        done = done or end
        number += 1
    if len(buffer.encode()) > BUFFER_BYTES:
        buffer = ""
    return (buffer, number, length, usage, scans, last, done), fired


def scan_stream(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The scan points of a stream of chunks (request_id, seq, data), each emitted once.

    A request that is idle for ``idle_ms`` is forgotten; with None none is,
    which a run that must end by itself needs.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else ("", 0, 0, False, 0, 0, False)
        rows = pd.concat(list(parts)).sort_values("seq")
        fired = []
        for data in rows["data"]:
            now, more = advance(tuple(now), data)
            fired += more
        state.update(now)
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if fired:
            yield pd.DataFrame([(key[0], *f) for f in fired], columns=["request_id", "scan_no", "event_no", "content_len"])

    return chunks.groupBy("request_id").applyInPandasWithState(step, SCANS, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def block_event(warning: Column) -> Column:
    """An event that tells the client of a block."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("[blocked] "), warning).alias("content")).alias("delta"), F.lit("stop").alias("finish_reason"))).alias("choices"))), F.lit("\n\n"))


def warning_event(warning: Column, wire: Column) -> Column:
    """A warning as a delta of either vendor's wire."""
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(warning.alias("content")).alias("delta"))).alias("choices")))
    anthropic = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), warning.alias("text")).alias("delta")))
    return F.when(wire == "anthropic", F.concat(F.lit("event: content_block_delta\ndata: "), anthropic, F.lit("\n\n"))).otherwise(F.concat(F.lit("data: "), openai, F.lit("\n\n")))


def actions(held: DataFrame, least_risk: float = 0.3) -> DataFrame:
    """What becomes of held tool calls: blocked where the risk reaches the threshold and a warning's token stands in the new code, flushed otherwise."""
    token = F.regexp_extract("warning", "`([^`]*)`", 1)
    hit = (token != "") & F.col("new_code").contains(token)
    return held.groupBy("request_id").agg(F.max("risk").alias("risk"), F.bool_or(hit).alias("hit")).withColumn("action", F.when((F.col("risk") >= least_risk) & F.col("hit"), "block").otherwise("flush"))
