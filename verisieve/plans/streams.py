"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import sessions, sse
from .registry import query

_WORDS = "string_split(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' ')"


def chunks(v, width: int = 37):
    """Messages as events, one for each word, then usage and the end, cut into chunks of a fixed width."""
    words = F.split(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), " ")
    event = lambda w: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), w, F.lit(' "}}]}\n\n'))
    body = F.concat(F.array_join(F.transform(words, event), ""), F.lit('data: {"usage":{"total_tokens":7}}\n\ndata: [DONE]\n\n'))
    rows = v.messages.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), body.alias("body"))
    return rows.select("request_id", F.posexplode(F.expr(f"regexp_extract_all(body, r'(?s).{{1,{width}}}', 0)")).alias("seq", "data"))


@query(f"SELECT conv_id * 1000 + turn AS request_id, len({_WORDS}) + 2 AS events, array_to_string({_WORDS}, ' ') || ' ' AS content, true AS done FROM messages")
def sse_reassembly(v):
    parsed = sse.deltas(sse.events(chunks(v)))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_no", "content"))), lambda x: x["content"]), "")
    return parsed.groupBy("request_id").agg(F.count("*").alias("events"), content.alias("content"), F.bool_or("done").alias("done"))


@query(
    f"""WITH w AS (SELECT conv_id * 1000 + turn AS request_id, {_WORDS} AS w FROM messages), e AS (SELECT request_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), l AS (SELECT request_id, i, len(w) AS n, list_sum(list_transform(w[1:i], lambda x: strlen(x) + 1))::BIGINT AS len FROM e),
    f AS (SELECT request_id, min(i) AS i, min(len) AS len FROM l WHERE len >= 500 GROUP BY request_id), t AS (SELECT request_id, max(n) AS n, max(len) AS len FROM l GROUP BY request_id),
    s AS (SELECT t.request_id, coalesce(f.i - 1, t.n) AS event_no, coalesce(f.len, t.len) AS content_len, t.n, t.len FROM t LEFT JOIN f USING (request_id) WHERE t.len > 50)
    SELECT request_id, 1 AS scan_no, event_no::INT AS event_no, content_len FROM s UNION ALL SELECT request_id, 2, (n + 1)::INT, len FROM s WHERE len - content_len >= greatest(content_len // 10, 50)"""
)
def scan_triggers(v):
    return sse.scan_points(sse.deltas(sse.events(chunks(v))))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM scan_log), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
    SELECT user_id AS user, epoch_us(min(ts)) // 1000 AS started, (epoch_us(max(ts)) + 1800000000) // 1000 AS ended, array_to_string(list_sort(list(DISTINCT scan_result)), ',') AS symbols, count(*) AS lines FROM s GROUP BY user_id, n"""
)
def session_symbols(v):
    return sessions.session_symbols(v.scan_log, "user_id", "scan_result").select("user", F.unix_millis("started").alias("started"), F.unix_millis("ended").alias("ended"), F.array_join("symbols", ",").alias("symbols"), "lines")


_BODY = "CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN text WHEN doc_id % 5 = 0 THEN concat(substr(before, 1, length(before) - 3), 'xyz and more') ELSE concat(before, ' more') END"


@query(
    f"""WITH b AS (SELECT doc_id, text, doc_id // 2 AS project, lag(text) OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS before FROM documents), t AS (SELECT doc_id, project, {_BODY} AS body FROM b),
    o AS (SELECT *, lag(substr(body, 1, 8000)) OVER (PARTITION BY project ORDER BY doc_id) AS old FROM t), h AS (SELECT *, hex(encode(body)) AS n, hex(encode(old)) AS x FROM o),
    c AS (SELECT *, coalesce((SELECT min(i) FROM unnest(range(0, least(length(n), length(x)) // 2)) r(i) WHERE substr(n, 2 * i + 1, 2) <> substr(x, 2 * i + 1, 2)), least(length(n), length(x)) // 2) AS common FROM h)
    SELECT doc_id, CASE WHEN coalesce(old, '') = '' THEN body WHEN starts_with(body, old) THEN substr(body, length(old) + 1)
      WHEN common > least(length(n), length(x)) // 2 * 6 // 10 AND NOT regexp_matches(substr(n, 2 * common + 1, 2), '^[89AB]') THEN decode(unhex(substr(n, 2 * common + 1))) ELSE body END AS diff FROM c"""
)
def diff_tail(v):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy(F.floor(F.col("doc_id") / 2)).orderBy("doc_id"))
    texts = v.documents.select("doc_id", "text", F.floor(F.col("doc_id") / 2).alias("project"), before.alias("before"))
    return sessions.since_last(texts.select("doc_id", "project", F.expr(_BODY).alias("body")), "project", "doc_id", "body").select("doc_id", "diff")


@query(
    """WITH q AS (SELECT user_id AS client, ts, event_id FROM scan_log WHERE scan_result = 'warning') SELECT q.client, concat('w', q.event_id) AS warning, (SELECT event_id FROM scan_log r WHERE r.user_id = q.client AND r.scan_result <> 'warning' AND r.ts >= q.ts ORDER BY ts, event_id LIMIT 1) AS drained_by FROM q"""
)
def deferred_warnings(v):
    log = v.scan_log
    queue = log.where("scan_result = 'warning'").select(F.col("user_id").alias("client"), "ts", F.concat(F.lit("w"), "event_id").alias("warning"))
    return sessions.deferred(queue, log.where("scan_result <> 'warning'").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id")))
