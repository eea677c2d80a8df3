"""Queries over findings, logs and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, scoring, telemetry
from .registry import query

def names(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_BARE = "regexp_replace(warning, '^forge: ', '')"
_KIND = "CASE " + " ".join(f"WHEN starts_with({_BARE}, '{p}') THEN '{k}'" for p, k in scoring.WARNING_KINDS) + " ELSE 'other' END"
_KINDS = f"k AS (SELECT *, {_KIND} AS kind, regexp_extract(warning, '`([^`]*)`', 1) AS claim FROM findings)"
_TERMS = " + ".join(f"count(*) FILTER (kind IN {names(m)}) * {w}::DOUBLE" if cap is None else f"least(count(*) FILTER (kind IN {names(m)}) * {w}::DOUBLE, {cap}::DOUBLE)" for m, w, cap in scoring.WEIGHTS.values())
_RISK = f"""r AS (SELECT response_id, count(*) FILTER (kind NOT IN ('logic', 'uncertain')) AS n_warnings, bool_or(blocked) AS blocked, count(*) FILTER (kind IN ('l1', 'unverified')) AS l1, bool_or(regexp_matches(warning, '{scoring.INTROSPECTION}')) AS introspected, count(*) FILTER (kind = 'other') AS unknown, bool_or(kind = 'logic') AS has_prose,
    round(CASE WHEN bool_or(blocked) THEN 1.0 ELSE least(CASE WHEN bool_or(scan_failed) AND count(*) FILTER (kind NOT IN ('logic', 'uncertain')) > 0 THEN greatest({_TERMS}, 0.4) ELSE {_TERMS} END, 1.0) END, 6)::DOUBLE AS risk FROM k GROUP BY response_id),
    s AS (SELECT *, CASE WHEN n_warnings = 0 AND NOT blocked THEN 1.0 ELSE round(least(1.0, 1 - least(risk, 0.9)), 6) END::DOUBLE AS confidence FROM r)"""


@query(f"WITH {_KINDS} SELECT kind, count(*) AS n, count(DISTINCT claim) AS claims FROM k GROUP BY kind")
def warning_kinds(v):
    return v.findings.withColumn("kind", scoring.warning_kind(F.col("warning"))).withColumn("claim", scoring.claim_key(F.col("warning"))).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("claim").alias("claims"))


@query(f"WITH {_KINDS}, {_RISK} SELECT response_id, n_warnings, blocked, risk, confidence FROM s")
def risk_score(v):
    return scoring.risk(v.findings).select("response_id", "n_warnings", "blocked", "risk", "confidence")


@query(f"WITH {_KINDS}, {_RISK} SELECT CASE WHEN risk >= 0.7 THEN 'block' WHEN risk >= 0.3 THEN 'append' ELSE 'pass' END AS action, l1 = 0 AND confidence >= 0.85 AND unknown = 0 AND NOT introspected AND NOT has_prose AS skipped, count(*) AS n FROM s GROUP BY 1, 2")
def cascade_split(v):
    claims = v.findings.withColumn("kind", scoring.warning_kind(F.col("warning"))).groupBy("response_id").agg(F.count("*").alias("claims"), F.count_if(F.col("kind") == "other").alias("unknown"), F.bool_or(F.col("kind") == "logic").alias("has_prose"))
    return scoring.cascade(scoring.risk(v.findings).join(claims, "response_id")).groupBy(scoring.intervention(F.col("risk")).alias("action"), "skipped").agg(F.count("*").alias("n"))


@query(f"WITH {_KINDS} SELECT claim, max(CASE {' '.join(f"WHEN kind = '{k}' THEN {c}" for k, c in scoring.KIND_CONFIDENCE.items())} ELSE 0.5 END)::DOUBLE AS confidence FROM k WHERE claim <> '' GROUP BY claim")
def warning_confidence(v):
    f = v.findings.select(scoring.claim_key(F.col("warning")).alias("claim"), scoring.kind_confidence(scoring.warning_kind(F.col("warning"))).alias("confidence"))
    return scoring.strongest(f)


@query("SELECT response_id, coalesce(min(CASE WHEN seq % 2 = 0 THEN confidence END), 1.0)::DOUBLE AS cache, coalesce(min(CASE WHEN seq % 2 = 1 THEN confidence END), 1.0)::DOUBLE AS forge, least(cache, forge) AS combined FROM judge GROUP BY response_id")
def scan_confidence(v):
    return scoring.scan_confidence(v.judge.withColumn("layer", F.when(F.col("seq") % 2 == 0, "cache").otherwise("forge")))


@query("SELECT claim, max(confidence) AS confidence FROM judge GROUP BY claim")
def claim_confidence(v):
    return scoring.strongest(v.judge)


@query(
    """SELECT response_id, count(*) FILTER (verdict = 'hallucinated' AND confidence >= 0.6) AS strong, count(*) FILTER (verdict = 'hallucinated' AND confidence < 0.6) AS weak, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (verdict = 'verified') AS verified,
    round(least(sum(CASE WHEN verdict = 'hallucinated' AND confidence >= 0.6 THEN 0.20 WHEN verdict = 'hallucinated' THEN 0.06 WHEN verdict = 'uncertain' THEN 0.02 ELSE 0 END), 0.6), 6)::DOUBLE AS delta FROM judge GROUP BY response_id"""
)
def judge_aggregate(v):
    return scoring.judged(v.judge)


def _sql_calibration() -> str:
    low = "lower(text)"
    occur = lambda words: "(" + " + ".join(f"(len(string_split({low}, {names([w])[1:-1]})) - 1)" for w in words) + ")"
    steps = f"list_filter(list_transform(regexp_split_to_array({low}, '[.|\\n]'), lambda x: trim(x)), lambda x: strlen(x) > 10)"
    has = lambda words: f"regexp_matches(x, '{'|'.join(words)}')"
    hit = f"CASE verdict WHEN 'verified' THEN {has(scoring.STEP_FOR)} WHEN 'hallucinated' THEN {has(scoring.STEP_AGAINST)} ELSE {has(scoring.STEP_FOR)} <> {has(scoring.STEP_AGAINST)} END"
    s, r = occur(scoring.ALL_FOR), occur(scoring.ALL_AGAINST)
    margin = f"CASE verdict WHEN 'verified' THEN ({s} - {r})::DOUBLE / ({s} + {r}) WHEN 'hallucinated' THEN ({r} - {s})::DOUBLE / ({s} + {r}) ELSE 0.5 - abs({s} - {r})::DOUBLE / ({s} + {r}) * 0.5 END"
    features = [
        f"CASE WHEN len({steps}) = 0 THEN 0.5 ELSE len(list_filter({steps}, lambda x: {hit}))::DOUBLE / len({steps}) END",
        f"CASE WHEN {s} + {r} = 0 THEN 0.5 ELSE ({margin} + 1.0) / 2.0 END",
        "least(coalesce(list_sum(list_transform(range(2, len(string_split(text, '`')) + 1, 2), lambda i: strlen(string_split(text, '`')[i]))), 0)::DOUBLE / greatest(strlen(text), 1) * 5.0, 1.0)",
        occur(scoring.HEDGES), occur(scoring.NEGATIONS), "CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END",
    ]
    total = lambda v: " + ".join([f"({f}) * ({w})::DOUBLE" for f, w in zip(features, scoring.CALIBRATION[v])]) + f" + {scoring.BIAS}"
    z = f"CASE verdict WHEN 'verified' THEN {total('verified')} WHEN 'hallucinated' THEN {total('hallucinated')} ELSE {total('')} END"
    return f"""WITH j AS (SELECT item_id, concat(text, ' it is not found. `', substr(text, 1, 9), '` might exist') AS text, CASE item_id % 4 WHEN 0 THEN 'hallucinated' WHEN 1 THEN 'verified' WHEN 2 THEN 'odd' ELSE 'uncertain' END AS verdict, (item_id % 10)::DOUBLE / 10 AS confidence FROM benchmark)
    SELECT item_id, CASE WHEN verdict = 'odd' THEN 'uncertain' ELSE verdict END AS verdict, CASE WHEN verdict = 'odd' THEN 0.0 ELSE round(greatest(least(0.7::DOUBLE / (1 + exp(-({z}))) + 0.3::DOUBLE * confidence, 1.0), 0.0), 6) END::DOUBLE AS calibrated FROM j"""


@query(_sql_calibration())
def calibrate_confidence(v):
    j = v.benchmark.withColumn("verdict", F.expr("CASE item_id % 4 WHEN 0 THEN 'hallucinated' WHEN 1 THEN 'verified' WHEN 2 THEN 'odd' ELSE 'uncertain' END")).withColumn("confidence", (F.col("item_id") % 10).cast("double") / 10)
    reason = F.concat("text", F.lit(" it is not found. `"), F.substring("text", 1, 9), F.lit("` might exist"))
    verdict, sure = scoring.finalized(F.col("verdict"), F.col("confidence"), reason)
    return j.select("item_id", verdict.alias("verdict"), sure.alias("calibrated"))


@query(
    f"WITH {_KINDS} SELECT kind, count(*) AS n FROM k WHERE NOT (regexp_matches(lower(warning), 'not defined|not found|does not exist|undefined') AND NOT regexp_matches(warning, '^(?:forge: )?compiler:') AND claim IN (SELECT concat(p, i) FROM (VALUES ('m'), ('p')) t(p), range(0, 25) r(i))) GROUP BY kind"
)
def post_filter(v):
    known = v.spark.range(25).select(F.explode(F.array(F.concat(F.lit("m"), F.col("id")), F.concat(F.lit("p"), F.col("id")))).alias("key"))
    return scoring.contradicted(v.findings, known).groupBy(scoring.warning_kind(F.col("warning")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE l AS (SELECT request_id, event_id, CASE scan_result WHEN 'blocked' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'clean' THEN 1 ELSE 0 END AS sev, risk, model, tokens, latency_ms, scan_result,
      row_number() OVER (PARTITION BY request_id ORDER BY event_id DESC) AS n FROM scan_log),
    w AS (SELECT request_id, n, event_id, sev, risk, model, tokens, latency_ms, scan_result FROM l WHERE n = 1
      UNION ALL SELECT b.request_id, b.n, CASE WHEN x THEN b.event_id ELSE a.event_id END, CASE WHEN x THEN b.sev ELSE a.sev END, CASE WHEN x THEN b.risk ELSE a.risk END,
        CASE WHEN x THEN (CASE WHEN b.model = '' THEN a.model ELSE b.model END) ELSE (CASE WHEN a.model = '' THEN b.model ELSE a.model END) END,
        CASE WHEN x THEN (CASE WHEN b.tokens = 0 THEN a.tokens ELSE b.tokens END) ELSE (CASE WHEN a.tokens = 0 THEN b.tokens ELSE a.tokens END) END,
        CASE WHEN x THEN (CASE WHEN b.latency_ms = 0 THEN a.latency_ms ELSE b.latency_ms END) ELSE (CASE WHEN a.latency_ms = 0 THEN b.latency_ms ELSE a.latency_ms END) END, CASE WHEN x THEN b.scan_result ELSE a.scan_result END
      FROM w a JOIN l b ON b.request_id = a.request_id AND b.n = a.n + 1, LATERAL (SELECT b.sev > a.sev OR (b.sev = a.sev AND b.risk > a.risk) OR (b.sev = a.sev AND b.risk = a.risk AND a.model = '' AND b.model <> '') AS x) z)
    SELECT request_id, event_id, scan_result, risk, model, tokens, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC) AS k FROM w) WHERE k = 1"""
)
def request_collapse(v):
    return telemetry.collapse(v.scan_log)


_COUNTS = "SELECT count(*) AS requests, " + ", ".join(f"count(*) FILTER (scan_result = '{r}') AS {r}" for r in ("clean", "warning", "blocked", "error", "skipped")) + ", sum(tokens)::BIGINT AS tokens, round(avg(risk), 6) AS avg_risk FROM {}"


@query(_COUNTS.format("scan_log"))
def request_counters(v):
    return telemetry.counters(v.scan_log)


@query(_COUNTS.format("(SELECT * FROM scan_log ORDER BY ts DESC, event_id DESC LIMIT 200)").replace("FROM (SELECT * FROM scan_log", "FROM (SELECT * FROM scan_log"))
def verdict_counts(v):
    return telemetry.counters(telemetry.newest(v.scan_log, 200))


@query("WITH n AS (SELECT list(latency_ms ORDER BY latency_ms) AS v FROM (SELECT * FROM scan_log ORDER BY ts DESC, event_id DESC LIMIT 200)) SELECT v[1 + round(0.5 * (len(v) - 1))::INT] AS p50, v[1 + round(0.95 * (len(v) - 1))::INT] AS p95, v[1 + round(0.99 * (len(v) - 1))::INT] AS p99 FROM n")
def latency_percentiles(v):
    return telemetry.percentiles(v.scan_log)


@query("SELECT b.le, count(*) FILTER (latency_ms <= b.bound) AS n, sum(latency_ms)::BIGINT AS total FROM scan_log, (VALUES " + ", ".join(f"('{b}', {b})" for b in telemetry.BOUNDS) + ", ('+Inf', 9223372036854775807)) b(le, bound) GROUP BY b.le")
def latency_histogram(v):
    return telemetry.histogram(v.scan_log)


@query("SELECT phase, round(coalesce(avg(risk), 0), 6) AS avg_risk FROM scan_log GROUP BY phase")
def avg_risk(v):
    return v.scan_log.groupBy("phase").agg(F.round(F.coalesce(F.avg("risk"), F.lit(0.0)), 6).alias("avg_risk"))


@query("SELECT event_id, request_id, scan_result FROM scan_log ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_requests(v):
    return telemetry.newest(v.scan_log, 20).select("event_id", "request_id", "scan_result")


@query("SELECT user_id, event_id, rank::INT AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM scan_log) WHERE rank <= 50")
def ring_50(v):
    return telemetry.ring(v.scan_log, "user_id").select("user_id", "event_id", "rank")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER () AS total FROM scan_log) WHERE total <= 1000 OR n <= 500")
def retention_500(v):
    return telemetry.retain(v.scan_log).select("event_id")


@query("WITH c AS (" + _COUNTS.format("scan_log") + ") SELECT n::INT AS n, line FROM (" + " UNION ALL ".join(f"SELECT {i} AS n, concat('scan_{c}_total ', {c}) AS line FROM c" for i, c in enumerate(("requests", "clean", "warning", "blocked", "error", "skipped", "tokens"))) + ")")
def prometheus_lines(v):
    return telemetry.exposition(telemetry.counters(v.scan_log))


@query("WITH k AS (SELECT user_id, max(ts) AS inserted_at, count(*) AS lines FROM scan_log GROUP BY user_id) SELECT user_id, lines FROM k WHERE epoch(inserted_at) > (SELECT epoch(max(ts)) FROM scan_log) - 86400 ORDER BY inserted_at DESC, user_id LIMIT 500")
def verdict_cache(v):
    return telemetry.cached(v.scan_log, 86400, 500).select("user_id", "lines")


_CELLS = "count(*) FILTER (predicted AND truth) AS tp, count(*) FILTER (predicted AND NOT truth) AS fp, count(*) FILTER (NOT predicted AND truth) AS fn, count(*) FILTER (NOT predicted AND NOT truth) AS tn"
_RATIO = "round(coalesce(({0})::DOUBLE / nullif({1}, 0), 0), 6)"


@query(f"SELECT *, {_RATIO.format('tp', 'tp + fp')} AS precision, {_RATIO.format('tp', 'tp + fn')} AS recall, {_RATIO.format('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT {_CELLS} FROM predictions)")
def confusion_matrix(v):
    return evaluation.confusion(v.predictions)


@query(
    """WITH g AS (SELECT language, count(*) FILTER (predicted = truth) AS hits, count(*) AS n FROM predictions GROUP BY language), p AS (SELECT *, hits::DOUBLE / n AS p, 1.96 * 1.96 AS zz FROM g)
    SELECT language, hits, n, round(greatest((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 0), 6)::DOUBLE AS low, round(least((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 1), 6)::DOUBLE AS high FROM p"""
)
def wilson_ci(v):
    return evaluation.intervals(v.predictions, "language")


@query(f"SELECT coalesce(language, '*') AS language, coalesce(claim_type, '*') AS claim_type, tp, fp, fn, {_RATIO.format('tp', 'tp + fn')} AS recall FROM (SELECT language, claim_type, {_CELLS} FROM predictions GROUP BY GROUPING SETS ((), (language), (claim_type)))")
def recall_grouping_sets(v):
    return evaluation.recall_by(v.predictions)


@query("SELECT count(*) FILTER (flagged_a AND NOT flagged_b AND truth) AS only_a_true, count(*) FILTER (flagged_a AND NOT flagged_b AND NOT truth) AS only_a_false, count(*) FILTER (flagged_b AND NOT flagged_a AND truth) AS only_b_true, count(*) FILTER (flagged_b AND NOT flagged_a AND NOT truth) AS only_b_false, count(*) FILTER (flagged_a AND flagged_b) AS both, count(*) FILTER (NOT flagged_a AND NOT flagged_b) AS neither FROM predictions")
def set_difference_ab(v):
    return evaluation.set_difference(v.predictions)


@query("WITH b AS (SELECT least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS c, avg(truth::INT) AS a FROM predictions GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, count(*) AS bins FROM b")
def ece(v):
    return evaluation.calibration_error(v.predictions)


@query("SELECT round(avg(pow(confidence - truth::INT, 2)), 6) AS brier FROM predictions")
def brier(v):
    return evaluation.brier(v.predictions)


@query("SELECT user_id AS task, phase AS arm, arg_max(event_id, (ts, event_id)) AS run_id FROM scan_log GROUP BY user_id, phase")
def newest_run(v):
    return evaluation.newest_run(v.scan_log.select(F.col("user_id").alias("task"), F.col("phase").alias("arm"), F.col("event_id").alias("run_id"), "ts"))


@query(f"WITH {_KINDS}, e AS (SELECT response_id, bool_or(kind = 'cached') AS a, bool_or(kind IN {names(scoring.FORGE_KINDS)}) AS b, bool_or(kind = 'logic') AS c FROM k GROUP BY response_id) SELECT count(*) FILTER (a) AS l15, count(*) FILTER (b) AS l2, count(*) FILTER (c) AS l3, count(*) FILTER (a OR b OR c) AS hit, count(*) AS responses FROM e")
def layer_hits(v):
    kind = scoring.warning_kind(F.col("warning"))
    return evaluation.layer_hits(v.findings.withColumn("kind", F.when(kind.isin(*scoring.FORGE_KINDS), "forge").otherwise(kind)))
