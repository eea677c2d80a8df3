"""From findings to scores: warning kinds, risk, confidence, the judge's verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of warnings and the kinds they make, in the order in which they are tried, after a leading ``forge: ``.
WARNING_KINDS: Sequence[tuple[str, str]] = (
    ("hallucinated-import-name:", "import_name"),
    ("hallucinated-import:", "import"),
    ("hallucinated-include:", "include"),
    ("hallucinated-method:", "method"),
    ("hallucinated-parameter:", "parameter"),
    ("hallucinated-variable:", "variable"),
    ("hallucinated-function:", "function"),
    ("hallucinated-constructor:", "constructor"),
    ("hallucinated-call:", "call"),
    ("hallucinated-namespace:", "namespace"),
    ("bare-critical-call:", "bare_critical"),
    ("chain-broken:", "chain_broken"),
    ("chain-phantom-member:", "chain_phantom"),
    ("cached-hallucination:", "cached"),
    ("scope-hallucination:", "scope"),
    ("Hallucinated API:", "l1"),
    ("Unverified API:", "unverified"),
    ("compiler:", "compiler"),
    ("logic (uncertain):", "uncertain"),
    ("logic:", "logic"),
)
#: Kinds that the language layer finds; they weigh alike.
FORGE_KINDS = tuple(k for _, k in WARNING_KINDS[:13])
#: How sure a finding of a kind makes its claim; others half.
KIND_CONFIDENCE = {
    "include": 0.95, "method": 0.95, "parameter": 0.95, "import": 0.90, "bare_critical": 0.90, "variable": 0.85, "function": 0.85, "chain_broken": 0.85, "import_name": 0.80, "chain_phantom": 0.80, "call": 0.75, "constructor": 0.70,
}
#: Weight of one finding of a group of kinds and the most that the group adds; none means no bound.
WEIGHTS: dict[str, tuple[tuple[str, ...], float, float | None]] = {
    "cached": (("cached",), 0.40, None),
    "scope": (("scope",), 0.40, None),
    "forge": (FORGE_KINDS, 0.40, None),
    "l1": (("l1",), 0.10, 0.3),
    "unverified": (("unverified",), 0.08, 0.6),
    "logic": (("logic",), 0.15, 0.6),
    "uncertain": (("uncertain",), 0.10, 0.4),
    "compiler": (("compiler",), 0.35, 0.7),
}


def warning_kind(warning: Column) -> Column:
    """The kind by the prefix, which ends at the first colon; ``other`` weighs nothing."""
    return looked_up(F.regexp_extract(warning, "^(?:forge: )?([^:]*:)", 1), dict(WARNING_KINDS), "other")


def looked_up(key: Column, values: Mapping[str, Any], default: Any) -> Column:
    """The value of a key in a literal map; one look-up, however many values there are."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def kind_confidence(kind: Column) -> Column:
    return looked_up(kind, KIND_CONFIDENCE, 0.5)


def claim_key(warning: Column) -> Column:
    """The first token in back ticks, empty without one."""
    return F.regexp_extract(warning, "`([^`]*)`", 1)


def risk(findings: DataFrame) -> DataFrame:
    """Risk and confidence of each response from its findings (warning, blocked, scan_failed).

    A failed scan has a floor, but only with a warning or a block; details of
    the logic check are no warnings.
    """
    kinds = findings.withColumn("kind", warning_kind(F.col("warning")))
    counted = kinds.groupBy("response_id").agg(
        *[F.count_if(F.col("kind").isin(*members)).alias(k) for k, (members, _, _) in WEIGHTS.items()],
        F.count_if(~F.col("kind").isin("logic", "uncertain")).alias("n_warnings"), F.bool_or("blocked").alias("blocked"), F.bool_or("scan_failed").alias("failed"),
        F.bool_or(F.col("warning").rlike(INTROSPECTION)).alias("introspected"),
    )
    parts = [(F.col(k) * w if cap is None else F.least(F.col(k) * w, F.lit(cap))) for k, (_, w, cap) in WEIGHTS.items()]
    total = reduce(lambda a, b: a + b, parts)
    floored = F.when(F.col("failed") & (F.col("n_warnings") > 0), F.greatest(total, F.lit(0.4))).otherwise(total)
    scored = counted.withColumn("risk", F.round(F.when(F.col("blocked"), 1.0).otherwise(F.least(floored, F.lit(1.0))), 6))
    return scored.withColumn("confidence", F.when((F.col("n_warnings") == 0) & ~F.col("blocked"), 1.0).otherwise(F.round(F.least(F.lit(1.0), 1 - F.least("risk", F.lit(0.9))), 6)))


def scan_confidence(verdicts: DataFrame) -> DataFrame:
    """The least confidence of a response's checked claims, 1 without any, for each layer and over both."""
    both = verdicts.groupBy("response_id").agg(F.min(F.when(F.col("layer") == "cache", F.col("confidence"))).alias("cache"), F.min(F.when(F.col("layer") == "forge", F.col("confidence"))).alias("forge"))
    filled = both.select("response_id", F.coalesce("cache", F.lit(1.0)).alias("cache"), F.coalesce("forge", F.lit(1.0)).alias("forge"))
    return filled.withColumn("combined", F.least("cache", "forge"))


def strongest(findings: DataFrame) -> DataFrame:
    """The highest confidence that any finding gives each claim."""
    return findings.where("claim <> ''").groupBy("claim").agg(F.max("confidence").alias("confidence"))


def judged(verdicts: DataFrame) -> DataFrame:
    """What the judge's verdicts add: 0.20 for a sure hallucination (0.6 on), 0.06 for an unsure one, 0.02 for an uncertain claim; 0.6 at most."""
    hit, sure = F.col("verdict") == "hallucinated", F.col("confidence") >= 0.6
    return verdicts.groupBy("response_id").agg(
        F.count_if(hit & sure).alias("strong"),
        F.count_if(hit & ~sure).alias("weak"),
        F.count_if(F.col("verdict") == "uncertain").alias("uncertain"),
        F.count_if(F.col("verdict") == "verified").alias("verified"),
        F.round(F.least(F.sum(F.when(hit & sure, 0.20).when(hit, 0.06).when(F.col("verdict") == "uncertain", 0.02).otherwise(0.0)), F.lit(0.6)), 6).alias("delta"),
    )


#: Warnings that come from introspection, and the confidence from which on the judge is not asked.
INTROSPECTION = "not in module|not a method|not in known methods|^(?:forge: )?chain-(?:phantom|broken)"
SURE = 0.85


def cascade(scored: DataFrame) -> DataFrame:
    """Adds ``skipped``: whether the deterministic layers settle a response, all of six conditions.

    Expects l1, unverified, introspected and confidence of :func:`risk`, and
    claims, unknown and has_prose of the claim checks.
    """
    settled = (F.col("l1") + F.col("unverified") == 0) & (F.col("confidence") >= SURE) & (F.col("unknown") == 0) & ~F.col("introspected") & (F.col("claims") > 0) & ~F.col("has_prose")
    return scored.withColumn("skipped", settled)


def intervention(risk_column: Column) -> Column:
    """append from 0.3, block from 0.7 on."""
    return F.when(risk_column >= 0.7, "block").when(risk_column >= 0.3, "append").otherwise("pass")


#: Weights of the calibration's features for a verdict, its bias, and its share in the result.
CALIBRATION = {"verified": (0.25, 0.30, 0.15, -0.08, -0.10, -0.002), "hallucinated": (0.20, 0.25, 0.20, -0.08, -0.10, -0.002), "": (0.15, 0.15, 0.15, -0.06, -0.08, -0.001)}
BIAS, BLEND = 0.10, 0.7
#: Words that speak for a claim and against it, in steps and over all, that hedge and that negate.
STEP_FOR = ("exist", "found", "verified", "confirmed", "valid", "real", "supported", "correct", "available", "present")
STEP_AGAINST = ("not exist", "not found", "hallucinated", "invalid", "fake", "fabricated", "missing", "unsupported", "incorrect", "absent")
ALL_FOR = ("exist", "found", "verified", "confirmed", "valid", "real", "correct")
ALL_AGAINST = ("not exist", "hallucinated", "invalid", "fake", "missing", "incorrect")
HEDGES = ("might", "possibly", "perhaps", "maybe", "could", "seems", "appear", "likely", "unclear")
NEGATIONS = ("not ", "no ", "never", "doesn't", "don't", "won't", "isn't", "aren't", "cannot")


def occurrences(text: Column, words: Sequence[str]) -> Column:
    """How often the words occur, each counted by itself."""
    return reduce(lambda a, b: a + b, [F.size(F.split(text, w, -1)) - 1 for w in words])


def reason_features(verdict: Column, reason: Column) -> list[Column]:
    """Agreement of the reason's steps with the verdict, its margin, its grounding in quotes, hedges, negations and words."""
    low = F.lower(reason)
    steps = F.filter(F.transform(F.split(low, r"[.|\n]"), lambda x: F.trim(x)), lambda x: F.octet_length(x) > 10)
    has = lambda x, words: x.rlike("|".join(words))

    def aligned(x: Column) -> Column:
        return F.when(verdict == "verified", has(x, STEP_FOR)).when(verdict == "hallucinated", has(x, STEP_AGAINST)).otherwise(has(x, STEP_FOR) != has(x, STEP_AGAINST))

    agreement = F.when(F.size(steps) == 0, 0.5).otherwise(F.size(F.filter(steps, aligned)) / F.size(steps))
    support, refute = occurrences(low, ALL_FOR), occurrences(low, ALL_AGAINST)
    total = support + refute
    margin = F.when(verdict == "verified", (support - refute) / total).when(verdict == "hallucinated", (refute - support) / total).otherwise(0.5 - F.abs(support - refute) / total * 0.5)
    quoted_bytes = F.aggregate(F.filter(F.split(reason, "`", -1), lambda x, i: i % 2 == 1), F.lit(0), lambda a, x: a + F.octet_length(x))
    grounding = F.least(quoted_bytes / F.greatest(F.octet_length(reason), F.lit(1)) * 5.0, F.lit(1.0))
    words = F.when(F.trim(reason) == "", 0).otherwise(F.size(F.split(F.trim(reason), r"\s+")))
    return [agreement, F.when(total == 0, 0.5).otherwise((margin + 1.0) / 2.0), grounding, occurrences(low, HEDGES), occurrences(low, NEGATIONS), words]


def calibrated(verdict: Column, confidence: Column, reason: Column) -> Column:
    """The judge's confidence, blended with what its reason's wording is worth."""
    features = reason_features(verdict, reason)
    total = lambda v: reduce(lambda a, b: a + b, [f * w for f, w in zip(features, CALIBRATION[v], strict=True)]) + BIAS
    logit = F.when(verdict == "verified", total("verified")).when(verdict == "hallucinated", total("hallucinated")).otherwise(total(""))
    return F.round(F.greatest(F.least(BLEND / (1 + F.exp(-logit)) + (1 - BLEND) * confidence, F.lit(1.0)), F.lit(0.0)), 6)


def finalized(verdict: Column, confidence: Column, reason: Column) -> tuple[Column, Column]:
    """The judge's verdict and confidence: an unknown label is uncertain, at zero."""
    known = verdict.isin("verified", "hallucinated", "uncertain")
    return F.when(known, verdict).otherwise("uncertain"), F.when(known, calibrated(verdict, confidence, reason)).otherwise(0.0)


def quote_found(quote: Column, *places: Column) -> Column:
    """Whether a quote of four bytes at least stands in one of the places."""
    q = F.trim(F.regexp_replace(F.trim(quote), '^"+|"+$', ""))
    return (F.octet_length(q) >= 4) & reduce(lambda a, b: a | b, [F.coalesce(p.contains(q), F.lit(False)) for p in places])


def parsed_verdict(content: Column) -> Column:
    """The judge's object of an answer: without a code fence, after the reasoning, from the first brace to the last."""
    bare = F.regexp_replace(F.trim(content), r"^```[a-z]*\n?|\n?```$", "")
    tail = F.when(bare.contains("</reasoning>"), F.regexp_extract(bare, r"(?s)</reasoning>(.*)$", 1)).otherwise(bare)
    return F.from_json(F.regexp_extract(tail, r"(?s)(\{.*\})", 1), "verdict string, confidence double, reason string, quote string")


def contradicted(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings without those that deny the existence of a symbol that is known; a compiler's stay."""
    key = claim_key(F.col("warning"))
    denies = F.lower("warning").rlike("not defined|not found|does not exist|undefined") & ~F.col("warning").rlike("^(?:forge: )?compiler:")
    marked = findings.withColumn("key", key).withColumn("denies", denies)
    return marked.join(known.select("key", F.lit(True).alias("is_known")).distinct(), "key", "left").where(~(F.col("denies") & F.coalesce("is_known", F.lit(False)))).drop("key", "denies", "is_known")
