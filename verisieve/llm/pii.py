"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds email, ip, card (Luhn) and phone are the base; iban (mod-97) and ssn
(nothing to verify, so it needs a context word) are added to them.  Each span
has a score: what its check is worth, and more with a context word close by;
it is in the result, and spans of the added kinds depend on it.

Everything is a native column expression.  Defined results: a null text counts
as empty and has no spans (redaction leaves it null); repeated rows are scanned
each; an empty table gives an empty result; further columns, also ones named
like the results, do not matter.  Texts are scanned whole.  The patterns differ
from their plain forms in possessive quantifiers and in where a match may
begin, which changes no match but keeps long runs linear.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, non_null_text
from .secrets import sql_spans
from .spans import bound, cut, find, labelled, pieces, settled, shown, walk

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: The first kinds are the base.
BASE = 4
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string,score:int>>"
#: Fixed patterns of the kinds, in their order.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: The same matches without repeated scans of a run or deep recursion; a card needs 13 digits at least.
FAST = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){12}(?:[\x20-]?+[0-9])*+",
}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|courriel|correo|kontakt",
    "ip": "ip|address|host|server|adresse|direcci",
    "card": "card|visa|mastercard|credit|payment|carte|tarjeta|karte",
    "phone": "phone|call|tel|telephone|mobile|fax|telefon|handy|appel|tel[eé]fono|t[eé]l[eé]phone",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
#: Scores are whole hundredths: of a span whose check passed, and what a context word adds.
WORTH = {"email": 90, "ip": 70, "card": 80, "phone": 60, "iban": 90, "ssn": 40}
CONTEXT_WORTH = {"email": 10, "ip": 10, "card": 10, "phone": 10, "iban": 10, "ssn": 40}
WINDOW = 40
#: Spans of the added kinds need this score; base spans always stay.
THRESHOLD = 50
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; every second digit from the right is doubled."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(1).alias("by")),
        lambda a, d: F.struct((a["sum"] + F.when(d.cast("int") * a["by"] > 9, d.cast("int") * a["by"] - 9).otherwise(d.cast("int") * a["by"])).alias("sum"), (F.lit(3) - a["by"]).alias("by")),
        lambda a: a["sum"] % 10,
    )
    return total == 0


def mod97(value: Column) -> Column:
    """Whether an account number's check digits are right: letters count as 10 to 35, the first four go last."""
    bare = F.regexp_replace(value, r"\x20", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    number = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97) == 1


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda v: F.length(digits_of(v)).between(low, high)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike(BYTE)),
    "card": lambda v: F.when(_between(13, 19)(v), luhn(digits_of(v))).otherwise(False),
    "phone": _between(9, 15),
    "iban": mod97,
    "ssn": lambda v: ~v.rlike("^(?:000|666|9)") & ~v.rlike("-00-") & ~v.rlike("-0000$"),
}


def context(kind: str) -> str:
    """The pattern of a context word of ``kind``, as a word of its own, in lower-cased text."""
    return f"(?:^|[^a-z])(?:{CONTEXT[kind]})(?:$|[^a-z])"


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: array of (start, rank, kind, end, value, score), by start, then kind; the score is in hundredths.

    Added kinds are left out where they overlap a base span or score too low.
    """
    body, found = fresh(docs, "_body"), fresh(docs, "_found")
    marked = docs.withColumn(body, non_null_text(text)).withColumn(found, F.concat(*[labelled(find(f"`{body}`", FAST[k], VALID[k]), k, i) for i, k in enumerate(KINDS)]))

    def scored(own: Column) -> Column:
        def score(s: Column) -> Column:
            around = F.lower(F.concat_ws(" ", cut(own, s["start"] - WINDOW, s["start"]), cut(own, s["end"], s["end"] + WINDOW)))
            by_kind = reduce(lambda rest, i: F.when(s["rank"] == i, F.lit(WORTH[KINDS[i]]) + F.when(around.rlike(context(KINDS[i])), CONTEXT_WORTH[KINDS[i]]).otherwise(0)).otherwise(rest), range(len(KINDS)), F.lit(0))
            return s.withField("score", by_kind)

        return F.transform(found, score)

    kept = F.filter(bound(pieces(F.col(body)), scored), lambda s: (s["rank"] < BASE) | (s["score"] >= THRESHOLD))
    return marked.withColumn(out, F.when(F.size(found) > 0, settled(kept, BASE)).otherwise(F.array().cast(SPANS))).drop(body, found)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, with each span of :func:`find_pii` as its kind in brackets.

    Spans that overlap go together, as the kind of the first of them.  The text
    is passed once, so the cost follows its length.  ``n_chars`` is renewed if
    there is one.
    """
    spans = fresh(docs, "_spans")

    def masked(s: Column, own: Column, whole: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            def put(x: Column) -> Column:
                new = F.array(cut(own, at, x["start"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
                return F.struct(F.greatest(at, x["end"]).alias("at"), F.when(x["start"] >= at, new).otherwise(F.array().cast("array<string>")).alias("out"))

            return bound(F.get(s, i), put)

        return bound(walk(F.size(s), "array<string>", step), lambda w: F.concat(F.array_join(w["out"], ""), cut(own, w["at"], F.length(whole))))

    found = find_pii(docs, text, spans)
    whole = F.col(f"`{text}`")
    clean = F.when(F.size(spans) > 0, bound(pieces(whole), lambda own: masked(F.col(spans), own, whole))).otherwise(whole)
    out = found.withColumn(text, clean).drop(spans)
    return out.withColumn("n_chars", F.length(text).cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts, the hash of the base spans, all spans, and their scores in hundredths in the same order."""
    s = find_pii(docs.select("doc_id", "text"))
    by_kind = s.select("doc_id", F.array_sort(F.transform("pii", lambda x: F.struct(*[x[c].alias(c) for c in ("rank", "start", "end", "kind", "score")]))).alias("pii"))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores")
    return by_kind.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(F.filter("pii", lambda x: x["rank"] < BASE)), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"), scores)


def oracle() -> str:
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    double = f"(substr(reverse({digits}), d::BIGINT, 1)::INT * (2 - d % 2))"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda d: CASE WHEN {double} > 9 THEN {double} - 9 ELSE {double} END)) % 10 = 0"
    bare = r"regexp_replace(v, '\x20', '', 'g')"
    moved = f"(substr({bare}, 5) || substr({bare}, 1, 4))"
    number = "(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)"
    mod = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({moved}, ''), lambda c: {number})), lambda a, n: (a * CASE WHEN n > 9 THEN 100 ELSE 10 END + n) % 97) = 1"
    valid = {
        "email": "true",
        "ip": f"len(list_filter(string_split(v, '.'), lambda p: NOT regexp_matches(p, '{BYTE}'))) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sql}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": mod,
        "ssn": "NOT regexp_matches(v, '^(?:000|666|9)') AND NOT contains(v, '-00-') AND NOT regexp_matches(v, '-0000$')",
    }
    part = lambda k: sql_spans(k, KINDS.index(k), PLAIN[k], valid[k])
    near = "lower(substr(body, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' ' || substr(body, e + 1, 40))"
    score = " ".join(f"WHEN '{k}' THEN {WORTH[k]} + CASE WHEN regexp_matches({near}, '{context(k)}') THEN {CONTEXT_WORTH[k]} ELSE 0 END" for k in KINDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
every AS ({' UNION ALL '.join(part(k) for k in KINDS)}),
scored AS (SELECT every.*, CASE kind {score} END AS score FROM every JOIN t USING (rid)),
base AS (SELECT * FROM scored WHERE rank < {BASE}), more AS (SELECT * FROM scored WHERE rank >= {BASE} AND score >= {THRESHOLD}),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND b.s < m.e AND m.s < b.e)),
found AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in KINDS)}, string_agg(score, ',' ORDER BY rank, s) AS scores,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < {BASE}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{x}, 0) AS n_{x}' for x in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM t LEFT JOIN found USING (rid)"""
