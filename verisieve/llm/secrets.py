"""Secret scan: three patterns, and character Markov models for the rest.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples; a run of token
characters counts as a secret when its log-likelihood ratio says random.  The
ratios are whole hundredths of a nat, so sums are exact in any engine.

Everything is a native column expression.  Defined results: a null text counts
as empty and has no spans; repeated rows are scanned each; an empty table gives
an empty result; further columns, also ones named like the results, do not
matter.  Texts are scanned whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, non_null_text
from .spans import bound, find, labelled, quoted, settled, shown

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the Markov models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-."
#: A run is random when its mean ratio per pair of characters is at least this many hundredths of a nat.
THRESHOLD = 50

#: Ordinary words from which labelled identifiers are composed.
WORDS = (
    "account action address amount array attribute author balance batch block body buffer button cache call category cell change channel child class client code collection column "
    "command comment config connection content context control count country current customer data database date default delete description detail device directory document domain "
    "download element email engine entity entry error event example export factory feature field file filter folder format frame function group handler header height history image "
    "import index information input instance integer interface item job key label language layer length level library limit line link list local location manager map member memory "
    "message method mode model module month name network node number object option order output owner package page parameter parent password path pattern payment permission person "
    "phone picture player point policy position price process product profile project property provider query queue range reader record reference region report request resource "
    "response result role root row rule sample schedule schema score screen script search section select sequence server service session setting shape size source stage start state "
    "status storage stream string style subject system table target task template test text theme thread time title token total transaction transfer type unit update upload user "
    "value variable version video view visible warning weight width window worker writer year the and that with from this have are not which their would there other been into more "
    "than nation ation ing tion entre pour dans avec para como este desde unter nicht werden zwischen über sein eine"
).split()


def default_samples(n: int = 3000) -> Iterable[tuple[str, bool]]:
    """Labelled strings made by rule, ``n`` times two random and two or three ordinary ones: (string, is random).

    Random are digests in several spellings, with and without digits; ordinary
    are composed words, numbers, and lines drawn with one or two characters.
    """
    letters = ALPHABET[:52]
    for i in range(n):
        h = hashlib.sha256(f"sample {i}".encode()).digest()
        long = base64.b64encode(h + h[::-1]).decode()
        bare = "".join(letters[b % 52] for b in h)
        yield long[: 20 + h[0] % 20], True
        yield (h.hex()[: 24 + h[1] % 24], base64.urlsafe_b64encode(h[::-1])[: 20 + h[1] % 20].decode(), bare, bare.lower(), bare.upper(), base64.b32encode(h).decode()[: 20 + h[1] % 20], h.hex().upper()[: 24 + h[1] % 24])[i % 7], True
        words = [WORDS[(h[k] << 8 | h[k + 1]) % len(WORDS)] for k in range(0, 8, 2)]
        yield ("_".join(words), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]), "-".join(words), "".join(words), "_".join(words).upper(), "/".join(words))[h[9] % 7], False
        yield (words[0] + str(h[10] % 100), f"{words[0]}_{1900 + h[11] % 200}", words[1] + "=" + words[2], words[0] + "------" + words[3], f"{1900 + h[11]}-{h[12] % 12 + 1:02}-{h[13] % 28 + 1:02}")[h[14] % 5], False
        if i % 10 == 0:
            a, b = ALPHABET[i // 20 % len(ALPHABET)], ALPHABET[h[15] % len(ALPHABET)]
            yield (a * (20 + h[16] % 20) if i % 20 else ((a + b) * 12, letters[:26], "0123456789" * 3)[h[17] % 3]), False


def train(samples: Iterable[tuple[str, bool]], alphabet: str = ALPHABET, smoothing: float = 0.5) -> list[int]:
    """The table of log-likelihood ratios, random to ordinary, of each pair of characters, row by row.

    Bounded: it holds two square tables over the alphabet, whatever the number of samples.
    """
    k = len(alphabet)
    at = {c: i for i, c in enumerate(alphabet)}
    counts = {kind: [[smoothing] * k for _ in range(k)] for kind in (True, False)}
    for s, kind in samples:
        for a, b in zip(s, s[1:]):
            if a in at and b in at:
                counts[kind][at[a]][at[b]] += 1
    out = []
    for i in range(k):
        random_all, ordinary_all = sum(counts[True][i]), sum(counts[False][i])
        for j in range(k):
            out.append(round(100 * math.log(counts[True][i][j] / random_all * ordinary_all / counts[False][i][j])))
    return out


@cache
def default_model() -> tuple[int, ...]:
    return tuple(train(default_samples()))


def assignment(match: Column) -> Column:
    """Whether the assigned value (group 2) has six characters at least."""
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def is_random(token: Column, model: tuple[int, ...], threshold: int) -> Column:
    """Whether the models call a run random: its summed ratio reaches the threshold for each pair of its characters."""
    k = len(ALPHABET)
    table = F.expr("array(" + ",".join(map(str, model)) + ")")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def judged(x: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(0), F.size(x) - 2), F.lit(0), lambda acc, i: acc + F.get(table, F.get(x, i) * k + F.get(x, i + 1)))
        return total >= threshold * (F.size(x) - 1)

    return bound(codes, judged)


def scan_secrets(docs: DataFrame, text: str = "text", model: tuple[int, ...] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Adds ``secrets``: array of (start, rank, kind, end, value), by start, then kind.

    A run that the models flag is left out where it overlaps a base span.
    """
    model = model or default_model()
    body, found = fresh(docs, "_body"), fresh(docs, "_found")
    always = lambda m: F.lit(True)
    kinds = zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), (assignment, always, always, lambda m: is_random(m, model, threshold)), strict=True)
    parts = [labelled(find(f"`{body}`", rx, ok), kind, i) for i, (kind, rx, ok) in enumerate(kinds)]
    marked = docs.withColumn(body, non_null_text(text)).withColumn(found, F.concat(*parts))
    return marked.withColumn("secrets", settled(F.col(found), 3)).drop(body, found)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts, the hash of the base spans and all spans."""
    s = scan_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select("doc_id", *[count(k) for k in KINDS], F.sha2(shown(F.filter("secrets", lambda x: x["rank"] < 3)), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))


def sql_spans(kind: str, rank: int, pattern: str, valid: str = "true", source: str = "t", where: str = "") -> str:
    """DuckDB's list of spans of ``pattern`` in column ``body`` of ``source``: rows (rid, rank, kind, s, e, v)."""
    rx = quoted(pattern)[1:]
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, s, s + length(v) AS e, v FROM (
  SELECT rid, m[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT rid, m, regexp_split_to_array(body, {rx}) AS g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT rid, body, regexp_extract_all(body, {rx}) AS m FROM {source} {where}) WHERE len(m) > 0)) WHERE {valid}"""


def oracle() -> str:
    k, model = len(ALPHABET), default_model()
    code = lambda i: f"strpos('{ALPHABET}', substr(v, {i}, 1))"
    total = f"list_sum(list_transform(range(1, length(v)), lambda i: r[({code('i::BIGINT')} - 1) * {k} + {code('i::BIGINT + 1')}]))"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
model AS (SELECT [{', '.join(map(str, model))}] AS r),
base AS ({sql_spans('assign', 0, ASSIGN, f"length(regexp_extract(v, {quoted(ASSIGN)[1:]}, 2)) >= 6")} UNION ALL {sql_spans('access', 1, ACCESS)} UNION ALL {sql_spans('hex', 2, HEX)}),
runs AS ({sql_spans('markov', 3, CANDIDATE)}),
random AS (SELECT runs.* FROM runs, model WHERE {total} >= {THRESHOLD} * (length(v) - 1)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM random r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.e AND r.s < b.e)),
found AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in KINDS)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{x}, 0) AS n_{x}' for x in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN found USING (rid)"""
