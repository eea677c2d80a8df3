"""Benchmark decontamination by spaced seeds.

Fixed masks ignore some token positions, so a hash of the others survives
substitutions there.  Seeds of the benchmark and of the texts are joined; around
each hit the item is laid along its diagonal, and the overlap counts when a
window of it agrees in nearly all tokens.

The masks are complete: any window of ``WINDOW`` tokens with at most
``WINDOW - NEEDED`` substitutions contains a whole seed, so no such overlap is
missed.  Items shorter than the window are compared as a whole, by the same
share of tokens, from seeds of three tokens in a row; items of up to five
tokens must occur exactly.

A benchmark of up to ``BLOCK_BYTES`` of text goes to the executors as a table of
its seeds: the documents are then never shuffled.  A larger one is joined to
them by seed, in four steps: text seeds that no item has are left out first,
then pairs of a text and an item on one diagonal are formed, and only the tokens
along it travel to be verified.  Both ways give the same rows.

Tokens, of items and texts alike, are white-space words, lower-cased, without
punctuation at their ends; words of punctuation alone are no tokens.
Defined results: null and empty texts overlap nothing; items without a token
are no benchmark; repeated items, and repeated rows, are reported each under
their own id, and items of one id by the best of them; an empty table on either
side gives an empty result; further columns, also ones named like the results,
do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, non_null_text, process_wide

#: Offsets that a mask looks at.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 7))
WINDOW = 12
NEEDED = 10
#: Bound of a benchmark's text that is broadcast.
BLOCK_BYTES = 8_000_000

_EDGES = "\"'`.,;:!?()[]{}<>*-"
_PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def tokens(text: str | None) -> list[str]:
    return [w for w in (t.strip(_EDGES) for t in (text or "").lower().split()) if w]


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of ``n`` tokens."""
    return MASKS if n >= WINDOW else (tuple(range(3 if n > 5 else n)),)


def needed(n: int) -> tuple[int, int]:
    """The window of an item of ``n`` tokens, and how many of its tokens must agree."""
    window = min(WINDOW, n)
    return window, NEEDED if window == WINDOW else math.ceil(window * NEEDED / WINDOW)


def _hash(ids: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    h = np.full(len(at), len(mask), np.uint64)
    for k, o in enumerate(mask):
        h = (h ^ (ids[at + o].astype(np.uint64) + np.uint64(1)) * _PRIMES[k % 5]) * _PRIMES[(k + 1) % 5]
        h ^= h >> np.uint64(29)
    return h


#: Bound of the words whose ids are remembered, of hits verified at once, and of words of a group of texts.
WORDS, HITS, GROUP = 200_000, 50_000, 200_000
#: Ids that no item has: of no token, of a word of no item, of a gap between texts, of one between items.
_NONE, _OTHER, _GAP, _ITEM_GAP = -2, -1, -3, -4
#: A gap is so long that no window around a hit reaches over it.
_PAD = WINDOW + max(m[-1] for m in MASKS) + 1


class Known(dict):
    """The ids of a text's words, stripped as an item's are: ``_NONE`` where nothing is left, ``_OTHER`` where no item has it."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGES)
        found = self.ids.get(bare, _OTHER) if bare else _NONE
        if len(self) >= WORDS:
            self.clear()
        self[word] = found
        return found


def _laid_out(rows: Iterable[np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ids in one array with gaps around them; where each begins and ends."""
    pad = np.full(_PAD, gap, np.int32)
    parts, begin, end, at = [pad], [], [], _PAD
    for r in rows:
        parts += [r, pad]
        begin.append(at)
        end.append(at + len(r))
        at += len(r) + _PAD
    return np.concatenate(parts), np.array(begin, np.int64), np.array(end, np.int64)


class Seeds:
    """The seeds of a benchmark: a vocabulary, the items as ids, and sorted hashes for each mask."""

    def __init__(self, items: list[tuple[int, str]]):
        self.names, rows, words = [], [], {}
        for item_id, text in items:
            own = tokens(text)
            if own:
                self.names.append(item_id)
                rows.append(np.array([words.setdefault(w, len(words)) for w in own], np.int32))
        self.lookup = Known(words)
        self.flat, self.begin, self.end = _laid_out(rows, _ITEM_GAP)
        self.by_mask = {}
        spans = {}
        for n, ids in enumerate(rows):
            for mask in masks_for(len(ids)):
                at = np.arange(len(ids) - mask[-1])
                spans.setdefault(mask, []).append((_hash(ids, at, mask), np.full(len(at), n, np.int32), at.astype(np.int32)))
        for mask, parts in spans.items():
            h, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_mask[mask] = (h[order], n[order], at[order])

    def overlaps(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text the items that overlap it: id to (tokens that agree, tokens of the item)."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        group, size = [], 0
        for i, t in enumerate(texts):
            words = (t or "").lower().split()
            ids = np.fromiter(map(self.lookup.__getitem__, words), np.int32, len(words))
            group.append((i, ids[ids != _NONE]))
            size += len(words)
            if size > GROUP or i + 1 == len(texts):
                self._overlaps(group, found)
                group, size = [], 0
        return found

    def _overlaps(self, group: list[tuple[int, np.ndarray]], found: list[dict[int, tuple[int, int]]]) -> None:
        ids, begin, end = _laid_out([x for _, x in group], _GAP)
        known = np.flatnonzero(ids >= 0)
        seen: set[tuple[int, int, int]] = set()
        for mask, (hashes, items, at) in self.by_mask.items():
            where = known
            for o in mask[1:]:
                where = where[ids[where + o] >= 0]
            h = _hash(ids, where, mask)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(high > low)
            where, low, count = where[hit], low[hit], (high - low)[hit]
            total = np.cumsum(count)
            for first in range(0, int(total[-1]) if len(total) else 0, HITS):
                each = np.arange(first, min(first + HITS, int(total[-1])))
                one = np.searchsorted(total, each, "right")
                p, e = where[one], low[one] + each - (total - count)[one]
                n, a = items[e], at[e].astype(np.int64)
                if mask in MASKS:
                    near = np.arange(1 - WINDOW, mask[-1] + WINDOW)
                    same = ids[p[:, None] + near] == self.flat[(self.begin[n] + a)[:, None] + near]
                    sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
                    real = (sums[:, WINDOW:] - sums[:, :-WINDOW]).max(axis=1) >= NEEDED
                    p, n, a = p[real], n[real], a[real]
                d = np.searchsorted(begin, p, "right") - 1
                seen.update(map(tuple, np.unique(np.stack([d, n, p - a], axis=1), axis=0).tolist()))
        for d, n, shift in seen:
            own = self.flat[self.begin[n] : self.end[n]]
            low, high = max(int(begin[d]), shift), min(int(end[d]), shift + len(own))
            agree = int((ids[low:high] == own[low - shift : high - shift]).sum())
            if len(own) >= WINDOW or agree >= needed(len(own))[1]:
                best = found[group[d][0]]
                best[self.names[n]] = max(best.get(self.names[n], (0, 0)), (agree, len(own)))


FOUND = "array<struct<item_id:long,n_matched:int,n_tokens:int>>"


def _lookup(shared: Broadcast, key: str) -> Callable[[Column], Column]:
    @F.pandas_udf(FOUND)
    def looked_up(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seeds = process_wide(key, lambda: Seeds(shared.value))
        for t in texts:
            yield pd.Series([[{"item_id": k, "n_matched": m, "n_tokens": n} for k, (m, n) in x.items()] for x in seeds.overlaps(list(t))], dtype=object)

    return looked_up


def _seeds_of_texts(masks: list[tuple[int, ...]] | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows mask, seed, key, at, n of rows key, text; of an item's own masks where none are given."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for key, text in zip(rows["key"], rows["text"], strict=True):
                own = np.array([xxhash.xxh64_intdigest(w) for w in tokens(text)], np.uint64)
                for mask in masks_for(len(own)) if masks is None else masks:
                    if 0 < len(mask) and len(own) > mask[-1]:
                        for low in range(0, len(own) - mask[-1], GROUP):
                            at = np.arange(low, min(low + GROUP, len(own) - mask[-1]))
                            yield pd.DataFrame({"mask": ",".join(map(str, mask)), "seed": _hash(own, at, mask).view(np.int64), "key": key, "at": at.astype(np.int32), "n": np.int32(len(own))})

    return run


SEED = "mask string, seed long, key string, at int, n int"


def _slices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each pair of a text and an item the text's tokens along their diagonal, null where it has none."""
    for rows in parts:
        for key, text, pairs in zip(rows["key"], rows["text"], rows["pairs"], strict=True):
            own = tokens(text)
            for low in range(0, len(pairs), 1000):
                part = pairs[low : low + 1000]
                yield pd.DataFrame({"key": key, "item": [p["item"] for p in part], "along": [[own[i] if 0 <= i < len(own) else None for i in range(p["shift"], p["shift"] + p["n"])] for p in part]})


def _verified(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        out = []
        for key, item, along, text in zip(rows["key"], rows["item"], rows["along"], rows["text"], strict=True):
            own = tokens(text)
            window, least = needed(len(own))
            sums = np.cumsum([0, *(a == b for a, b in zip(along, own, strict=True))])
            if (sums[window:] - sums[:-window]).max() >= least:
                out.append((key, item, int(sums[-1]), len(own)))
        yield pd.DataFrame(out, columns=["key", "item", "n_matched", "n_tokens"])


def _joined(docs: DataFrame, items: DataFrame, out: str, text: str) -> DataFrame:
    """:func:`find_overlaps` for a benchmark of any size, joined by seed."""
    key = fresh(docs, "_text_key")
    docs = docs.withColumn(key, F.sha2(non_null_text(text), 256))
    texts, _ = materialize(docs.select(F.col(key).alias("key"), non_null_text(text).alias("text")).dropDuplicates(["key"]), "texts")
    wanted = items.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    wanted, _ = materialize(wanted, "items")
    of_items, _ = materialize(wanted.mapInPandas(_seeds_of_texts(None), SEED), "item_seeds")
    masks = [tuple(map(int, r["mask"].split(","))) for r in of_items.select("mask").distinct().collect()]  # seven at most
    distinct, _ = materialize(of_items.select("mask", "seed").distinct(), "seeds")
    hits, _ = materialize(texts.mapInPandas(_seeds_of_texts(masks), SEED).join(distinct, ["mask", "seed"], "left_semi"), "hits")
    pairs = hits.alias("h").join(of_items.alias("i"), ["mask", "seed"]).select(F.col("h.key").alias("key"), F.col("i.key").alias("item"), (F.col("h.at") - F.col("i.at")).alias("shift"), F.col("i.n").alias("n")).distinct()
    grouped, _ = materialize(pairs.groupBy("key").agg(F.collect_list(F.struct("item", "shift", "n")).alias("pairs")), "pairs")
    along, _ = materialize(texts.join(grouped, "key").mapInPandas(_slices, "key string, item string, along array<string>"), "along")
    checked = along.join(wanted.withColumnRenamed("key", "item"), "item").mapInPandas(_verified, "key string, item string, n_matched int, n_tokens int")
    named = checked.join(items.select("item_id", F.sha2("text", 256).alias("item")), "item")
    best = named.groupBy("key", "item_id").agg(F.max(F.struct("n_matched", "n_tokens")).alias("m"))
    listed = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item_id", "m.n_matched", "m.n_tokens"))).cast(FOUND).alias("list"))
    listed, _ = materialize(listed.select(F.col("key").alias(key), F.col("list").alias(fresh(docs, "_list"))), "overlaps")
    name = listed.columns[1]
    return docs.join(listed, key, "left").withColumn(out, F.coalesce(name, F.array().cast(FOUND))).drop(key, *([] if name == out else [name]))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, out: str = "overlaps", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``out``: the benchmark items that each text overlaps, by item_id."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > block_bytes:
        return _joined(docs, items, out, text)
    block = [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]
    if not block:
        return docs.withColumn(out, F.array().cast(FOUND))
    key = "seeds " + hashlib.sha256(repr(block).encode("utf-8", "replace")).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(block)
    return docs.withColumn(out, F.array_sort(_lookup(shared, key)(non_null_text(text))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's rows: one for each document and item that overlap."""
    found = find_overlaps(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.item_id", F.col("o.n_matched").cast("long").alias("n_matched"), F.col("o.n_tokens").cast("long").alias("n_tokens"))


def oracle() -> str:
    """The same rows in DuckDB SQL: every diagonal on which a text and an item share a token, without seeds."""
    edges = "'" + _EDGES.replace("'", "''") + "'"
    white = r"'[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
    own = f"list_filter(list_transform(regexp_split_to_array(lower(text), {white}), lambda x: trim(x, {edges})), lambda x: x <> '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {own} AS w FROM documents),
words AS (SELECT rid, doc_id, w[i] AS token, i AS pos FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
items AS (SELECT row_number() OVER () AS iid, item_id, {own} AS t FROM benchmark),
tokens AS (SELECT iid, item_id, len(t) AS n, t[q] AS token, q FROM (SELECT iid, item_id, t, unnest(range(1, len(t) + 1)) AS q FROM items)),
shared AS (SELECT rid, doc_id, iid, item_id, n, pos - q AS shift, q FROM words JOIN tokens USING (token)),
ahead AS (SELECT *, count(*) OVER (PARTITION BY rid, iid, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS near, count(*) OVER (PARTITION BY rid, iid, shift) AS total FROM shared),
hits AS (SELECT DISTINCT rid, doc_id, item_id, total, n FROM ahead WHERE CASE WHEN n >= {WINDOW} THEN near >= {NEEDED} ELSE total >= ceil(n * {NEEDED} / {WINDOW}::DOUBLE) END)
SELECT doc_id, item_id, max(total) AS n_matched, arg_max(n, (total, n)) AS n_tokens FROM hits GROUP BY rid, doc_id, item_id"""
