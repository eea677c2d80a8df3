"""Exact-substring dedup: bytes under strings that occur twice are removed.

Every string of ``LENGTH`` bytes that starts twice anywhere is found by sorting
suffixes.  No machine can hold a corpus's suffixes, so they are dealt out by
content first: of the hashes of the short strings within a window of
``LENGTH`` bytes the smallest is its anchor, so equal windows have equal
anchors.  Only windows whose anchor occurs twice are looked at; neighbouring
ones with one anchor make one stretch, and equal stretches count as one with
their number.  The stretches of an anchor meet in a shard, where deep-shallow
sorting orders their windows: multikey quicksort by words to a shallow depth,
then the groups that are still alike, first against their leaders and the rest
in blind tries.  Windows that are equal there, or stand in a repeated stretch,
are repeated.

An anchor with very many different stretches is dealt over parts by a hash of
its windows.  A window that very many of them hold, such as a notice in ten
million different texts, would still bring them all to one part: windows are
counted by hash first, summed up where the stretches are, and those found in
more than ``OFTEN`` stretches are compared by their least and greatest bytes
and need no sorting; a bounded number of them, the most frequent.  So no shard grows with the corpus.  A text that is
repeated adds to counts and to nothing else.

Defined results: a null text counts as empty; texts shorter than ``LENGTH``
bytes lose nothing; repeated rows, also of one id, are copies of each other;
an empty table gives an empty result; further columns, also ones named like
the results, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, non_null_text

LENGTH = 200
#: Bytes that an anchor is the hash of, bytes sorted shallowly, rounds against leaders before the tries.
GRAM, SHALLOW, LEADERS = 32, 32, 6
#: Bytes of text hashed at once, and of stretches sorted at once.
CHUNK, BUFFER = 1 << 20, 4_000_000
#: Windows of an anchor's different stretches that one part of it should have, and stretches that a window may be in to be sorted there.
PART, OFTEN = 32_768, 256
#: Bound of the windows that are judged by count: their hashes go to the driver and to all tasks.
MOST_OFTEN = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of each string of ``length`` bytes, by doubling."""
    x = raw.astype(np.uint64) + np.uint64(1)
    total, done = None, 0
    size = 1
    while True:
        if length & size:
            if total is None:
                total, done = x, size
            else:
                n = len(raw) - done - size + 1
                total = total[:n] * _power(size) + x[done : done + n]
                done += size
        if done == length:
            return _mixed(total[: len(raw) - length + 1])
        x = x[:-size] * _power(size) + x[size:]
        size *= 2


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The windows of some texts by anchor: arrays text, anchor hash, first window, number of windows."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        for column, values in zip(out, _stretches(group, length, gram), strict=True):
            column.append(values)

    for i, text in enumerate(texts):
        step = CHUNK - length
        for low in range(0, max(0, len(text) - length + 1), step):
            part = text[low : low + step + length - 1]
            if size + len(part) > CHUNK and group:
                flush()
                group, size = [], 0
            group.append((i, low, part))
            size += len(part)
    if group:
        flush()
    kinds = (np.int64, np.uint64, np.int64, np.int64)
    return tuple(np.concatenate([np.empty(0, k), *c]).astype(k) for c, k in zip(out, kinds, strict=True))


def _stretches(group: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(sizes)
    h = rolling(raw, gram)
    bits = np.uint64(21)
    # the hash's upper bits with the place below them: the smallest is the leftmost of the smallest
    low = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    anchor = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
    at = np.arange(len(anchor))
    part = np.searchsorted(ends, at, "right")
    whole = at + length <= ends[part]
    at, anchor, part = at[whole], anchor[whole], part[whole]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    own = part[first]
    begin = at[first] - (ends - sizes)[own] + np.array([p[1] for p in group])[own]
    return np.array([p[0] for p in group])[own], h[anchor[first]], begin, count


class BlindTrie:
    """A trie that stores, for strings of one length, only the depths at which they part and the letters there."""

    def __init__(self) -> None:
        self.root: list | None = None  # [depth, {letter: node}] or [-1, string, number of the first]

    def add(self, s: bytes, number: int) -> int:
        """Inserts a string; the number of the first string that equals it, its own if none does."""
        if self.root is None:
            self.root = [-1, s, number]
            return number
        node = self.root
        while node[0] >= 0:  # blindly down, by the letters at the depths alone
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == s:
            return node[2]
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = len(s) - 1 - (differ.bit_length() - 1) // 8
        parent, node = None, self.root
        while 0 <= node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        leaf = [-1, s, number]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return number
        fork = [depth, {other[depth]: node, s[depth]: leaf}]
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]]] = fork
        return number

    def ordered(self) -> Iterator[bytes]:
        """The different strings in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[1]
            else:
                stack += [c for _, c in sorted(node[1].items(), reverse=True)]


def repeated(buffer: bytes, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows of ``buffer`` at ``starts`` equal another of them."""
    raw = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view(">u8").ravel().astype(np.uint64)
    depths = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else []
    shallow = [d for d in depths if d < SHALLOW]
    deep = [d for d in depths if d >= SHALLOW]
    out = np.zeros(len(starts), bool)
    active = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for d in shallow:
        # one step of multikey quicksort over all groups: by the next word, within each group
        key = words[starts[active] + d]
        order = np.lexsort((key, group))
        active, key, group = active[order], key[order], group[order]
        new = np.ones(len(active), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        active, group = active[many], group[many]
    for _ in range(LEADERS):
        if not len(active):
            return out
        new = np.ones(len(active), bool)
        new[1:] = group[1:] != group[:-1]
        lead = active[np.flatnonzero(new)][np.cumsum(new) - 1]
        same = np.ones(len(active), bool)
        for d in deep:
            at = np.flatnonzero(same)
            same[at] = words[starts[active[at]] + d] == words[starts[lead[at]] + d]
        equal = same & ~new
        out[active[equal]] = True
        out[lead[equal]] = True
        active, group = active[~same], group[~same]
        if len(active):
            _, group = np.unique(group, return_inverse=True)
            many = np.bincount(group)[group] > 1
            active, group = active[many], group[many]
    tries: dict[int, BlindTrie] = {}
    for i, g in zip(active.tolist(), group.tolist(), strict=True):
        first = tries.setdefault(g, BlindTrie()).add(buffer[starts[i] : starts[i] + length], i)
        if first != i:
            out[[i, first]] = True
    return out


def keys(text: Column) -> list[Column]:
    return [F.xxhash64(F.col("doc_id"), text).alias("k0"), F.xxhash64(text, F.col("doc_id"), F.lit(1)).alias("k1")]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * 8 * CHUNK // max(1, batch.nbytes))
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            row, anchor, first, count = stretches([t.encode() for t in part.column("text").to_pylist()])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("k0").take(take), part.column("k1").take(take), pa.array(_signed(anchor)), pa.array(first << 16 | count)], names=["k0", "k1", "anchor", "place"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each text whose anchors are repeated."""
    names = ["k0", "k1", "anchor", "first", "hash", "stretch"]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        size = 0
        for k0, k1, text, places in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "text", "places")), strict=True):
            raw = text.encode()
            for p in places:
                first, count = p["place"] >> 16, p["place"] & 0xFFFF
                s = raw[first : first + count + LENGTH - 1]
                size += len(s)
                for column, value in zip(columns, (k0, k1, p["anchor"], first, xxhash.xxh3_128_digest(s), s), strict=True):
                    column.append(value)
            if size > BUFFER:
                yield _batch(names, columns)
                columns, size = [[] for _ in names], 0
        yield _batch(names, columns)


def _batch(names: list[str], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n in ("hash", "stretch") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def _windows(stretch: bytes) -> np.ndarray:
    """The hashes of a stretch's windows."""
    return _signed(rolling(np.frombuffer(stretch, np.uint8), LENGTH))


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that several stretches of a batch hold, with their number: hash and n."""
    for batch in batches:
        own = [_windows(s) for s in batch.column("stretch").to_pylist()]
        window, n = np.unique(np.concatenate([np.empty(0, np.int64), *own]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(window[n > 1]), pa.array(n[n > 1])], names=["window", "n"])


def _among(windows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The offsets of the windows that are among the known ones, which are sorted."""
    at = np.minimum(np.searchsorted(known, windows), max(0, len(known) - 1))
    return np.flatnonzero(known[at] == windows) if len(known) else np.empty(0, np.int64)


def _window_bytes(known: Broadcast):
    """The bytes of the known windows, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for s in batch.column("stretch").to_pylist():
                own = _windows(s)
                rows |= {(int(own[o]), s[o : o + LENGTH]) for o in _among(own, known.value).tolist()}
            w, b = zip(*rows, strict=True) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(b, pa.binary())], names=["window", "bytes"])

    return run


def _judged_by_count(known: Broadcast):
    """The known windows of each stretch, as ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, ranges = [], []
            for i, s in enumerate(batch.column("stretch").to_pylist()):
                own = _windows(s)
                flags = np.zeros(len(own), bool)
                flags[_among(own, known.value)] = True
                if flags.any():
                    take.append(i)
                    ranges.append(_ranges(flags))
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(at), batch.column("hash").take(at), pa.array(ranges, pa.list_(pa.int32()))], names=["anchor", "hash", "ranges"])

    return run


def _dealt(known: Broadcast | None):
    """A row of each stretch for each part that some of its windows go to, with their offsets; none stands for all. The known windows go nowhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, h, s, n, parts in zip(*(batch.column(c).to_pylist() for c in ("anchor", "hash", "stretch", "n", "parts")), strict=True):
                if parts == 1:
                    out.append((anchor, 0, h, s, n, None))
                    continue
                own = _windows(s)
                part = (own.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                if known is not None:
                    part[_among(own, known.value)] = -1
                for p in np.unique(part[part >= 0]).tolist():
                    out.append((anchor, p, h, s, n, np.flatnonzero(part == p).astype(np.int32)))
            a, p, h, s, n, w = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(h, pa.binary()), pa.array(s, pa.binary()), pa.array(n, pa.int64()), pa.array(w, pa.list_(pa.int32()))], names=["anchor", "part", "hash", "stretch", "n", "windows"])

    return run


def _ranges(flags: np.ndarray) -> list[int]:
    """First and last of each run of set flags, in a row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated windows of each stretch; rows come in the order of anchor and part."""
    held: list[tuple] = []
    size = 0

    def judged() -> pa.RecordBatch:
        buffer = b"".join(r[3] for r in held)
        at, starts = 0, []
        for r in held:
            starts.append(at + (np.arange(len(r[3]) - LENGTH + 1) if r[5] is None else np.asarray(r[5], np.int64)))
            at += len(r[3])
        # a stretch that meets no other needs no sorting: its number tells
        alone = np.array([(i == 0 or held[i - 1][:2] != r[:2]) and (i + 1 == len(held) or held[i + 1][:2] != r[:2]) for i, r in enumerate(held)])
        among = [i for i in range(len(held)) if not alone[i]]
        found = [np.zeros(len(s), bool) for s in starts]
        if among:
            flags = repeated(buffer, np.concatenate([starts[i] for i in among]))
            for i, f in zip(among, np.split(flags, np.cumsum([len(starts[i]) for i in among])[:-1]), strict=True):
                found[i] = f
        rows = []
        for r, f in zip(held, found, strict=True):
            if r[4] > 1:
                f[:] = True
            if f.any():
                whole = np.zeros(len(r[3]) - LENGTH + 1, bool)
                whole[slice(None) if r[5] is None else np.asarray(r[5])] = f
                rows.append((r[0], r[2], _ranges(whole)))
        a, h, w = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(h, pa.binary()), pa.array(w, pa.list_(pa.int32()))], names=["anchor", "hash", "ranges"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "hash", "stretch", "n", "windows")), strict=True):
            if size > BUFFER and row[:2] != held[-1][:2]:
                yield judged()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield judged()


SPANS = "array<struct<start:long,end:long>>"


def _kept(whole: bool):
    """The columns of each text: counts, the digest of what is kept, and with ``whole`` that itself and the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, firsts in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = text.encode()
                spans: list[list[int]] = []
                for r in sorted((f["first"] + lo, f["first"] + hi + LENGTH) for f in firsts or () for lo, hi in zip(f["ranges"][::2], f["ranges"][1::2])):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                rest, at = [], 0
                for lo, hi in spans:
                    rest.append(raw[at:lo])
                    at = hi
                rest.append(raw[at:])
                kept = b"".join(rest)
                row = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, [{"start": lo, "end": hi} for lo, hi in spans]) if whole else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))][: 6 if whole else 4]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    return run


def _by_count(of_hot: DataFrame) -> np.ndarray:
    """Sorted hashes of windows that more than ``OFTEN`` of the different stretches hold, checked on their bytes; the most frequent ``MOST_OFTEN`` at most.

    A window counts in batches that hold it more than once, so that next to
    nothing travels; what is not counted, or is beyond the bound, is sorted as
    all others are.
    """
    spark = of_hot.sparkSession
    counted = of_hot.mapInArrow(_repeated_windows, "window long, n long").groupBy("window").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)
    often = np.sort(np.array([r["window"] for r in counted.orderBy(F.desc("n"), "window").limit(MOST_OFTEN).collect()], np.int64))
    if not len(often):
        return often
    found = of_hot.mapInArrow(_window_bytes(spark.sparkContext.broadcast(often)), "window long, bytes binary")
    one = found.groupBy("window").agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest")).where("least = greatest").select("window")
    return np.sort(np.array([r["window"] for r in one.collect()], np.int64))


def _removed(docs: DataFrame) -> DataFrame:
    """Rows doc_id, text, ranges: the repeated windows of each row of ``docs``."""
    spark, text = docs.sparkSession, non_null_text()
    keyed = docs.select("doc_id", *keys(text), text.alias("text"))
    anchors, anchors_path = materialize(keyed.where(F.octet_length("text") >= LENGTH).select("k0", "k1", "text").mapInArrow(_anchored, "k0 long, k1 long, anchor long, place long"), "anchors")
    twice, twice_path = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")  # written, so that the join can split a hot anchor
    places, places_path = materialize(anchors.join(twice, "anchor").groupBy("k0", "k1").agg(F.collect_set(F.struct("anchor", "place")).alias("places")), "places")
    discard(spark, anchors_path)
    discard(spark, twice_path)
    cut, cut_path = materialize(keyed.select("k0", "k1", "text").join(places, ["k0", "k1"]).mapInArrow(_cut, "k0 long, k1 long, anchor long, first long, hash binary, stretch binary"), "stretches")
    discard(spark, places_path)
    different, different_path = materialize(cut.groupBy("anchor", "hash", "stretch").agg(F.count("*").alias("n")), "different")
    hot, hot_path = materialize(different.groupBy("anchor").agg(F.ceil(F.sum(F.octet_length("stretch") - LENGTH + 1) / PART).alias("parts")).where("parts > 1"), "hot")
    shards = different.join(hot, "anchor", "left").select("anchor", "hash", "stretch", "n", F.coalesce("parts", F.lit(1)).alias("parts"))
    of_hot, of_hot_path = materialize(shards.where("parts > 1"), "of_hot")
    verdict = "anchor long, hash binary, ranges array<int>"
    sure = _by_count(of_hot)
    known = spark.sparkContext.broadcast(sure) if len(sure) else None
    judged = of_hot.mapInArrow(_judged_by_count(known), verdict) if known else None
    dealt = shards.where("parts = 1").unionByName(of_hot).mapInArrow(_dealt(known), "anchor long, part long, hash binary, stretch binary, n long, windows array<int>")
    by_sort = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_sorted_shards, verdict)
    verdicts, verdicts_path = materialize(by_sort if judged is None else by_sort.unionByName(judged), "verdicts")
    for path in (different_path, hot_path, of_hot_path):
        discard(spark, path)
    ranges = cut.select("k0", "k1", "anchor", "first", "hash").distinct().join(verdicts, ["anchor", "hash"]).groupBy("k0", "k1").agg(F.collect_list(F.struct("first", "ranges")).alias("ranges"))
    ranges, _ = materialize(ranges, "ranges")
    discard(spark, cut_path)
    discard(spark, verdicts_path)
    return keyed.join(ranges, ["k0", "k1"], "left").select("doc_id", "text", "ranges")


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) and spans of each row of ``docs``."""
    return _removed(docs).mapInArrow(_kept(True), f"{_schema(docs)}, kept binary, spans {SPANS}")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _removed(docs).mapInArrow(_kept(False), _schema(docs))


def oracle(length: int = LENGTH) -> str:
    """The same rows in DuckDB SQL, by the digest of every window; for small tables."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT rid, s, substr(h, 2 * s + 1, {2 * (999 + length)}) AS p, length(h) // 2 AS n FROM (SELECT rid, h, unnest(range(0, length(h) // 2, 1000)) AS s FROM docs)),
bytes AS (SELECT rid, s, p, n, unnest(range(s + 1, least(s + 1000, n) + 1)) AS i FROM parts),
windows AS (SELECT rid, i, substr(p, 2 * (i - s) - 1, 2) AS byte, CASE WHEN i + {length - 1} <= n THEN md5(substr(p, 2 * (i - s) - 1, {2 * length})) END AS k FROM bytes),
twice AS (SELECT k FROM windows WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
marked AS (SELECT rid, i, byte, twice.k IS NOT NULL AS dup FROM windows LEFT JOIN twice ON twice.k = windows.k),
covered AS (SELECT rid, i, byte, max(dup::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
edges AS (SELECT rid, i, byte, gone, lag(gone, 1, 0) OVER (PARTITION BY rid ORDER BY i) AS before FROM covered),
sums AS (SELECT rid, sum(gone)::BIGINT AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM edges GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM docs LEFT JOIN sums USING (rid)"""
