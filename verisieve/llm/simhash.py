"""SimHash near-duplicates, paired by vantage-point trees.

A fingerprint sums the hashes of a text's word shingles bit by bit.  Texts with
the same fingerprint are one point; pairs of points are searched by parts of
their fingerprints: a pair counts as met if it differs in ``part_radius`` bits
at most on one part.  Three parts of 64 bits and a part radius of
``RADIUS // 3`` meet every pair within ``RADIUS`` bits.

Each part has a vantage-point tree over Hamming distance.  Grown on a bounded
sample, it cuts the points into shards; each point lies in one shard and visits
every shard that its ball reaches over a boundary.  In a shard a tree of the
same kind, with branches pruned by the triangle inequality, finds the exact
pairs; which pairs are met depends on the two points alone.  A shard that would
hold too many points is cut into cells, residents by visitors, so that the size
of a task is bounded at any skew.  A shard gives a spanning edge for each of its
points, so no group is written out as all its pairs; distributed connected
components join the edges.

For dropping near copies the fingerprints only propose: pairs within
``CERTAIN`` bits link, further ones are verified by the share of shingles that
both texts have.  Each point proposes its nearest neighbours of other groups
first; points that have more are asked again, with ever larger numbers, until
few are left: these are compared with all others where they meet, and only the
edges that join two groups are written, so a crowd of texts that are alike, but
not similar enough, costs no row for each of its pairs.

Defined results: null and empty texts, and those of white space alone, have
fingerprint zero and link like any other; a text with fewer words than a
shingle is one shingle; repeated rows count each; null ids may be reached but
name no component, unless there are no others; an empty table gives an empty
result; further columns, also ones named like the results, do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, materialize, non_null_text
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Three parts of each word of a fingerprint: first bit, and number of bits.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Bounds of the sample that trees grow on, points that a shard should hold, that a cell of it may hold, and points of a leaf.
SAMPLE, SHARD_POINTS, CELL_POINTS, LEAF = 32_768, 16_384, 65_536, 64
#: Pairs compared at once.
PAIRS = 250_000


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> np.ndarray:
    """The fingerprint of a whole text, as unsigned 64-bit words.

    The first word takes the shingles' hashes as they are, further ones take
    them mixed anew.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not parts:
        return np.zeros(words, np.uint64)
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(parts))
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros((words, 64), np.int64)
    n = len(parts) - k + 1
    for low in range(0, n, 65_536):
        high = min(n, low + 65_536)
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[low:high].tolist(), ends[low + k - 1 : high + k - 1].tolist())], np.uint64)
        for w in range(words):
            if w:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            counts[w] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").reshape(words)


def part_of(fp: np.ndarray, k: int) -> np.ndarray:
    """Part ``k`` of fingerprints (rows, words), as 32-bit integers."""
    first, bits = PARTS[k % len(PARTS)]
    return ((fp[:, k // len(PARTS)] >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def parts_of(fp: np.ndarray) -> np.ndarray:
    """All parts of fingerprints (rows, parts)."""
    return np.stack([part_of(fp, k) for k in range(fp.shape[1] * len(PARTS))], axis=1)


def apart(a: np.ndarray, b: np.ndarray | np.uint32) -> np.ndarray:
    """Differing bits of parts."""
    return np.bitwise_count(a ^ b)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits over the words of the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def split(points: np.ndarray) -> tuple[np.uint32, int]:
    """A vantage point, and the distance that halves the points: of a few points the one that halves best."""
    best = None
    for v in points[:: max(1, len(points) // 5)][:5]:
        d = apart(points, v)
        cut = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        inside = int((d <= cut).sum())
        if best is None or abs(2 * inside - len(d)) < best[0]:
            best = (abs(2 * inside - len(d)), v, cut)
    return best[1], best[2]


class Routes:
    """A vantage-point tree of fixed depth over one part: leaves are shards, of one or more cells."""

    def __init__(self, sample: np.ndarray, radius: int, depth: int, points: int, cell_points: int = CELL_POINTS):
        self.radius, self.depth = radius, depth
        self.nodes: dict[int, tuple[np.uint32, int]] = {}
        self._grow(1, np.unique(sample), 0)
        #: For each shard whose points, by the sample, are too many for one cell: pieces of residents, pieces of visitors.
        self.cells: dict[int, tuple[int, int]] = {}
        for shard, at, home in self.visits(sample):
            cells = tuple(math.ceil(n * points / len(sample) / cell_points) for n in (max(1, int(home.sum())), len(at)))
            if max(cells) > 1:
                self.cells[shard] = cells

    def _grow(self, node: int, points: np.ndarray, level: int) -> None:
        if level == self.depth:
            return
        self.nodes[node] = vantage, cut = split(points) if len(points) > 1 else (np.uint32(0), 0)
        inside = apart(points, vantage) <= cut
        self._grow(2 * node, points[inside], level + 1)
        self._grow(2 * node + 1, points[~inside], level + 1)

    def visits(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indices of points whose ball reaches it, which of them lie in it)."""
        todo = [(1, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node >= 1 << self.depth:
                yield node, at, home
                continue
            vantage, cut = self.nodes[node]
            d = apart(points[at], vantage).astype(np.int16)
            near, far = d - self.radius <= cut, d + self.radius > cut
            todo.append((2 * node, at[near], (home & (d <= cut))[near]))
            todo.append((2 * node + 1, at[far], (home & (d > cut))[far]))

    def dealt(self, points: np.ndarray, numbers: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(shard, cell, indices, whether each is a resident (1), asks (2) or both (3))."""
        for shard, at, home in self.visits(points):
            rows, columns = self.cells.get(shard, (1, 1))
            for i in range(rows):
                for j in range(columns):
                    role = (home & (numbers[at] % rows == i)) + 2 * (asks[at] & (numbers[at] // 7 % columns == j))
                    some = role > 0
                    if some.any():
                        yield shard, i * columns + j, at[some], role[some].astype(np.int8)


class Groups:
    """Labels of points that are linked so far."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        differ = la != lb
        if not differ.any():
            return
        pairs = np.unique(np.stack([la[differ], lb[differ]], axis=1), axis=0)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        to = np.arange(int(self.label.max()) + 1)
        for x in parent:
            to[x] = root(x)
        self.label = to[self.label]


def ranked(key: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``key``, then ``by``, and the rank within each key along it."""
    order = np.lexsort((*reversed(by), key))
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    start = np.flatnonzero(first)
    return order, np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))


@dataclass(frozen=True)
class Limits:
    """Differing bits: on a part, at most; up to which pairs link; up to which they are proposed, and how many by each point first."""

    part_radius: int
    certain: int
    radius: int
    nearest: int = 0


def link_shard(k: int, fp: np.ndarray, role: np.ndarray, group: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of a cell's points on part ``k``; pairs of different labels to verify, as rows (a, b); and the points that have more of them.

    ``group`` has the labels to begin with, each the index of one of its points.
    Of the parts on which a pair meets only the first proposes it, and of two
    points that both ask only the later one.
    """
    groups, part = Groups(group), part_of(fp, k)
    proposed, more = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    todo = [(np.flatnonzero(role & 1), np.flatnonzero(role & 2), True)]
    while todo:
        own, asking, splits = todo.pop()
        if not len(own) or not len(asking):
            continue
        if len(own) > LEAF and splits:
            vantage, cut = split(part[own])
            inside = apart(part[own], vantage) <= cut
            if inside.all() or not inside.any():
                splits = False  # alike on this part
            else:
                d = apart(part[asking], vantage).astype(np.int16)
                todo += [(own[inside], asking[d - limits.part_radius <= cut], True), (own[~inside], asking[d + limits.part_radius > cut], True)]
                continue
        if len(own) > 4 * LEAF:
            # points within half the certain distance of a centre are linked by the triangle inequality, without their pairs
            centre = own[len(own) // 2]
            near_own, near_asking = (2 * distance(fp[x], fp[centre]) <= limits.certain for x in (own, asking))
            if near_own.sum() > LEAF and near_asking.any():
                close = np.concatenate([own[near_own], asking[near_asking]])
                groups.link(close, np.full(len(close), centre))
                todo += [(own[~near_own], asking, False), (own[near_own], asking[~near_asking], False)]
                continue
        step = max(1, PAIRS // len(own))
        for low in range(0, len(asking), step):
            q = asking[low : low + step]
            a, b = np.nonzero(apart(part[q][:, None], part[own][None, :]) <= limits.part_radius)
            a, b = q[a], own[b]
            d = distance(fp[a], fp[b])
            sure = d <= limits.certain
            groups.link(a[sure], b[sure])
            if limits.radius > limits.certain:
                at = np.flatnonzero(~sure & (d <= limits.radius))
                at = at[(groups.label[a[at]] != groups.label[b[at]]) & ((role[b[at]] & 2 == 0) | (a[at] > b[at]))]
                for other in range(k):
                    at = at[apart(part_of(fp[a[at]], other), part_of(fp[b[at]], other)) > limits.part_radius]
                order, rank = ranked(a[at], d[at], b[at])
                at = at[order]
                proposed.append(np.stack([a[at], b[at]], axis=1)[rank < limits.nearest])
                more.append(np.unique(a[at][rank >= limits.nearest]))
    pairs = np.concatenate(proposed)
    pairs = pairs[groups.label[pairs[:, 0]] != groups.label[pairs[:, 1]]]
    order, rank = ranked(pairs[:, 0], distance(fp[pairs[:, 0]], fp[pairs[:, 1]]), pairs[:, 1])
    pairs = pairs[order]
    more.append(pairs[rank >= limits.nearest, 0])
    return groups.label, pairs[rank < limits.nearest], np.unique(np.concatenate(more))


LINKS, PROPOSALS, MORE = range(3)
EDGES = "kind int, a long, b long"


def unpacked(keys: list[str]) -> np.ndarray:
    """Fingerprints, as rows of words, from their hexadecimal form."""
    return np.frombuffer(bytes.fromhex("".join(keys)), ">u8").reshape(len(keys), -1).astype(np.uint64)


def shard_edges(points: DataFrame, limits: Limits, shard_points: int = SHARD_POINTS, cell_points: int = CELL_POINTS, again: DataFrame | None = None) -> DataFrame:
    """Rows kind, a, b over ``points`` (number, fp in hexadecimal): links, pairs to verify, and points with more of those (a = b).

    With ``again`` (number, component, asks) only some points ask, and pairs
    within a component are left out.
    """
    n = points.count()
    depth = max(2, math.ceil(math.log2(max(1, n) / shard_points)))
    depth = min(depth, int(math.log2(SAMPLE)) - 3)
    rows = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(1024, 8 << depth)).toPandas()
    words = len(rows["fp"].iloc[0]) // 16 if len(rows) else 1
    sample = parts_of(unpacked(rows["fp"].to_list()) if len(rows) else np.zeros((1, 1), np.uint64))
    forest = [Routes(sample[:, k], limits.part_radius, depth, n, cell_points) for k in range(sample.shape[1])]
    columns = [f"w{i}" for i in range(words)]
    known = [] if again is None else ["component"]  # else each point is its own
    names = ["cell", "number", *known, *columns]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = unpacked(batch.column("fp").to_pylist())
            number = batch.column("number").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            parts = parts_of(fp)
            for k, tree in enumerate(forest):
                for shard, cell, at, role in tree.dealt(parts[:, k], number, asks):
                    own = np.full(len(at), (shard * len(forest) + k) << 24 | cell, np.int64)
                    made = [own, number[at] << 2 | role, *[batch.column(c).to_numpy()[at] for c in known], *[fp[at, i].view(np.int64) for i in range(len(columns))]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=names)

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("number")  # pairs do not depend on the rows' order
        number, role = table.column("number").to_numpy() >> 2, table.column("number").to_numpy() & 3
        component = table.column("component").to_numpy() if known else number
        fp = np.stack([table.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
        _, first, group = np.unique(component, return_index=True, return_inverse=True)
        label, pairs, more = link_shard((table.column("cell")[0].as_py() >> 24) % len(forest), fp, role, first[group], limits)
        moved = np.flatnonzero((label != np.arange(len(label))) & (label != first[group]))
        a, b = np.concatenate([number[moved], number[pairs.min(axis=1)], number[more]]), np.concatenate([number[label[moved]], number[pairs.max(axis=1)], number[more]])
        kind = np.repeat(np.array([LINKS, PROPOSALS, MORE], np.int32), [len(moved), len(pairs), len(more)])
        return pa.table({"kind": kind, "a": a, "b": b})

    if again is None:
        asked = points.select("number", "fp", F.lit(True).alias("asks"))
    else:
        asked = points.select("number", "fp").join(again, "number").select("number", "fp", "component", "asks")
    routed = asked.mapInArrow(route, ", ".join(["cell long, number long", *[f"{c} long" for c in (*known, *columns)]]))
    if again is not None:
        visited, _ = materialize(routed.where("number % 4 > 1").select("cell").distinct(), "visited")
        routed = routed.join(visited, "cell", "left_semi")
    return routed.groupBy("cell").applyInArrow(link, EDGES).distinct()


def _asking(points: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All points with their components, and those of them that ask."""
    known = points.select("number", "fp").join(again, "number")
    return known, known.where("asks")


def asked_points(points: DataFrame, again: DataFrame, limits: Limits) -> DataFrame:
    """The numbers of the points that meet one of few asking points of another component, within ``limits.radius``.

    The asking points go to all tasks, and the others pass by; nothing is
    shuffled, and a point gives one row at most, however many it meets.
    """
    known, asking = _asking(points, again)
    rows = asking.select("component", "fp").toPandas()  # ASKING at most
    shared = points.sparkSession.sparkContext.broadcast((rows["component"].to_numpy(np.int64), unpacked(rows["fp"].to_list())))
    told = Limits(limits.part_radius, limits.certain, limits.radius)  # of 0 proposals, all points with some have more

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, fp = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.concatenate([fp, unpacked(batch.column("fp").to_pylist())])
            _, first, group = np.unique(np.concatenate([component, batch.column("component").to_numpy()]), return_index=True, return_inverse=True)
            role = np.repeat(np.array([1, 2], np.int8), [len(component), batch.num_rows])
            met = [link_shard(k, fps, role, first[group], told)[2] for k in range(fps.shape[1] * len(PARTS))]
            at = np.unique(np.concatenate(met)) - len(component)
            yield pa.RecordBatch.from_arrays([batch.column("number").take(pa.array(at))], names=["number"])

    return known.select("number", "fp", "component").mapInArrow(meet, "number long")


class Shingles:
    """The points that have each shingle."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.lengths = lengths
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]
        self.values, self.start = np.unique(values[order], return_index=True)
        self.end = np.append(self.start[1:], len(values))

    def alike(self, own: np.ndarray) -> np.ndarray:
        """The points whose shingles are similar to ``own``, as :func:`similarity` tells of each."""
        if not len(own) or not len(self.values):
            return np.flatnonzero(self.lengths == len(own))  # nothing is shared, and two texts without shingles are alike
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        at = at[self.values[at] == own]
        count = self.end[at] - self.start[at]
        place = np.arange(count.sum()) + np.repeat(self.start[at] - (np.cumsum(count) - count), count)
        both = np.bincount(self.owner[place], minlength=len(self.lengths))
        some = np.flatnonzero(both)
        return some[both[some] / (len(own) + self.lengths[some] - both[some]) >= SIMILARITY]


def asked_links(points: DataFrame, again: DataFrame, sets: DataFrame, limits: Limits) -> Iterator[DataFrame]:
    """Edges (a, b) that connect the components as all similar pairs within ``limits.radius`` with an asking point would.

    ``sets`` (number, own) has the shingles of the asking points and of those
    that meet them.  Pairs are verified where they meet and are never written:
    a task gives an edge only where it joins two components that it has not yet
    joined.  The asking points' shingles go to all tasks, in portions of some
    ``ASKED_BYTES``; each frame is to be written before the next is asked for.
    """
    known, asking = _asking(points, again)
    passing = known.join(sets, "number").select("number", "component", "fp", "own")
    asking = asking.join(sets, "number").select("number", "component", "fp", "own")
    portions = max(1, math.ceil(8 * (asking.agg(F.sum(F.size("own"))).first()[0] or 0) / ASKED_BYTES))
    for portion in range(portions):
        own = asking.where(F.pmod(F.xxhash64("number"), F.lit(portions)) == portion).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        lists = own.column("own").combine_chunks()
        index = Shingles(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))
        shared = points.sparkSession.sparkContext.broadcast((own.column("number").to_numpy(), own.column("component").to_numpy(), unpacked(own.column("fp").to_pylist()), index))
        yield passing.mapInArrow(_joined(shared, limits), "a long, b long")
        shared.unpersist()


def _joined(shared: Broadcast, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, components, fps, index = shared.value
        parts, parent = parts_of(fps), {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for batch in batches:
            edges, fp = [], unpacked(batch.column("fp").to_pylist()) if batch.num_rows else None
            lists = batch.column("own")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (number, component) in enumerate(zip(batch.column("number").to_pylist(), batch.column("component").to_pylist(), strict=True)):
                near = index.alike(values[offsets[i] : offsets[i + 1]])
                near = near[components[near] != component]
                near = near[distance(fps[near], fp[i]) <= limits.radius]
                near = near[(apart(parts[near], parts_of(fp[i : i + 1])) <= limits.part_radius).any(axis=1)]
                for j in near.tolist():
                    x, y = root(component), root(int(components[j]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        edges.append((number, int(numbers[j])))
            a, b = np.array(edges, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def linked_pairs(points: DataFrame, words: int = 1, radius: int = RADIUS, shard_points: int = SHARD_POINTS, cell_points: int = CELL_POINTS) -> DataFrame:
    """Edges (a, b) that connect the points (number, fp) as all pairs within ``radius`` bits would: of ``p`` parts one differs in ``radius // p`` bits at most."""
    limits = Limits(radius // (words * len(PARTS)), radius, radius)
    return shard_edges(points, limits, shard_points, cell_points).select("a", "b")


def fingerprints(text: Column, shingle: int = SHINGLE, words: int = 1) -> Column:
    """The fingerprint of each whole text, as 16 hexadecimal digits a word."""

    @F.pandas_udf(T.StringType())
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([fingerprint(x, shingle, words).astype(">u8").tobytes().hex() for x in t], dtype=object)

    return column(text)


def _points(marked: DataFrame, *more: Column) -> tuple[DataFrame, str]:
    """The different fingerprints, numbered, as a written table and its path; the numbers are fixed by the writing."""
    return materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), *more).withColumn("number", F.monotonically_increasing_id()), "points")


def _named(points: DataFrame, components: DataFrame) -> tuple[DataFrame, str]:
    """Rows fp, component, component_id of each point, written."""
    grouped = points.join(components, F.col("number") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "number").alias("component"))
    smallest, path = materialize(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")  # written, so that the join can split a large component
    out = materialize(grouped.join(smallest, "component").select("fp", "component", "component_id"), "named")
    discard(points.sparkSession, path)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows doc_id, fp, component, component_id by ``RADIUS`` of 64 bits.

    ``component`` names the group of linked documents, ``component_id`` is the
    smallest id in it.
    """
    spark = docs.sparkSession
    marked, _ = materialize(docs.select("doc_id", fingerprints(non_null_text()).alias("fp")), "fingerprints")
    points, points_path = _points(marked)
    named, _ = _named(points, connected_components(linked_pairs(points)))
    discard(spark, points_path)
    return marked.join(named, "fp")


#: For dropping near copies: five words and a similarity of 0.8.  Eight words of fingerprint have 24 parts, one of which differs in one bit at most
#: for 0.98 of the pairs right at the limit, and for more of the closer ones.  Of all 512 bits such a pair differs in 78, give or take 8.
SIMILARITY, DEDUP_SHINGLE, DEDUP_WORDS = 0.8, 5, 8
DEDUP = Limits(part_radius=1, certain=50, radius=98, nearest=2)
#: Each round of proposals is so many times larger; up to so many points that have more are compared with all others at once, so many bytes of shingles at a time.
MORE_TIMES, ASKING, ASKED_BYTES = 64, 20_000, 16_000_000


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The different shingles of a text, hashed and sorted."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    k = min(shingle, len(parts))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(parts[i : i + k]), SEED) for i in range(len(parts) - k + 1 if k else 0)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of shingles that both texts have; of two texts without any, 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t, DEDUP_SHINGLE).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(sets, pa.list_(pa.int64()))], names=["number", "own"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose shingles are similar."""
    for batch in batches:
        left, right = (batch.column(c) for c in ("left", "right"))
        flat = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (left, right)]
        keep = [i for i in range(batch.num_rows) if similarity(*(v[o[i] : o[i + 1]] for o, v in flat)) >= SIMILARITY]
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def similar_groups(docs: DataFrame, limits: Limits = DEDUP, shard_points: int = SHARD_POINTS, asking: int = ASKING) -> DataFrame:
    """Rows doc_id, text_key, component: documents connected by texts of a similarity of ``SIMILARITY`` and more."""
    text, paths = non_null_text(), []

    def put(df: DataFrame, label: str) -> DataFrame:
        out, path = materialize(df, label)
        paths.append(path)
        return out

    keyed = docs.select("doc_id", F.md5(text).alias("text_key"), text.alias("text"))
    marked, _ = materialize(keyed.select("doc_id", "text_key", fingerprints(F.col("text"), DEDUP_SHINGLE, DEDUP_WORDS).alias("fp")), "fingerprints")
    points, path = _points(marked, F.min("text_key").alias("text_key"))
    paths.append(path)

    def shingled(numbers: DataFrame) -> DataFrame:
        """The points' shingles: number, own."""
        asked = points.select("number", "text_key").join(numbers, "number", "left_semi")
        texts = keyed.select("text_key", "text").join(asked, "text_key").select("number", "text").dropDuplicates(["number"])
        return put(texts.mapInArrow(_shingled, "number long, own array<long>"), "shingles")

    def connected(components: DataFrame, new: DataFrame) -> DataFrame:
        return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new))

    again, tried, components = None, None, None
    while True:
        found = put(shard_edges(points, limits, shard_points, again=again), "proposals")
        pairs = found.where(F.col("kind") == PROPOSALS).select("a", "b")
        pairs = pairs if tried is None else put(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = found.where(F.col("kind") == LINKS).select("a", "b")
        if not pairs.isEmpty():
            sets = shingled(pairs.select(F.explode(F.array("a", "b")).alias("number")).distinct())
            left, right = sets.select(F.col("number").alias("a"), F.col("own").alias("left")), sets.select(F.col("number").alias("b"), F.col("own").alias("right"))
            alike = put(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_alike, "a long, b long"), "alike")
            new = new.unionByName(alike)
            tried = pairs if tried is None else tried.unionByName(pairs)
        if components is None or not new.isEmpty():
            components = connected_components(new) if components is None else connected(components, new)
        more = found.where(F.col("kind") == MORE).select(F.col("a").alias("number")).distinct()
        if more.isEmpty():
            break
        labelled = points.select("number").join(components.withColumnRenamed("node", "number"), "number", "left").join(more.withColumn("asks", F.lit(True)), "number", "left")
        again = put(labelled.select("number", F.coalesce("component", "number").alias("component"), F.coalesce("asks", F.lit(False)).alias("asks")), "again")
        if more.count() <= asking:
            met = put(asked_points(points, again, limits), "met")
            sets = shingled(met.unionByName(again.where("asks").select("number")).distinct())
            for new in asked_links(points, again, sets, limits):
                new = put(new, "asked")
                if not new.isEmpty():
                    components = connected(components, new)
            break
        limits = Limits(limits.part_radius, limits.certain, limits.radius, MORE_TIMES * limits.nearest)
    named, _ = _named(points, components)
    for path in paths:
        discard(docs.sparkSession, path)
    return marked.join(named, "fp").select("doc_id", "text_key", "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; the columns stay."""
    found = similar_groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    a, b, c = (fresh(docs, x) for x in ("_id_hash", "_text_key", "_id"))
    kept = found.groupBy("component").agg(first.alias("k")).select(F.coalesce(F.hash("k.doc_id"), F.lit(0)).alias(a), F.col("k.text_key").alias(b), F.col("k.doc_id").alias(c))
    keyed = docs.withColumn(a, F.coalesce(F.hash("doc_id"), F.lit(0))).withColumn(b, F.md5(non_null_text()))
    one = keyed.join(kept, (keyed[a] == kept[a]) & (keyed[b] == kept[b]) & keyed["doc_id"].eqNullSafe(kept[c]), "left_semi")
    return one.dropDuplicates([a, b, "doc_id"]).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def oracle() -> str:
    """The same rows in DuckDB SQL for small tables: XXH64 step by step in 128-bit integers, all pairs of fingerprints, and their closure."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    whole = f"{1 << 64}::UHUGEINT"
    add = lambda a, b: f"(({a} + {b}) % {whole})"
    mul = lambda a, b: f"(({a} * {b}) % {whole})"
    turn = lambda a, r: f"(({a} * {1 << r}::UHUGEINT) % {whole} + {a} // {1 << 64 - r}::UHUGEINT)"
    fold = lambda acc, lane: mul(turn(add(acc, mul(lane, p2)), 31), p1)
    zero = "0::UHUGEINT"
    number = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"
    joined = lambda h, v: add(mul(f"xor({h}, {fold(zero, v)})", p1), p4)
    starts = [(SEED + 0x9E3779B185EBCA87 + 0xC2B2AE3D27D4EB4F) % (1 << 64), SEED + 0xC2B2AE3D27D4EB4F, SEED, (SEED - 0x9E3779B185EBCA87) % (1 << 64)]
    stripes = f"list_transform(range(0, n // 32), lambda k: [{', '.join(number(f'32 * k::BIGINT + {8 * j}', 8) for j in range(4))}])"
    lanes = f"list_reduce(list_prepend([{', '.join(f'{s}::UHUGEINT' for s in starts)}], {stripes}), lambda v, l: [{', '.join(fold(f'v[{j}]', f'l[{j}]') for j in range(1, 5))}])"
    summed = add(add(turn("v[1]", 1), turn("v[2]", 7)), add(turn("v[3]", 12), turn("v[4]", 18)))
    eights = f"list_transform(range(0, n % 32 // 8), lambda k: {number('n - n % 32 + 8 * k::BIGINT', 8)})"
    ones = f"list_transform(range(0, n % 4), lambda k: {number('n - n % 4 + k::BIGINT', 1)})"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS w FROM documents),
shingled AS (SELECT rid, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)),
b0 AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM shingled)),
b1 AS (SELECT *, CASE WHEN n >= 32 THEN {lanes} END AS v FROM b0),
b2 AS (SELECT s, x, n, v, CASE WHEN n >= 32 THEN {summed} ELSE {add(f'{SEED}::UHUGEINT', p5)} END AS h FROM b1),
b3 AS (SELECT s, x, n, v, CASE WHEN n >= 32 THEN {joined('h', 'v[1]')} ELSE h END AS h FROM b2), b4 AS (SELECT s, x, n, v, CASE WHEN n >= 32 THEN {joined('h', 'v[2]')} ELSE h END AS h FROM b3),
b5 AS (SELECT s, x, n, v, CASE WHEN n >= 32 THEN {joined('h', 'v[3]')} ELSE h END AS h FROM b4), b6 AS (SELECT s, x, n, CASE WHEN n >= 32 THEN {joined('h', 'v[4]')} ELSE h END AS h FROM b5),
b7 AS (SELECT s, x, n, list_reduce(list_prepend({add('h', 'n::UHUGEINT')}, {eights}), lambda a, k: {add(mul(turn(f'xor(a, {fold(zero, "k")})', 27), p1), p4)}) AS h FROM b6),
b8 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {add(mul(turn(f"xor(h, {mul(number('n - n % 8', 4), p1)})", 23), p2), p3)} ELSE h END AS h FROM b7),
b9 AS (SELECT s, list_reduce(list_prepend(h, {ones}), lambda a, k: {mul(turn(f'xor(a, {mul("k", p5)})', 11), p1)}) AS h FROM b8),
c1 AS (SELECT s, {mul(f'xor(h, h // {1 << 33}::UHUGEINT)', p2)} AS h FROM b9), c2 AS (SELECT s, {mul(f'xor(h, h // {1 << 29}::UHUGEINT)', p3)} AS h FROM c1), hashed AS (SELECT s, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM c2),
prints AS (SELECT rid, ({bits})::UBIGINT AS fp FROM shingled JOIN hashed USING (s) GROUP BY rid),
marked AS (SELECT rid, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM docs LEFT JOIN prints USING (rid)),
points AS (SELECT fp, min(doc_id) AS first FROM marked GROUP BY fp),
pairs AS (SELECT a.fp AS a, b.fp AS b FROM points a, points b WHERE a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {RADIUS}),
reach(a, b) AS (SELECT fp, fp FROM points UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b),
least_id AS (SELECT reach.a AS fp, min(first) AS component_id FROM reach JOIN points ON points.fp = reach.b GROUP BY reach.a)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM marked JOIN least_id USING (fp)"""
