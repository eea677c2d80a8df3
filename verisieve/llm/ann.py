"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table projects unit vectors on Gaussian directions and cuts the lines into
steps; a bucket is the cell a vector falls in.  A query visits its own bucket
and perturbed ones in the order of their estimated success, which is the chance
that a neighbour at the target distance fell there, until the chances add up
to the share a table should find.  Candidates of all tables are merged and
ranked by exact cosine on the original vectors.

Every vector is indexed.  Equal vectors are one point with its smallest ids,
so a vector that fills a third of the table costs nothing; a bucket of any size
is dealt over so many parts that each holds ``PART_POINTS`` at most, and its
queries go to all of them, so no bucket is capped.  Buckets and parts are dealt
over shards; a query's vector goes once to each shard that has some of its
buckets.  A shard's points are held while its queries stream by, so memory does
not grow with their number.

The number of directions grows with the logarithm of the table, and the share
that a table should find by probes falls with its size.  Neither changes a
result: an exact check follows at every size.  Each query goes to the buckets
of one table that it has not visited, in which each point of its length lies
once, and leaves out those whose cone, the centre and widest angle of their
vectors, is too far off to hold a point as near as the worst one found.  Good
probes make that bound tight; vectors without near neighbours rule out few
buckets, and are then compared with nearly all.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, and neither do null ids; vectors of another length are
never compared; repeated rows of one id and vector are one; an id with several
vectors is searched by, and found through, each of them, and ranked by the
best; an empty table gives an empty result; further columns, also ones named
like the results, do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Tables, the least share of neighbours each should find, points from which it holds, and the cosine of the neighbours it is estimated for.
TABLES, SUCCESS, FULL_POINTS, TARGET_COSINE = 2, 0.82, 1_000_000, 0.34
#: Width of a step, points meant for a bucket, points of one part of it, and most directions.
STEP, BUCKET_POINTS, PART_POINTS, MOST_DIRECTIONS = 1.0, 4000, 4096, 8
#: Numbers that the vectors of a shard should have, and least shards.
SHARD_NUMBERS, LEAST_SHARDS = 4_000_000, 12
NEAREST, QUERY_EVERY = 5, 50
#: Margins over the rounding of a matrix product of unit vectors, and of a cone's bound, which has the roots of such.
ROUNDING, CONE_ROUNDING = 1e-9, 1e-6
#: Probes that are held together, and products.
PROBE_ROWS, PRODUCTS = 500_000, 2_000_000


def directions_for(n: int) -> int:
    return max(2, min(MOST_DIRECTIONS, round(math.log(max(n, 1) / BUCKET_POINTS) / math.log(3.0))))


def share_for(n: int) -> float:
    """The share of neighbours that each table should find by probes, of ``n`` points; the check finds the others."""
    return 1 - (1 - SUCCESS) * min(1.0, max(n, 1) / FULL_POINTS)


class Tables:
    """Random directions and shifts, and the buckets that a vector lies in or visits."""

    def __init__(self, dims: int, directions: int, tables: int = TABLES, seed: int = 11):
        rng = np.random.default_rng(seed + dims)
        self.k, self.tables = directions, tables
        self.a = rng.normal(size=(tables, directions, dims))
        self.width = STEP
        self.b = rng.uniform(0, 1, size=(tables, directions))

    def _places(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t].T) / self.width + self.b[t]

    def _key(self, t: int, cells: np.ndarray, dims: int) -> np.ndarray:
        key = np.full(cells.shape[:-1], dims * 64 + t, np.int64)
        for i in range(self.k):
            key = key * 61 + (cells[..., i].astype(np.int64) + 30)
        return key

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) keys of unit vectors."""
        return np.stack([self._key(t, np.floor(self._places(x, t)), x.shape[1]) for t in range(self.tables)], axis=1)

    def _moves(self, rest: np.ndarray, success: float, spread: float) -> np.ndarray:
        """The likeliest moves from a place in its cell, in the order of their chances, which add up to ``success``.

        All moves with a chance over a bound are listed, without a limit to their length, and the bound falls until
        they suffice.
        """
        far = math.ceil(7 * spread) + 1  # the rest of a line has a chance of 1e-11
        steps = np.arange(-far, far + 1)
        low = (steps[None, :] - rest[:, None]) / spread
        lines = np.maximum(normal(low + 1 / spread) - normal(low), 0)
        ahead = np.append(np.cumprod(lines.max(axis=1)[::-1])[::-1], 1.0)  # the best chance of the lines from one on
        bound = ahead[0] / 4
        while True:
            moves, chance = np.zeros((1, 0), np.int64), np.ones(1)
            for i in range(self.k):
                grown = chance[:, None] * lines[i][None, :]
                a, b = np.nonzero(grown * ahead[i + 1] >= bound)
                moves, chance = np.column_stack([moves[a], steps[b]]), grown[a, b]
            if chance.sum() >= success:
                order = np.argsort(-chance, kind="stable")
                return moves[order[: int(np.searchsorted(np.cumsum(chance[order]), success)) + 1]]
            bound /= 4

    def probes(self, x: np.ndarray, success: float = SUCCESS, cosine: float = TARGET_COSINE) -> Iterator[np.ndarray]:
        """For each unit vector the keys it visits, in the order of estimated success within each table."""
        spread = math.sqrt(2 - 2 * cosine) / self.width
        places = [self._places(x, t) for t in range(self.tables)]
        for r in range(len(x)):
            cells = [np.floor(p[r]) for p in places]
            yield np.concatenate([self._key(t, c + self._moves(places[t][r] - c, success, spread), x.shape[1]) for t, c in enumerate(cells)])


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, within 1e-7."""
    u = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * u)
    e = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-u * u)
    return 0.5 * (1 + np.sign(z) * e)


def _units(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions of the vectors, and the vectors as unit rows."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    out = {}
    for n, at in by.items():
        x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in at])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out[n] = (np.array(at), x / np.linalg.norm(x, axis=1, keepdims=True))
    return out


def _hashed(directions: int):
    """The buckets that points lie in, by table."""

    def run(parts):
        tables: dict[int, Tables] = {}
        for rows in parts:
            for n, (at, x) in _units(rows["v"]).items():
                keys = tables.setdefault(n, Tables(n, directions)).buckets(x)
                every = np.repeat(at, keys.shape[1])
                yield pd.DataFrame({"key": keys.ravel(), "number": np.tile(np.arange(keys.shape[1], dtype=np.int32), len(at)), "point": rows["point"].to_numpy()[every], "first": rows["first"].to_numpy()[every], "v": rows["v"].iloc[every].to_numpy()})

    return run


def _visited(directions: int, share: float):
    """The buckets that queries visit, in frames of bounded size."""

    def run(parts):
        tables: dict[int, Tables] = {}
        for rows in parts:
            for n, (at, x) in _units(rows["v"]).items():
                held, size = [], 0
                for point, keys in zip(rows["point"].to_numpy()[at], tables.setdefault(n, Tables(n, directions)).probes(x, share), strict=True):
                    held.append(pd.DataFrame({"key": keys, "point": point}))
                    size += len(keys)
                    if size > PROBE_ROWS:
                        yield pd.concat(held)
                        held, size = [], 0
                if held:
                    yield pd.concat(held)

    return run


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, in double precision, summed from the first component to the last.

    Rows are scaled by powers of two first, which is exact and lets no square overflow.
    """

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])

    def summed(x: np.ndarray) -> np.ndarray:
        return np.cumsum(x, axis=1)[:, -1]

    q, c = scaled(q), scaled(c)
    return summed(q * c) / (np.sqrt(summed(q * q)) * np.sqrt(summed(c * c)))


FOUND = "query long, point long, first long, score double"


class Bucket:
    """The points of one part of a bucket, of one length of vectors."""

    def __init__(self, point: np.ndarray, first: np.ndarray, vectors: pd.Series):
        self.point, self.first = point, first
        self.raw = np.stack([np.asarray(v, np.float64) for v in vectors])
        (_, self.unit), *_ = _units(vectors).values()
        middle = self.unit.sum(axis=0)
        self.centre = middle / np.linalg.norm(middle) if np.linalg.norm(middle) > 1e-3 else self.unit[0]
        self.widest = float((self.unit @ self.centre).min())

    def most(self, unit: np.ndarray) -> np.ndarray:
        """For each query a cosine that none of the points exceeds: that of its angle to the centre less the widest one."""
        near = unit @ self.centre
        apart = near * self.widest + np.sqrt(np.maximum(0, 1 - near * near) * max(0.0, 1 - self.widest * self.widest))
        return np.where(near >= self.widest, 1.0, apart) + CONE_ROUNDING

    def nearest(self, query: np.ndarray, raw: np.ndarray, unit: np.ndarray, nearest: int) -> pd.DataFrame:
        """The best points of each query, ties included where rounding could tell them apart wrongly."""
        near = unit @ self.unit.T
        k = min(near.shape[1], nearest + 1)
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1] - ROUNDING
        rows, cols = np.nonzero(near >= least[:, None])
        score = np.concatenate([cosines(raw[rows[i : i + 65_536]], self.raw[cols[i : i + 65_536]]) for i in range(0, len(rows), 65_536)])
        return best_of(pd.DataFrame({"query": query[rows], "point": self.point[cols], "first": self.first[cols], "score": score}), nearest)


def best_of(found: pd.DataFrame, nearest: int) -> pd.DataFrame:
    return found.sort_values(["query", "score", "first"], ascending=[True, False, True]).drop_duplicates(["query", "point"]).groupby("query").head(nearest + 1)


def _searched(nearest: int, check: bool):
    """The best points of each query in each shard; rows come by shard, its points before its queries.

    A query searches the buckets ``units``; for the check all others that may
    hold a point with a score of ``least``, and only such points are told.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, buckets = None, [], {}

        def settled() -> dict[tuple, Bucket]:
            if held:
                rows = pd.concat(held, ignore_index=True)
                held.clear()
                rows["unit"], rows["length"] = rows["units"].str[0], rows["v"].str.len()
                for key, own in rows.groupby(["unit", "length"]):
                    buckets[key] = Bucket(own["point"].to_numpy(), own["first"].to_numpy(), own["v"])
            return buckets

        for frame in parts:
            for own, rows in frame.groupby("shard", sort=False):
                if own != shard:
                    shard, held, buckets = own, [], {}
                points, queries = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
                if len(points):
                    held.append(points)
                if not len(queries):
                    continue
                have, out = settled(), []
                for n, (at, unit) in _units(queries["v"]).items():
                    raw, query, least = np.stack([np.asarray(queries["v"].iloc[i], np.float64) for i in at]), queries["point"].to_numpy()[at], pd.Series(queries["least"].to_numpy()[at], queries["point"].to_numpy()[at])
                    visits: dict[int, list[int]] = {}
                    for i, units in enumerate(queries["units"].iloc[at]):
                        for u in units:
                            visits.setdefault(int(u), []).append(i)
                    if check:
                        visits = {u: np.setdiff1d(np.flatnonzero(bucket.most(unit) >= least.to_numpy()), visits.get(u, [])) for (u, length), bucket in have.items() if length == n}
                    for u, asking in visits.items():
                        bucket = have.get((u, n))
                        if bucket is not None:
                            step = max(1, PRODUCTS // len(bucket.point))
                            found = [bucket.nearest(query[q], raw[q], unit[q], nearest) for q in (asking[i : i + step] for i in range(0, len(asking), step))]
                            if check:
                                found = [f[f["score"].to_numpy() >= least.loc[f["query"]].to_numpy()] for f in found]
                            out += found
                if out:
                    yield best_of(pd.concat(out, ignore_index=True), nearest)

    return run


def nearest_neighbours(vectors: DataFrame, nearest: int = NEAREST, query_every: int = QUERY_EVERY) -> DataFrame:
    """Rows query_id, rank, vec_id, score of ``vectors`` (vec_id, embedding)."""
    number = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(number, lambda x: x != 0)
    clean = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).distinct()
    # equal vectors: the smallest ids, one more than is asked for since a query leaves out its own
    ranked = clean.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= nearest + 1)
    grouped = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points, _ = materialize(grouped.select(F.get("ids", F.lit(0)).alias("first"), F.monotonically_increasing_id().alias("point"), "v", "ids"), "vectors")  # the numbers are fixed by the writing
    n, dims = points.agg(F.count("*"), F.coalesce(F.avg(F.size("v")), F.lit(1.0))).first()
    directions, shards = directions_for(n), max(LEAST_SHARDS, math.ceil(n * TABLES * dims / SHARD_NUMBERS))
    asked = clean.where(F.col("vec_id") % query_every == 0).select("vec_id", "v")
    asked, _ = materialize(asked.join(points.select("v", "point"), "v").select(F.col("vec_id").alias("query_id"), "point"), "queries")
    searching, searching_path = materialize(points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "first", "v"), "searching")

    v_type = points.schema["v"].dataType.simpleString()
    indexed, indexed_path = materialize(points.select("point", "first", "v").mapInPandas(_hashed(directions), f"key long, number int, point long, first long, v {v_type}"), "buckets")
    sizes, sizes_path = materialize(indexed.groupBy("key").agg(F.ceil(F.count("*") / PART_POINTS).alias("parts")), "sizes")
    shard = F.pmod(F.col("unit"), F.lit(shards)).cast("int").alias("shard")
    dealt = indexed.join(sizes, "key").select("number", unit_of("key", F.pmod("point", F.col("parts"))), "point", "first", "v")
    dealt = dealt.select("number", shard, F.lit(0).alias("kind"), F.array("unit").alias("units"), "point", "first", "v", F.lit(None).cast("double").alias("least"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first")

    def ranked_best(buckets: DataFrame, asking: DataFrame, check: bool, others: DataFrame | None = None) -> DataFrame:
        """The best points of each query of ``asking`` (shard, point, units, first, v, least) among ``buckets``, and ``others``."""
        both = buckets.drop("number").unionByName(asking.withColumn("kind", F.lit(1)))
        found = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInPandas(_searched(nearest, check), FOUND)
        found = found if others is None else found.unionByName(others)
        return found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= nearest + 1)

    visited = searching.mapInPandas(_visited(directions, share_for(n)), "key long, point long")
    units = visited.join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), "point").select(unit_of("key", F.col("part")), "point")
    probes, probes_path = materialize(units.select(shard, "unit", "point").groupBy("shard", "point").agg(F.collect_set("unit").alias("units")), "probes")
    probed, probed_path = materialize(ranked_best(dealt, probes.join(searching, "point").withColumn("least", F.lit(None).cast("double")), False), "probed")
    # the exact check: each query goes to every shard, and passes by the buckets it has visited
    worst = probed.where(F.col("n") == nearest + 1).select(F.col("query").alias("point"), F.col("score").alias("least"))
    everywhere = searching.join(worst, "point", "left").select("point", "first", "v", F.coalesce("least", F.lit(-2.0)).alias("least"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    checking = everywhere.join(probes, ["shard", "point"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<bigint>")))
    merged, _ = materialize(ranked_best(dealt.where("number = 0"), checking, True, probed.drop("n")), "best")
    for path in (searching_path, indexed_path, sizes_path, probes_path, probed_path):
        discard(vectors.sparkSession, path)
    merged = merged.join(points.select("point", "ids"), "point")
    listed = merged.select(F.col("query").alias("point"), "score", F.explode("ids").alias("vec_id")).groupBy("point", "vec_id").agg(F.max("score").alias("score"))
    pairs = asked.join(listed, "point").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def unit_of(key: str, part: Column) -> Column:
    """The number of a part of a bucket; two of one number would be searched together, which loses nothing."""
    return F.xxhash64(F.col(key), part.cast("long")).alias("unit")


def oracle(nearest: int = NEAREST, query_every: int = QUERY_EVERY) -> str:
    """Brute force in DuckDB SQL: equal at every size, since the check is exact."""
    total = lambda a, b: f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y)"
    return f"""
WITH raw AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
clean AS (SELECT vec_id, v, sqrt({total('v', 'v')}) AS norm FROM raw WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, max({total('q.v', 'c.v')} / (q.norm * c.norm)) AS score FROM clean q JOIN clean c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % {query_every} = 0 GROUP BY q.vec_id, c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {nearest}"""
