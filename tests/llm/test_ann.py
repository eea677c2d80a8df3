"""Nearest neighbours against brute force: exact on small tables, recall on larger ones."""

import numpy as np
import pandas as pd

from verisieve.llm import ann


def brute(rows, nearest=5, every=50):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -9), float(ann.cosines(a[None], b[None])[0]))
            out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:nearest], 1)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<double>, rank string, score int"


def test_exact_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(300 + i, rows[50][1]) for i in range(20)] + [(400, [2 * x for x in rows[0][1]]), (450, None), (500, []), (550, [0.0] * 6), (600, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (650, [float("nan")] * 6), (700, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (None, rows[0][1]), (750, [1e200, 1e200, 0.0, 0.0, 0.0, 1.0]), (800, [1.0, 2.0, 3.0])]
    docs = spark.createDataFrame([(i, v, "r", 1) for i, v in [*rows, rows[3], rows[50]]], SCHEMA)
    got = sorted(tuple(r) for r in ann.nearest_neighbours(docs).collect())
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_recall_with_buckets_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_POINTS", 60)
    monkeypatch.setattr(ann, "PART_POINTS", 100)
    monkeypatch.setattr(ann, "FULL_POINTS", 1)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    docs = spark.createDataFrame([(i, v, "r", 1) for i, v in rows], SCHEMA)
    assert ann.directions_for(3000) >= 3
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest_neighbours(docs).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    want = {(q * 50, int(i)) for q, row in enumerate(near) for i in np.argsort(-row)[1:6]}
    assert len(got & want) / len(want) >= 0.9


def test_small_tables_have_several_buckets():
    x = np.random.default_rng(3).normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    buckets = ann.Tables(64, ann.directions_for(500)).buckets(x)
    assert all(len(set(buckets[:, t])) > 9 for t in range(ann.TABLES))
    assert ann.share_for(500) > 0.999 and ann.share_for(10**9) == ann.SUCCESS


def test_empty(spark):
    assert ann.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probes_reach_their_share_with_many_directions():
    rng = np.random.default_rng(5)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 60, 64)))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    near = 0.4 * x + np.sqrt(1 - 0.4**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for k in (5, 6, 7, 8):
        t = ann.Tables(64, k)
        n = 60 if k < 8 else 20
        found = [np.isin(b, p).any() for b, p in zip(t.buckets(near[:n]), t.probes(x[:n]), strict=True)]
        assert np.mean(found) >= 0.9, k


def test_queries_far_from_all_others_find_enough(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_POINTS", 2)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=16)
    monkeypatch.setattr(ann, "FULL_POINTS", 1)
    rows = [(i, (v if i % 50 else -v).tolist()) for i, v in enumerate(20 * middle + rng.normal(size=(300, 16)))]
    docs = spark.createDataFrame([(i, v, "r", 1) for i, v in rows], SCHEMA)
    assert ann.directions_for(300) >= 4
    got = sorted(tuple(r) for r in ann.nearest_neighbours(docs, nearest=20).collect())
    assert [g[:3] for g in got] == [w[:3] for w in brute(rows, nearest=20)]


def test_results_do_not_depend_on_the_share_of_the_probes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    middles = 4 * rng.normal(size=(12, 16))
    x = np.concatenate([rng.normal(size=(900, 16)), middles[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(rng.permutation(x))] + [(5000 + 10 * i, rng.normal(size=7).tolist()) for i in range(30)]
    docs = spark.createDataFrame([(i, v, "r", 1) for i, v in rows], SCHEMA)
    want = [w[:3] for w in brute(rows)]
    monkeypatch.setattr(ann, "BUCKET_POINTS", 20)
    monkeypatch.setattr(ann, "PART_POINTS", 50)
    monkeypatch.setattr(ann, "FULL_POINTS", 1)  # as on the largest tables
    for share in (0.82, 0.05):
        monkeypatch.setattr(ann, "SUCCESS", share)
        assert sorted(tuple(r)[:3] for r in ann.nearest_neighbours(docs).collect()) == want, share


def test_no_point_of_a_bucket_exceeds_its_bound():
    rng = np.random.default_rng(10)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    middle, queries = rng.normal(size=8), unit(rng.normal(size=(500, 8)))
    ruled_out = 0
    for points in (middle + 0.1 * rng.normal(size=(50, 8)), rng.normal(size=(50, 8)), np.array([middle, -middle]), middle[None]):
        bucket = ann.Bucket(np.arange(len(points)), np.arange(len(points)), pd.Series(list(points)))
        near = (np.concatenate([queries, unit(points)]) @ unit(points).T).max(axis=1)
        most = bucket.most(np.concatenate([queries, unit(points)]))
        assert (most >= near).all()
        ruled_out += int((most < 0.9).sum())
    assert ruled_out > 500


def test_ties_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(0, 2, size=8) * 2.0 - 1).tolist() if i % 3 else [2.0 ** (i % 7 - 3)] * 8) for i in range(600)]
    rows = [(i, [x * 2.0 ** (i % 11) for x in v]) for i, v in rows]
    docs = spark.createDataFrame([(i, v, "r", 1) for i, v in rows[::-1]], SCHEMA)
    got = sorted(tuple(r) for r in ann.nearest_neighbours(docs).collect())
    assert [g[:3] for g in got] == [w[:3] for w in brute(rows)]
