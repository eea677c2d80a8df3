"""Fingerprints and components against plain Python, and shards against all pairs."""

import random
import re

import numpy as np
import xxhash

from verisieve.llm import simhash as s
from verisieve.llm.components import connected_components


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \t\n", "One", "a b c", "É É é A\x0bB C d e f g", " ".join(rng.choice("abcdef") for _ in range(500)), "x " * 100_000]:
        assert s.fingerprint(text).tolist() == [plain(text)], text
        assert s.fingerprint(text, words=3)[0] == plain(text)


def cloud(rng, n, groups):
    centers = [rng.getrandbits(64) for _ in range(groups)]
    out = set()
    while len(out) < n:
        c = rng.choice(centers)
        for _ in range(rng.randrange(0, 7)):
            c ^= 1 << rng.randrange(64)
        out.add(c)
    return sorted(out)


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def shard(fps, limits, part=0):
    fp = np.array(fps, np.uint64)[:, None]
    return s.link_shard(part, fp, np.full(len(fps), 3, np.int8), np.arange(len(fps)), limits)


def test_shard_links_all_pairs(monkeypatch):
    monkeypatch.setattr(s, "LEAF", 4)
    fps = cloud(random.Random(2), 400, 60)
    label, pairs, more = shard(fps, s.Limits(22, 4, 4))
    assert same_partition(label.tolist(), classes(fps)) and not len(pairs) and not len(more)


def numbered(spark, fps):
    return spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(fps)], "number long, fp string").repartition(3)


def test_shards_together_lose_no_link(spark):
    rng = random.Random(3)
    for fps in (cloud(rng, 600, 150), cloud(rng, 500, 2), [0, 15, 31], list(range(64))):
        for cell_points in (s.CELL_POINTS, 60):
            edges = s.linked_pairs(numbered(spark, fps), shard_points=40, cell_points=cell_points)
            parts = {r["node"]: r["component"] for r in connected_components(edges).collect()}
            assert same_partition([parts.get(i, i) for i in range(len(fps))], classes(fps))


def test_full_shards_are_cut_into_cells():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 8, 4000).astype(np.uint32)
    routes = s.Routes(points[:1000], 1, 2, 4000, 100)
    assert routes.cells
    met, largest = set(), 0
    for shard_, cell, at, role in routes.dealt(points, np.arange(4000), np.ones(4000, bool)):
        largest = max(largest, len(at))
        own, ask = at[role & 1 > 0], at[role & 2 > 0]
        a, b = np.nonzero(s.apart(points[own][:, None], points[ask][None, :]) <= 1)
        met |= set(zip(own[a].tolist(), ask[b].tolist()))
    a, b = np.nonzero(s.apart(points[:, None], points[None, :]) <= 1)
    assert met == set(zip(a.tolist(), b.tolist())) and largest < 500


def test_dense_groups_link_without_their_pairs(monkeypatch):
    monkeypatch.setattr(s, "LEAF", 3)
    rng = random.Random(5)
    fps = sorted({(1 << 40) ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(30)) for _ in range(300)})
    label, _, _ = shard(fps, s.Limits(1, 4, 4), part=2)
    assert same_partition(label.tolist(), classes(fps))


def test_proposals_are_the_nearest_and_the_rest_is_told(monkeypatch):
    monkeypatch.setattr(s, "LEAF", 4)
    fps = cloud(random.Random(11), 300, 8)
    label, pairs, more = shard(fps, s.Limits(22, 1, 6, 1000))
    want = {(i, j) for i in range(300) for j in range(i) if label[i] != label[j] and bin(fps[i] ^ fps[j]).count("1") <= 6}
    assert set(map(tuple, pairs.tolist())) == want and not len(more)
    _, few, more = shard(fps, s.Limits(22, 1, 6, 2))
    assert set(map(tuple, few.tolist())) < want and {a for a, b in want - set(map(tuple, few.tolist()))} <= set(more.tolist())


def varied(rng, words, share):
    """A copy in which about that share of five-word shingles is kept, of those that either has."""
    out, n = list(words), len(words)
    changes = round(n * (1 - share) / (1 + share) / 5)
    for k in range(changes):
        out[5 * k * (n // (5 * changes)) + 2] = f"other{rng.randrange(10**6)}"
    return out


def test_recall_at_the_limit_and_nothing_below(spark):
    rng = random.Random(12)
    rows, pairs = [], []
    for k in range(400):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 500))]
        copy = varied(rng, base, rng.choice([0.6, 0.7, 0.76, 0.82, 0.86, 0.92]))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        pairs.append(s.similarity(*(s.shingles(t, 5) for _, t in rows[-2:])))
    kept = {r["doc_id"] for r in s.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    dropped = {k for k in range(400) if 2 * k + 1 not in kept}
    assert {2 * k for k in range(400)} <= kept and all(pairs[k] >= 0.8 for k in dropped)
    close = [k for k, p in enumerate(pairs) if p >= 0.8]
    assert len(close) > 120 and len(dropped) / len(close) > 0.97


def test_chains_and_many_proposals_are_followed_to_the_end(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    crowd = [varied(random.Random(i), base, 0.72) for i in range(30)]  # all alike, none similar enough
    rows = [(i, " ".join(c)) for i, c in enumerate(crowd)] + [(100, " ".join(base)), (101, " ".join(varied(rng, base, 0.85)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [{r["doc_id"]: r["component"] for r in s.similar_groups(docs, s.Limits(1, 0, 160, 1), asking=n).collect()} for n in (0, s.ASKING)]
    got = runs[0]
    assert same_partition([runs[0][i] for i, _ in rows], [runs[1][i] for i, _ in rows])
    sets = {i: s.shingles(t, 5) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if s.similarity(sets[i], sets[j]) >= 0.8:
                label = {k: min(label[i], label[j]) if x in (label[i], label[j]) else x for k, x in label.items()}
    assert same_partition([got[i] for i in sets], [label[i] for i in sets]) and len(set(label.values())) > 5


def test_a_crowd_costs_no_row_for_each_pair(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    crowd = [varied(random.Random(i), base, 0.72) for i in range(200)]  # all alike, none similar enough
    copies = [varied(random.Random(1000 + i), c, 0.9) for i, c in enumerate(crowd[:20])]
    rows = [(i, " ".join(c)) for i, c in enumerate(crowd + copies)]
    sizes = {}

    def counted(df, label, write=s.materialize):
        out, path = write(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out, path

    monkeypatch.setattr(s, "materialize", counted)
    monkeypatch.setattr(s, "ASKED_BYTES", 100_000, raising=False)  # several portions
    got = {r["doc_id"]: r["component"] for r in s.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), s.Limits(1, 0, 160, 1)).collect()}
    sets = [s.shingles(t, 5) for _, t in rows]
    want = list(range(len(rows)))
    for i in want[:]:
        for j in range(i):
            if s.similarity(sets[i], sets[j]) >= 0.8:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert same_partition([got[i] for i, _ in rows], want) and len(set(want)) == 200
    assert max(sizes.values()) < 8000, sizes  # of 24,090 pairs


def test_shared_shingles_tell_what_similarity_tells():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 60))) for _ in range(80)] + [np.empty(0, np.int64)]
    index = s.Shingles(np.concatenate(sets).astype(np.int64), np.array([len(x) for x in sets]))
    for own in [*sets, np.arange(60), np.array([99])]:
        near = index.alike(own.astype(np.int64)).tolist()
        assert near == [j for j, x in enumerate(sets) if s.similarity(own, x) >= 0.8]


def test_one_of_each_group_stays(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(12)]
    rows = []
    for i, b in enumerate(base):
        rows.append((10 * i, " ".join(b)))
        for k in range(1, 4):
            c = list(b)
            for _ in range(k):
                c[rng.randrange(len(c))] = "changed"
            rows.append((10 * i + k, " ".join(c)))
        rows.append((10 * i + 5, " ".join(b[:150] + [rng.choice(words) for _ in range(150)])))
    rows += [rows[0], (None, rows[5][1]), (None, "alone here"), (None, "alone here"), (997, None), (998, "")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, component string, _text_key string, _id string")
    kept = s.drop_near_duplicates(docs)
    assert {(r["component"], r["_text_key"], r["_id"]) for r in kept.collect()} == {("x", "y", "z")}
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, x) for i in range(12) for x in (10 * i, 10 * i + 5)] + [(False, 997), (True, None)]


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(1000, 1300)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 500 for i in (500, *range(1000, 1300))) and got[2001] == 2000 and len(got) == 101 + 301 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["red", "blue", "green", "stone", "river"]) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 300))) for _ in range(25)]
    texts = [None, "", " ", "Word", "word"]
    for b in base:
        texts += [b, b.upper(), b + " tail", b.replace("red1", "redx")]
    ids = [i * 3 for i in range(len(texts))]
    rows = [(i, t, "f", 1) for i, t in zip(ids, texts)] + [(ids[5], texts[5], "f", 1), (None, texts[6], "f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    got = s.digest(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    fps = [plain(t) for t in texts]
    label = classes(fps)
    for i, t, own in zip(ids, fps, label):
        assert by[i]["fingerprint"] == f"{t:016x}"
        assert by[i]["component_id"] == min(j for j, x in zip(ids, label) if x == own)
    assert by[None]["component_id"] == by[ids[6]]["component_id"]
    assert s.digest(docs.limit(0)).count() == 0


def test_edges_do_not_depend_on_the_rows_order(spark):
    rng = random.Random(8)
    keys = ["".join(f"{x:016x}" for x in (rng.getrandbits(64), *(rng.getrandbits(64) for _ in range(7)))) for _ in range(80)]
    for k in list(keys):
        for _ in range(6):
            bits = int(k, 16)
            for _ in range(rng.randrange(20, 100)):
                bits ^= 1 << rng.randrange(512)
            keys.append(f"{bits:0128x}")
    rows, runs = list(enumerate(keys)), []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        points = spark.createDataFrame(rows, "number long, fp string").repartition(seed + 2)
        runs.append(sorted(map(tuple, s.shard_edges(points, s.DEDUP, shard_points=100).collect())))
    assert runs[0] == runs[1] and runs[0]
