"""The classifier learns an interaction, and handles odd rows."""

import os

import numpy as np
import pytest

from verisieve.llm import quality


#: Of the given labels on rows that the model has not seen.
LEAST_ACCURACY, LEAST_AUC = 0.97, 0.99


def test_interaction_is_learnt_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs or (1, 0) in m.pairs
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_score_is_a_sum_of_looked_up_values():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300).astype(float)
    m = quality.fit(x, y, rounds=5, pair_rounds=3)
    row = x[7]
    at = [int(np.searchsorted(e, row[j], side="right")) for j, e in enumerate(m.edges)]
    total = m.intercept + sum(t[i] for t, i in zip(m.tables, at)) + sum(t[at[j], at[k]] for (j, k), t in zip(m.pairs, m.pair_tables))
    assert np.isclose(m.score(row[None])[0], 1 / (1 + np.exp(-total)))


GOOD = "The river runs by the old mill and the town. People come here to rest, and children play near it."
BAD = "BUY!! NOW!! CHEAP!! CLICK!! HERE!! *** $$$ %%%"


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, y int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_odd_rows(spark):
    rows = [(i, (GOOD if i % 2 else BAD) + f" {i}", "s", 1) for i in range(200)]
    rows += [(1000, None, "s", 1), (1001, "", "s", 1), (1002, "x" * 300_000, "s", 1), (3, GOOD + " 3", "s", 1), (None, GOOD, "s", 1)]
    labels = [(i, i % 2, 0, "t") for i in range(200)] + [(5, 1, 0, "t"), (6, None, 0, "t"), (7, 0, 1, "t"), (None, 1, 0, "t"), (1000, 0, 0, "t")]
    docs, known = frames(spark, rows, labels)
    out = quality.classify(docs, known).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    same = [r["score"] for r in out if r["doc_id"] == 3]
    assert len(same) == 2 and same[0] == same[1]


def test_no_or_single_labels_and_empty_tables(spark):
    docs, none = frames(spark, [(1, GOOD, "", 1), (2, None, "", 1)], [])
    assert [r["score"] for r in quality.classify(docs, none).collect()] == [0.5, 0.5]
    docs, one = frames(spark, [(0, GOOD, "", 1), (4, BAD, "", 1)], [(0, 1, 0, ""), (4, 1, 0, "")])
    assert len({r["score"] for r in quality.classify(docs, one).collect()}) == 1
    empty, known = frames(spark, [], [(1, 1, 0, "")])
    assert quality.classify(empty, known).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows = [(i, (GOOD if i % 2 else BAD) + f" {i}", "s", 1) for i in range(60)]
    docs, known = frames(spark, rows, [(i, i % 2, 0, "t") for i in range(60)])
    a = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    flipped = [(i, i % 2 ^ a[i]["held_out"], 0, "t") for i in range(60)]
    b = {r["doc_id"]: r for r in quality.classify(docs, frames(spark, rows, flipped)[1]).collect()}
    assert a == b


@pytest.mark.parametrize("tables", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_held_out_accuracy_on_the_given_labels(spark, tables):
    if not os.path.isdir(tables):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    truth, score = np.array([r["quality"] for r in scored]), np.array([r["score"] for r in scored])
    accuracy = np.mean([r["quality"] == r["predicted"] for r in scored])
    ranks = score.argsort(kind="stable").argsort() + 1
    ones, zeros = (truth == 1).sum(), (truth == 0).sum()
    auc = (ranks[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)
    print(f"{tables}: {len(scored)} held-out rows, accuracy {accuracy:.4f}, AUC {auc:.4f}, share of ones {truth.mean():.3f}")
    assert accuracy > LEAST_ACCURACY and auc > LEAST_AUC
