"""Approximate neighbours: recall, crowded buckets, the exact way for the rest, plan and odd tables."""

from __future__ import annotations

import numpy as np
import pytest

from sparkgrove.operators import approximate as a
from sparkgrove.operators import classify
from sparkgrove.operators.neighbours import cosine, nearest

SCHEMA = "entity_id long, features array<double>"


def rows(df):
    return {(r.entity_id, r.i): (r.train_id, round(r.near, 9)) for r in df.collect()}


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, r) for i, r in enumerate(np.asarray(x, float).tolist())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def crowds(spark):
    """30 crowds of rows around directions, in 24 dimensions; queries near them."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 24))
    train = np.concatenate([m + rng.normal(scale=0.25, size=(40, 24)) for m in middle])
    test = middle + rng.normal(scale=0.25, size=middle.shape)
    return table(spark, train).persist(), table(spark, test, 10_000).persist()


def test_recall_and_every_nearness_is_true(crowds):
    train, test = crowds
    found, exact = a.approximate(test, train, 5), nearest(test, train, 5, cosine)
    assert a.recall(found, exact).first().recall >= 0.9
    true = {(q.entity_id, t.entity_id): round(float(cosine(np.array([q.features]), np.array([t.features]))[0, 0]), 9) for q in test.collect() for t in train.collect()}
    made = found.collect()
    assert len(made) == 150 and all(true[r.entity_id, r.train_id] == pytest.approx(r.near, abs=2e-9) for r in made)


def test_all_probes_are_exact(crowds):
    train, test = crowds
    assert rows(a.approximate(test, train, 5, tables=1, bits=4, unsure=4)) == rows(nearest(test, train, 5, cosine).select("entity_id", "near", "train_id", "i"))


def test_a_crowded_bucket_is_split_and_gives_the_same(spark, crowds, monkeypatch):
    train, test = crowds
    same = train.unionByName(table(spark, np.ones((700, 24)), 5_000))  # a third of the rows in one bucket
    whole = rows(a.approximate(test, same, 5))
    monkeypatch.setattr(a, "BLOCK_BYTES", 1)  # 16 rows a block
    monkeypatch.setattr(a, "SPREAD", 3)
    monkeypatch.setattr(a, "GATHERED", 50)
    blocks = a._blocks(a.hashed(same, 1, 6, 0, 24), 16).collect()
    assert max(len(b.ids) for b in blocks) <= 48 and max(b.n_blocks for b in blocks) >= 700 // 16
    assert rows(a.approximate(test, same, 5)) == whole


def test_rows_that_meet_too_few_are_answered_exactly(spark):
    rng = np.random.default_rng(1)
    train, test = table(spark, rng.normal(size=(12, 8))), table(spark, rng.normal(size=(6, 8)), 100)
    made = a.approximate(test, train, 5, tables=1, bits=12, unsure=0)
    assert rows(made) == rows(nearest(test, train, 5, cosine).select("entity_id", "near", "train_id", "i"))
    assert len(rows(a.approximate(test, train, 20))) == 6 * 12


def test_codes_by_hand():
    margins = np.array([[0.5, -0.1, 2.0]])
    assert a.codes(margins, 0).tolist() == [[5]]
    assert sorted(a.codes(margins, 2)[0].tolist()) == [4, 5, 6, 7]
    assert a.codes(margins, 1)[0].tolist() == [5, 7]


def test_no_cross_join_and_votes(crowds):
    train, test = crowds
    plan = a.approximate(test, train, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    marked = train.withColumn("label", (train.entity_id / 40).cast("int"))
    made = classify.knn_approximate(marked, test.withColumn("label", (test.entity_id - 10_000).cast("int")))
    assert made.where("label = predicted").count() == 30


def test_odd_tables(spark, monkeypatch):
    some, none = table(spark, [[1, 0], [0, 0], [1, 0]]), spark.createDataFrame([], SCHEMA)
    assert a.approximate(none, some, 2).count() == 0 and a.approximate(some, none, 2).count() == 0
    found = rows(a.approximate(some, some, 2))
    assert found[0, 1] == (0, 1.0) and found[0, 2] == (2, 1.0) and found[1, 1] == (0, 0.0)  # ties to the lower id
    with pytest.raises(ValueError, match="unsure"):
        a.approximate(some, some, 2, bits=2, unsure=3)
    monkeypatch.setattr(a, "MAX_PLANES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        a.approximate(some, some, 2)
