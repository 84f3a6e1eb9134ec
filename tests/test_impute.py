"""Missing features: hand-checked fills, neighbours against brute force, nothing from test rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sparkgrove.operators import impute, neighbours

SCHEMA = "entity_id long, label int, features array<double>"


def rows(df) -> dict[int, list]:
    return {r.entity_id: list(r.features) for r in df.collect()}


@pytest.fixture(scope="module")
def tiny(spark):
    train = [(1, 0, [1.0, None, 10.0]), (2, 0, [2.0, 20.0, None]), (3, 1, [9.0, 30.0, 90.0]), (4, 1, [None, None, None])]
    test = [(11, 0, [1.5, None, None]), (12, 1, [float("nan"), 31.0, 80.0]), (13, 0, [None, None, None]), (14, 1, [5.0, 6.0, 7.0])]
    return spark.createDataFrame(train, SCHEMA), spark.createDataFrame(test, SCHEMA)


def test_means_by_hand(tiny):
    train, test = tiny
    assert impute.feature_means(train) == [4.0, 25.0, 50.0]
    assert rows(impute.mean_fill(test, train)) == {11: [1.5, 25.0, 50.0], 12: [4.0, 31.0, 80.0], 13: [4.0, 25.0, 50.0], 14: [5.0, 6.0, 7.0]}
    assert rows(impute.mean_fill(train))[4] == [4.0, 25.0, 50.0]


def test_neighbours_by_hand(tiny):
    train, test = tiny
    got = rows(impute.neighbour_fill(test, train, 2))
    assert got[11] == [1.5, 20.0, 10.0]  # rows 1 and 2, each with one of the two elements
    assert got[12] == [5.5, 31.0, 80.0]  # row 3, then row 2
    assert got[13] == [4.0, 25.0, 50.0] and got[14] == [5.0, 6.0, 7.0]
    assert rows(impute.neighbour_fill(train, k=1))[1] == [1.0, 20.0, 10.0]  # not itself


def test_a_feature_that_no_row_has_and_empty_tables(spark, tiny):
    train, test = tiny
    none = spark.createDataFrame([(1, 0, [None, 1.0])], SCHEMA)
    two = spark.createDataFrame([(5, 0, [None, None])], SCHEMA)
    assert rows(impute.mean_fill(two, none)) == rows(impute.neighbour_fill(two, none)) == {5: [None, 1.0]}
    assert rows(impute.neighbour_fill(test.limit(0), train)) == {} and rows(impute.mean_fill(two, none.limit(0))) == {5: [None, None]}
    assert set(impute.neighbour_fill(test, train).columns) == set(test.columns)


@pytest.mark.parametrize("block, nodes", [(64 << 20, 64), (500, 2)])
def test_neighbours_are_those_of_brute_force(spark, monkeypatch, block, nodes):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", block)
    monkeypatch.setattr(neighbours, "NODES", nodes)
    rng = random.Random(3)
    draw = lambda: [rng.choice((None, round(rng.gauss(1000, 1), 1), rng.randint(999, 1002) * 1.0)) for _ in range(5)]
    train = [(i, i % 3, draw()) for i in range(90)] + [(500 + i, 0, [1000.0] * 5) for i in range(10)]
    test = [(i, 0, draw()) for i in range(60, 120)]
    frames = [spark.createDataFrame(t, SCHEMA).repartition(n) for t, n in ((test, 2), (train, 4))]
    got = {}
    for r in neighbours.nearest(*frames, 4, neighbours.over_shared, ["label"], others=True, tile_rows=7, product=100).collect():
        got.setdefault(r.entity_id, []).append((r.i, r.train_id, r.label, round(-r.near, 6)))
    for i, _, q in test:
        found = []
        for t, label, x in train:
            shared = [(a - b) ** 2 for a, b in zip(q, x) if a is not None and b is not None]
            if shared and t != i:
                found.append((round(sum(shared) / len(shared), 9), t, label))
        assert sorted(got.get(i, [])) == [(j + 1, t, label, round(d, 6)) for j, (d, t, label) in enumerate(sorted(found)[:4])]


def test_known_elements_stay_and_neighbours_beat_means(spark):
    """Two far classes: a neighbour tells a missing element, a mean does not."""
    rng = random.Random(1)
    true = [(i, i % 2, [rng.gauss(10 * (i % 2), 0.5) for _ in range(6)]) for i in range(200)]
    hide = {(i, p) for i, _, _ in true for p in range(6) if rng.random() < 0.2}
    lacking = [(i, c, [None if (i, p) in hide else v for p, v in enumerate(x)]) for i, c, x in true]
    frames = [spark.createDataFrame(t, SCHEMA) for t in (lacking, true)]
    errors = {}
    for fill in (impute.mean_fill, impute.neighbour_fill):
        made = fill(frames[0].where("entity_id % 4 = 0"), frames[0].where("entity_id % 4 <> 0"))
        for i, x in rows(made).items():
            assert all(math.isclose(a, b) for p, (a, b) in enumerate(zip(x, true[i][2])) if (i, p) not in hide)
        error = impute.fill_error(made, frames[0].where("entity_id % 4 = 0"), frames[1]).first()
        assert error.n == sum(i % 4 == 0 for i, _ in hide)
        errors[fill] = error.rmse
    assert errors[impute.neighbour_fill] < 1 < 4 < errors[impute.mean_fill]


def test_partial_lists_are_cut_before_they_are_shuffled(spark):
    train = spark.range(1000).selectExpr("id AS entity_id", "array(double(id), 1.0D) AS features").repartition(8)
    made = neighbours.nearest(train.limit(5), train, 3, neighbours.cosine)
    assert "WindowGroupLimit" in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.groupBy("entity_id").count().where("count <> 3").count() == 0


def test_nearness_without_shared_elements():
    nan = float("nan")
    near = neighbours.over_shared(np.array([[1.0, nan], [nan, nan]]), np.array([[nan, 2.0], [3.0, nan]]))
    assert near[0].tolist() == [-np.inf, -4.0] and (near[1] == -np.inf).all()


def test_memory_of_a_block_does_not_grow_with_its_rows():
    """Matrices are as wide as a slice, and the result is that of one product."""
    rng = np.random.default_rng(4)
    q, x = (np.where(rng.random((n, 4)) < 0.2, np.nan, rng.integers(0, 4, (n, 4)).astype(float)) for n in (20, 9000))
    ids, train_ids, widest = np.arange(20), rng.permutation(9000), []

    def watched(q, x):
        widest.append(len(x))
        return neighbours.over_shared(q, x)

    row, at, near = neighbours._of_slices(3, watched, ids, q, train_ids, x, True)
    assert max(widest) <= 2048 and sum(widest) == 9000
    whole = neighbours.over_shared(q, x)
    whole[ids[:, None] == train_ids] = -np.inf
    want = neighbours._best(3, whole, train_ids)
    assert row.tolist() == want[0].tolist() and at.tolist() == want[1].tolist() and np.allclose(near, whole[want])
