"""Boosted trees: the same for any partitions, against a plain version, odd tables."""

from __future__ import annotations

import numpy as np
import pytest

from sparkgrove.operators import boosting as b
from sparkgrove.operators import evaluate
from sparkgrove.plans import catalogue

SCHEMA = "entity_id long, features array<double>, label int"


@pytest.fixture(scope="module")
def rings(spark):
    """Class 1 lies where the signs of two features differ, which no single split tells."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] < 0).astype(int) + 2
    return spark.createDataFrame([(i, a, int(c)) for i, (a, c) in enumerate(zip(x.tolist(), y))], SCHEMA).persist(), x, y


def plain(x, y, rounds, depth, bins, rate, l2, least):
    """Scores by row and class, by trying every split of every node over the rows themselves."""
    cuts = np.round(np.quantile(x, np.arange(1, bins) / bins, axis=0), 9)
    binned = np.stack([np.searchsorted(cuts[:, j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    labels = np.unique(y)
    scores = np.zeros((len(x), len(labels)))
    for _ in range(rounds):
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        g, h = np.rint((p - (y[:, None] == labels)) * b.UNIT) / b.UNIT, np.rint(p * (1 - p) * b.UNIT) / b.UNIT
        new = scores.copy()
        for c in range(len(labels)):
            nodes = [np.arange(len(x))]
            for _level in range(depth):
                deeper = []
                for rows in nodes:
                    best, parts = 0.0, (rows, rows[:0])
                    for j in range(x.shape[1]):
                        for cut in range(bins - 1):
                            left = rows[binned[rows, j] <= cut]
                            right = rows[binned[rows, j] > cut]
                            if min(len(left), len(right)) < least:
                                continue
                            worth = lambda r: g[r, c].sum() ** 2 / (h[r, c].sum() + l2)
                            gain = worth(left) + worth(right) - worth(rows)
                            if gain > best + 1e-12:
                                best, parts = gain, (left, right)
                    deeper += parts
                nodes = deeper
            for rows in nodes:
                if len(rows):
                    new[rows, c] -= rate * g[rows, c].sum() / (h[rows, c].sum() + l2)
        scores = new
    return labels, scores


def test_equals_a_plain_version(rings):
    df, x, y = rings
    trees = b.fit(df, rounds=3, depth=2, bins=8, rate=0.5, l2=1.0, least_rows=5)
    labels, scores = plain(x, y, 3, 2, 8, 0.5, 1.0, 5)
    assert trees.labels.tolist() == labels.tolist()
    assert np.allclose(trees.scores(trees.binned(x)), scores, atol=1e-9)
    made = b.predict(df, trees).collect()
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    assert all(np.allclose(r.prob, p[r.entity_id]) and r.predicted == labels[scores[r.entity_id].argmax()] for r in made)


def test_partitions_change_nothing(rings):
    df = rings[0]
    one, many = (b.fit(df.repartition(n), rounds=3, depth=3, bins=8) for n in (1, 13))
    assert all(np.array_equal(x, y) for x, y in zip(one, many))
    assert evaluate.accuracy(b.predict(df, one)).first()[0] > 0.8


def test_raw_is_left_to_chance(spark, sf_dir):
    raw = catalogue.features(spark, sf_dir)
    assert evaluate.accuracy(b.boosted(*catalogue.split(raw), rounds=3)).first()[0] <= 0.25


def test_odd_tables(spark, monkeypatch):
    same = spark.createDataFrame([(i, [1.0, 2.0], i % 2) for i in range(40)], SCHEMA)  # nothing to split
    trees = b.fit(same, rounds=2)
    made = b.predict(same, trees).collect()
    assert {r.predicted for r in made} == {0} and all(r.prob == pytest.approx([0.5, 0.5]) for r in made)
    one = spark.createDataFrame([(1, [1.0], 7)], SCHEMA)
    assert [r.predicted for r in b.predict(one, b.fit(one, rounds=1)).collect()] == [7]
    assert b.predict(one.limit(0), b.fit(one, rounds=1)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        b.fit(one.limit(0))
    monkeypatch.setattr(b, "MAX_HISTOGRAM", 20)
    with pytest.raises(ValueError, match="more than 20"):
        b.fit(same)
