"""Support vector machines: margins by hand, objective against a plain optimiser, odd tables."""

from __future__ import annotations

import numpy as np
import pytest

from sparkgrove.operators import evaluate, margin
from sparkgrove.plans import catalogue

SCHEMA = "entity_id long, features array<double>, label int"
TINY = [(1, [1.0, 10.0], 0), (2, [2.0, 12.0], 0), (3, [3.0, 14.0], 0), (4, [7.0, 11.0], 1), (5, [8.0, 12.0], 1), (6, [9.0, 13.0], 1)]


def objective(z, y, w, reg):
    return reg / 2 * (w[1:] ** 2).sum() + np.maximum(0, 1 - y * (z @ w)).mean()


def test_margins_by_hand(spark):
    """Two classes are told apart by the first feature, whose middle is 5: planes are opposite,
    and no row of the support (3 and 7) lies inside the margin by more than the loss allows."""
    df = spark.createDataFrame(TINY, SCHEMA).repartition(3)
    planes = margin.fit(df, reg=0.01, iterations=60)
    assert np.allclose(planes.weights[0], -planes.weights[1], atol=1e-9)
    at_middle = planes.weights[1] @ np.array([1, (5 - planes.means[0]) / planes.scales[0], 0])
    assert abs(at_middle) < 0.3 and planes.weights[1, 1] > abs(planes.weights[1, 2])
    made = {r.entity_id: r for r in margin.predict(df, planes).collect()}
    assert all(r.predicted == r.label for r in made.values())
    assert made[6].margins[1] > made[4].margins[1] > 0 > made[3].margins[1] > made[1].margins[1]


def test_subgradient_by_hand(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [2.0], 1)], SCHEMA)
    rows, planes, n = margin.start(df)  # standardised to -1/sqrt 2 and 1/sqrt 2
    planes = planes._replace(weights=np.array([[0.0, 0.0], [0.5, 2.0]]))
    value, slope = margin.subgradient(rows, planes, n, 0.1)
    z = 2**-0.5
    assert slope[0] == pytest.approx([0, z]) and value[0] == 1
    # the first row has 1 + 0.5 - 2 z > 0, the second 1 - 0.5 - 2 z < 0
    assert value[1] == pytest.approx(0.1 / 2 * 4 + (1.5 - 2 * z) / 2) and slope[1] == pytest.approx([0.5, 0.2 - z / 2])


def test_objective_near_that_of_a_plain_optimiser(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = np.where(x @ [1, -1, 0.3] + rng.normal(scale=0.5, size=200) > 0, 1, 0)
    df = spark.createDataFrame([(i, a, int(b)) for i, (a, b) in enumerate(zip(x.tolist(), y))], SCHEMA).repartition(4)
    planes = margin.fit(df, reg=0.1, iterations=40)
    z = np.column_stack([np.ones(200), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)])
    side, w, least = 2.0 * y - 1, np.zeros(4), np.inf
    for t in range(1, 20_001):
        slope = 0.1 * w * [0, 1, 1, 1] - (z * side[:, None])[side * (z @ w) < 1].sum(axis=0) / 200
        w = w - slope / (0.1 * (t + 20))
        least = min(least, objective(z, side, w, 0.1))
    found = objective(z, side, planes.weights[1], 0.1)
    assert found == pytest.approx(min(h[1] for h in planes.history)) and found <= 1.05 * least


def test_planted_and_raw(spark, sf_dir):
    raw = catalogue.features(spark, sf_dir)
    score = lambda feat: evaluate.accuracy(margin.linear_svm(*catalogue.split(feat))).first()[0]
    assert score(catalogue.planted(raw)) >= 0.95 and score(raw) <= 0.25


def test_odd_tables(spark, monkeypatch):
    one = spark.createDataFrame([(1, [1.0, 5.0], 3), (2, [2.0, 5.0], 3)], SCHEMA)
    made = margin.linear_svm(one, one, iterations=3).collect()
    assert [r.predicted for r in made] == [3, 3] and all(np.isfinite(r.margins).all() for r in made)
    with pytest.raises(ValueError, match="no rows"):
        margin.fit(one.limit(0))
    monkeypatch.setattr(margin, "MAX_MODEL", 2)
    with pytest.raises(ValueError, match="more than 2"):
        margin.fit(one)
