"""Gaussian mixtures: likelihood never falls, overlapping classes are found, odd tables."""

from __future__ import annotations

import numpy as np
import pytest

from sparkgrove.operators import mixture

SCHEMA = "entity_id long, features array<double>"


@pytest.fixture(scope="module")
def table(spark):
    """Two classes that overlap, of unequal size and spread."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal([0, 0], [1, 0.3], (300, 2)), rng.normal([2, 1], [0.5, 1.0], (100, 2))])
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], SCHEMA).repartition(5).persist(), x


def test_likelihood_never_falls_and_parameters_are_found(table):
    df, x = table
    model = mixture.gaussian_mixture(df, 2, iterations=40)
    assert len(model.history) > 3 and all(b >= a - 1e-9 * abs(a) for a, b in zip(model.history, model.history[1:]))
    big = int(model.weights.argmax())
    assert model.weights[big] == pytest.approx(0.75, abs=0.08) and model.means[big] == pytest.approx([0, 0], abs=0.2) and model.means[1 - big] == pytest.approx([2, 1], abs=0.4)
    made = {r.entity_id: r for r in mixture.responsibilities(df, model).collect()}
    assert sum(r.log_density for r in made.values()) == pytest.approx(model.history[-1], rel=1e-6)
    assert all(sum(r.prob) == pytest.approx(1) and r.prob[r.cluster] == max(r.prob) for r in made.values())
    right = sum((made[i].cluster == big) == (i < 300) for i in range(400))
    assert right >= 360


def test_an_iteration_is_that_of_the_formulas(table):
    df, x = table
    model = mixture.Mixture(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.ones((2, 2)), [])
    new, ll = mixture._step(df, model)
    density = np.stack([0.5 * np.exp(-0.5 * ((x - m) ** 2).sum(axis=1)) / (2 * np.pi) for m in model.means], axis=1)
    share = density / density.sum(axis=1, keepdims=True)
    assert ll == pytest.approx(np.log(density.sum(axis=1)).sum())
    means = share.T @ x / share.sum(axis=0)[:, None]
    assert np.allclose(new.means, means) and np.allclose(new.weights, share.mean(axis=0))
    assert np.allclose(new.variances, [(share[:, j] @ (x - means[j]) ** 2) / share[:, j].sum() for j in range(2)])


def test_odd_tables(spark, table, monkeypatch):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], SCHEMA)
    model = mixture.gaussian_mixture(same, 2)
    assert model.weights.sum() == pytest.approx(1) and np.allclose(model.means[model.weights > 0], [1, 2]) and np.isfinite(model.history).all()
    far = spark.createDataFrame([(i, [1e8 + i % 2]) for i in range(6)], SCHEMA)  # far from zero
    assert np.isfinite(mixture.gaussian_mixture(far, 2).means).all()
    monkeypatch.setattr(mixture, "MAX_MODEL", 3)
    with pytest.raises(ValueError, match="more than 3"):
        mixture.gaussian_mixture(same, 2)
