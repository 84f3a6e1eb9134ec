"""Ridge regression against the normal equations, for any partitioning and fold."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkgrove.operators import regress

SCHEMA = "entity_id long, fold int, features array<double>"


def plain(x: np.ndarray, target: int, reg: float) -> np.ndarray:
    """Intercept and coefficients from centred columns."""
    others = [i for i in range(x.shape[1]) if i != target]
    c = x - x.mean(axis=0)
    coefficients = np.linalg.solve(c[:, others].T @ c[:, others] + reg * len(x) * np.eye(len(others)), c[:, others].T @ c[:, target])
    out = np.zeros(x.shape[1] + 1)
    out[[i + 1 for i in others]] = coefficients
    out[0] = x[:, target].mean() - out[1:] @ x.mean(axis=0)
    return out


@pytest.fixture(scope="module")
def table(spark):
    """Far from zero, the second feature a sum of others and noise."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = [1e6 + rng.gauss(0, 1), 0.0, rng.gauss(-5, 2), rng.gauss(0, 1)]
        x[1] = 2 * (x[0] - 1e6) - x[2] + 3 + rng.gauss(0, 0.1)
        rows.append((i, i % 3, x))
    return spark.createDataFrame(rows, SCHEMA).persist(), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])


@pytest.mark.parametrize("reg", [0.0, 0.5])
def test_is_the_solution_of_the_normal_equations(table, reg):
    df, x, _ = table
    got = regress.ridge(df.repartition(7), 1, reg)
    assert got == pytest.approx(plain(x, 1, reg), rel=1e-6, abs=1e-6 * (1 if reg else 10))
    made = {r.entity_id: (r.v, r.predicted) for r in regress.predict(df, 1, got).collect()}
    assert np.allclose([made[i][1] for i in range(300)], got[0] + x @ got[1:]) and made[5][0] == x[5, 1]
    if not reg:
        assert got[1] == pytest.approx(2, abs=0.05) and got[3] == pytest.approx(-1, abs=0.05) and got[2] == 0


def test_all_folds_from_one_pass(table):
    df, x, fold = table
    made = {r.entity_id: r for r in regress.out_of_fold(df, 1, 0.1).collect()}
    assert len(made) == 300
    for f in range(3):
        model = plain(x[fold != f], 1, 0.1)
        at = np.flatnonzero(fold == f)
        assert np.allclose([made[i].predicted for i in at], model[0] + x[at] @ model[1:], atol=1e-5) and {made[i].fold for i in at} == {f}


def test_odd_tables(spark, table, monkeypatch):
    one = spark.createDataFrame([(1, 0, [3.0]), (2, 1, [5.0])], SCHEMA)
    assert regress.ridge(one, 0).tolist() == [4.0, 0.0]
    same = spark.createDataFrame([(i, 0, [2.0, 7.0]) for i in range(4)], SCHEMA)  # nothing varies
    assert regress.ridge(same, 1, 0.0).tolist() == [7.0, 0.0, 0.0]
    assert regress.out_of_fold(same, 1).count() == 0  # no other fold to learn from
    with pytest.raises(ValueError, match="no rows"):
        regress.ridge(one.limit(0), 0)
    monkeypatch.setattr(regress, "MAX_GRAM", 20)
    with pytest.raises(ValueError, match="more than 20"):
        regress.ridge(table[0], 1)
