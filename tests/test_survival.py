"""Survival curves and log-rank tests: hand-checked, against brute force, for any partitioning."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrove.functions.ranged import ranged, running
from sparkgrove.operators import survival

SCHEMA = "label int, time double, event boolean"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def curve(df, **more) -> list[tuple]:
    at = survival.kaplan_meier(df, **more).collect()
    return sorted((r.label, r.time, r.n_risk, r.n_event, r.n_censored, round(r.survival, 9), None if r.std_err is None else round(r.std_err, 9)) for r in at)


def brute_curve(rows: list[tuple]) -> list[tuple]:
    out = []
    for label in sorted({r[0] for r in rows}):
        s, g = 1.0, 0.0
        for time in sorted({r[1] for r in rows if r[0] == label}):
            risk = sum(r[0] == label and r[1] >= time for r in rows)
            n = sum(r[0] == label and r[1] == time for r in rows)
            d = sum(r[0] == label and r[1] == time and r[2] for r in rows)
            s *= 1 - d / risk
            g += d / (risk * (risk - d)) if d < risk else 0
            out.append((label, time, risk, d, n - d, round(s, 9), round(s * math.sqrt(g), 9) if s > 0 else None))
    return out


def made(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(label := rng.choice((0, 0, 1, 2)), float(int(rng.expovariate(0.02 * (1 + label)))), rng.random() < 0.7) for _ in range(n)]


def test_by_hand(spark):
    """Times 1, 2+, 3, 3, 4+ and 5, of six entities."""
    rows = [(0, 1.0, True), (0, 2.0, False), (0, 3.0, True), (0, 3.0, True), (0, 4.0, False), (0, 5.0, True)]
    got = survival.kaplan_meier(table(spark, rows)).orderBy("time").collect()
    assert [round(r.survival, 6) for r in got] == [0.833333, 0.833333, 0.416667, 0.416667, 0.0]
    assert [r.n_risk for r in got] == [6, 5, 4, 2, 1] and [r.n_censored for r in got] == [0, 1, 0, 1, 0]
    assert round(got[0].std_err, 6) == 0.152145 and got[-1].std_err is None  # sqrt(5 / 216)


@pytest.mark.parametrize("seed", [1, 2])
def test_curves_are_those_of_brute_force_for_any_ranges(spark, seed):
    rows = made(seed, 400)
    df = table(spark, rows).repartition(6)
    want = brute_curve(rows)
    assert curve(df) == want and curve(df, n_ranges=100) == want


def brute_test(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    labels = sorted({r[0] for r in rows})
    o, e, v = np.zeros(len(labels)), np.zeros(len(labels)), np.zeros((len(labels), len(labels)))
    for time in sorted({r[1] for r in rows if r[2]}):
        risk = np.array([sum(r[0] == x and r[1] >= time for r in rows) for x in labels], float)
        d = np.array([sum(r[0] == x and r[1] == time and r[2] for r in rows) for x in labels], float)
        n, share = risk.sum(), risk / risk.sum()
        o += d
        e += d.sum() * share
        if n > 1:
            v += d.sum() * (n - d.sum()) / (n - 1) * (np.diag(share) - np.outer(share, share))
    return o, e, v


def test_logrank_is_that_of_brute_force_for_any_ranges(spark):
    rows = made(3, 300)
    o, e, v = brute_test(rows)
    value = (o - e)[:-1] @ np.linalg.inv(v[:-1, :-1]) @ (o - e)[:-1]
    for n in (None, 40):
        got = survival.logrank(table(spark, rows), n).orderBy("label").collect()
        assert [r.observed for r in got] == o.tolist() and [r.n for r in got] == [sum(r[0] == x for r in rows) for x in (0, 1, 2)]
        assert np.allclose([r.expected for r in got], e) and np.allclose([r.variance for r in got], v.diagonal())
        test = survival.logrank_test(table(spark, rows), n).first()
        assert test.statistic == pytest.approx(value) and test.degrees == 2 and test.p_value < 1e-3


def test_classes_alike_and_unlike(spark):
    rng = random.Random(8)
    alike = [(i % 2, rng.expovariate(1), True) for i in range(400)]
    assert survival.logrank_test(table(spark, alike)).first().p_value > 0.01
    assert survival.logrank_test(table(spark, [(c, t * (1 + c), e) for c, t, e in alike])).first().p_value < 1e-6


def test_tails_of_chi_square():
    for x, degrees, want in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (6.634897, 1, 0.01), (21.665994, 9, 0.01)):
        assert survival.chi_square_tail(x, degrees) == pytest.approx(want, abs=1e-7)
    assert survival.chi_square_tail(0, 3) == survival.chi_square_tail(5, 0) == 1 and survival.chi_square_tail(1e4, 3) == 0


def test_unusable_rows_empty_table_and_too_many_classes(spark, monkeypatch):
    rows = made(4, 50)
    odd = [(None, 1.0, True), (0, None, True), (0, 1.0, None), (1, float("nan"), True)]
    assert curve(table(spark, rows + odd)) == brute_curve(rows)
    none = table(spark, odd)
    assert curve(none) == survival.logrank(none).collect() == [] and survival.logrank_test(none).first().p_value == 1.0
    assert survival.logrank_test(table(spark, [(0, 1.0, True)])).first().degrees == 0
    assert curve(table(spark, [(0, 1.0, False)] * 3)) == [(0, 1.0, 3, 0, 3, 1.0, 0.0)]
    monkeypatch.setattr(survival, "MAX_CLASSES", 2)
    with pytest.raises(ValueError, match="more than 2 classes"):
        survival.kaplan_meier(table(spark, rows))


@pytest.mark.parametrize("n", [1, 37, None])
def test_running_sums(spark, n):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS at", "id AS v")
    got = {r["at"]: r.up_to for r in running(ranged(df, "at", n), "at", {"up_to": F.col("v")}).collect()}
    of, total = {i * 7 % 1000: i for i in range(1000)}, 0
    for at in range(1000):
        total += of[at]
        assert got[at] == total
