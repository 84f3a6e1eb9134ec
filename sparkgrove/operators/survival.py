"""Survival by class: Kaplan-Meier curves and the log-rank test.

Rows are (label, time, event): when an entity was last seen, and whether its event happened
then (or it was censored). They are counted by time and class first; the sets at risk are
then what is left after the counts of all earlier times, by running sums over a range-sorted
time axis. Entities censored at a time are at risk at it. Rows with a null label, time or
event, or a time that is NaN, take no part; an empty table has no curve.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranged import ranged, running

#: Classes at most: the test has a sum for each two of them.
MAX_CLASSES = 50


def _usable(rows: DataFrame) -> DataFrame:
    time = F.col("time").cast("double")
    return rows.select(F.col("label").cast("int").alias("label"), time.alias("time"), F.col("event").cast("boolean").alias("event")).where(
        F.col("label").isNotNull() & time.isNotNull() & ~F.isnan(time) & F.col("event").isNotNull()
    )


def _by_time(rows: DataFrame, n: int | None) -> tuple[DataFrame, dict[int, int]]:
    """A row for each time: of the i-th class c{i} seen last, d{i} of them with an event, r{i}
    at risk; and the classes with their entities, in order."""
    rows = _usable(rows)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    sizes = dict(sorted(sizes.items()))
    if not sizes:
        return rows, sizes
    counts = []
    for i, label in enumerate(sizes):
        own = F.col("label") == label
        counts += [F.sum(own.cast("long")).alias(f"c{i}"), F.sum((own & F.col("event")).cast("long")).alias(f"d{i}")]
    times = ranged(rows.groupBy("time").agg(*counts), "time", n)
    run = running(times, "time", {f"u{i}": F.col(f"c{i}") for i in range(len(sizes))})
    return run.select(*times.columns, *[(n - F.col(f"u{i}") + F.col(f"c{i}")).alias(f"r{i}") for i, n in enumerate(sizes.values())]), sizes


def kaplan_meier(rows: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """label, time, n_risk, n_event, n_censored, survival, std_err (Greenwood), for every time
    at which the class has an entity seen last. The error is null once nobody survives."""
    times, sizes = _by_time(rows, n_ranges)
    if not sizes:
        return rows.sparkSession.createDataFrame([], "label int, time double, n_risk long, n_event long, n_censored long, survival double, std_err double")
    sums: dict[str, Column] = {}
    for i in range(len(sizes)):
        d, r = F.col(f"d{i}"), F.col(f"r{i}")
        sums[f"l{i}"] = F.when(d == 0, 0.0).when(d == r, float("-inf")).otherwise(F.log1p(-d / r))
        sums[f"g{i}"] = F.when(d < r, d / (r.cast("double") * (r - d))).otherwise(0.0)
    curve = running(times, "time", sums)
    each = [
        F.struct(
            F.lit(label).alias("label"), F.col(f"r{i}").alias("n_risk"), F.col(f"d{i}").alias("n_event"), (F.col(f"c{i}") - F.col(f"d{i}")).alias("n_censored"),
            F.exp(f"l{i}").alias("survival"), F.when(F.exp(f"l{i}") > 0, F.exp(f"l{i}") * F.sqrt(f"g{i}")).alias("std_err"),
        ) for i, label in enumerate(sizes)
    ]
    of = curve.select("time", F.explode(F.array(*each)).alias("x")).where("x.n_event + x.n_censored > 0")
    return of.select("x.label", "time", *[f"x.{c}" for c in ("n_risk", "n_event", "n_censored", "survival", "std_err")])


def _sums(rows: DataFrame, n_ranges: int | None) -> tuple[dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """Classes; events observed and expected by class, and the covariance of their difference."""
    times, sizes = _by_time(rows, n_ranges)
    k = len(sizes)
    if not k:
        return sizes, np.zeros(0), np.zeros(0), np.zeros((0, 0))
    plus = lambda prefix: sum((F.col(f"{prefix}{i}") for i in range(1, k)), F.col(f"{prefix}0"))
    # only times with an event add to any sum
    at = times.select("*", plus("d").cast("double").alias("d"), plus("r").cast("double").alias("r")).where("d > 0")
    spread = F.when(F.col("r") > 1, F.col("d") * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    share = [F.col(f"r{i}") / F.col("r") for i in range(k)]
    found = [F.sum(f"d{i}") for i in range(k)] + [F.sum(F.col("d") * x) for x in share]
    found += [F.sum(spread * share[i] * ((1.0 if i == j else 0.0) - share[j])) for i in range(k) for j in range(i, k)]
    values = [float(v or 0) for v in at.agg(*[x.alias(f"s{i}") for i, x in enumerate(found)]).first()]
    covariance = np.zeros((k, k))
    covariance[np.triu_indices(k)] = values[2 * k :]
    return sizes, np.array(values[:k]), np.array(values[k : 2 * k]), covariance + np.triu(covariance, 1).T


def logrank(rows: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """label, n, observed, expected, variance (of their difference), if all classes had the
    same survival."""
    sizes, observed, expected, covariance = _sums(rows, n_ranges)
    out = [(label, n, int(o), float(e), float(v)) for (label, n), o, e, v in zip(sizes.items(), observed, expected, covariance.diagonal())]
    return rows.sparkSession.createDataFrame(out, "label int, n long, observed long, expected double, variance double")


def logrank_test(rows: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """statistic (chi square), degrees, p_value: of all classes having the same survival."""
    _, observed, expected, covariance = _sums(rows, n_ranges)
    off, degrees = (observed - expected)[:-1], max(0, len(observed) - 1)
    value = float(off @ np.linalg.pinv(covariance[:-1, :-1]) @ off) if degrees else 0.0
    return rows.sparkSession.createDataFrame([(value, degrees, chi_square_tail(value, degrees))], "statistic double, degrees int, p_value double")


def chi_square_tail(x: float, degrees: int) -> float:
    """Probability that a chi square variable exceeds ``x``: from that of one or two degrees,
    two more degrees at a time."""
    if degrees < 1 or x <= 0:
        return 1.0
    half = x / 2
    tail, a = (math.exp(-half), 1.0) if degrees % 2 == 0 else (math.erfc(math.sqrt(half)), 0.5)
    while a < degrees / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(1.0, tail)
