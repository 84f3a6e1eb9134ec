"""Gaussian mixtures with diagonal covariances, by expectation-maximisation.

An iteration is one pass: every task weighs its rows by the components' responsibilities and
sums weights, values and squares; the sums of all tasks are added, a row for each component
and feature, and give the next model, which is small and goes to the tasks again. The rows
are read from a table in the shared folder, so no iteration depends on the one before by
more than its model.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import to_long, width_of
from ..shared import kept
from .clustering import kmeans

#: Numbers of a model at most; least variance of a feature in a component.
MAX_MODEL, VARIANCE_FLOOR = 5_000_000, 1e-6


class Mixture(NamedTuple):
    """Weights by component; means and variances by component and feature; the logarithm of
    the likelihood of the rows before each iteration and after the last one."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    history: list[float]

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """By row and component: the logarithm of weight times density."""
        out = np.empty((len(x), len(self.weights)))
        with np.errstate(divide="ignore"):
            log_weight = np.log(self.weights)
        for j, (m, v) in enumerate(zip(self.means, self.variances)):
            out[:, j] = log_weight[j] - 0.5 * (((x - m) ** 2 / v).sum(axis=1) + np.log(2 * np.pi * v).sum())
        return out


def _total(joint: np.ndarray) -> np.ndarray:
    most = joint.max(axis=1)
    return most + np.log(np.exp(joint - most[:, None]).sum(axis=1))


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["features"].to_numpy()).astype(float)


def _sums(model: Mixture):
    """Task function: component, n, log likelihood (in the first), sums of values less the
    component's mean and of their squares, by feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s1, s2, ll = np.zeros(len(model.weights)), np.zeros_like(model.means), np.zeros_like(model.means), 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = _stacked(pdf)
            joint = model.log_joint(x)
            total = _total(joint)
            share = np.exp(joint - total[:, None])
            ll += total.sum()
            n += share.sum(axis=0)
            for j, m in enumerate(model.means):
                s1[j] += share[:, j] @ (x - m)
                s2[j] += share[:, j] @ (x - m) ** 2
        lls = [ll] + [0.0] * (len(n) - 1)
        yield pd.DataFrame({"component": range(len(n)), "n": n, "ll": lls, "s1": list(s1), "s2": list(s2)})

    return run


def _step(rows: DataFrame, model: Mixture) -> tuple[Mixture, float]:
    parts = rows.select("features").mapInPandas(_sums(model), "component int, n double, ll double, s1 array<double>, s2 array<double>")
    each = parts.select("component", "n", "ll", F.posexplode(F.arrays_zip("s1", "s2")).alias("pos", "s"))
    found = each.groupBy("component", "pos").agg(F.sum("n").alias("n"), F.sum("ll").alias("ll"), F.sum("s.s1").alias("s1"), F.sum("s.s2").alias("s2")).collect()
    n, s1, s2, ll = np.zeros(len(model.weights)), np.zeros_like(model.means), np.zeros_like(model.means), 0.0
    for r in found:
        n[r.component], s1[r.component, r.pos], s2[r.component, r.pos] = r.n, r.s1, r.s2
        ll += r.ll if r.pos == 0 else 0.0
    held = np.maximum(n, 1e-300)[:, None]
    moved = np.where(n[:, None] > 0, s1 / held, 0.0)
    variances = np.where(n[:, None] > 0, np.maximum(s2 / held - moved**2, VARIANCE_FLOOR), model.variances)
    return Mixture(n / n.sum(), model.means + moved, variances, [*model.history, ll]), ll


def gaussian_mixture(feat: DataFrame, k: int, seed: int = 42, iterations: int = 50, enough: float = 1e-6) -> Mixture:
    """A mixture of ``k`` components, from the clusters of k-means on, until an iteration adds
    less than ``enough`` of the likelihood's logarithm for each row. Ties between components
    go to the lower one; a component that loses all its rows keeps its place, without weight."""
    if k * max(1, width_of(feat)) > MAX_MODEL:
        raise ValueError(f"a model of more than {MAX_MODEL} numbers is not sent to every task")
    rows = kept(feat.select("entity_id", "features"), "mixture-rows")
    clusters = kmeans(rows, k, seed).select("entity_id", "cluster")
    start = to_long(rows).join(clusters, "entity_id").groupBy("cluster", "pos").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2")).collect()
    if not start:
        raise ValueError("no rows to fit")
    names = {c: i for i, c in enumerate(sorted({r.cluster for r in start}))}
    shape = (len(names), 1 + max(r.pos for r in start))
    weights, means, variances = np.zeros(shape[0]), np.zeros(shape), np.zeros(shape)
    for r in start:
        i = names[r.cluster]
        weights[i], means[i, r.pos], variances[i, r.pos] = r.n, r.m, max(r.s2, VARIANCE_FLOOR)
    n_rows = weights.sum()
    model = Mixture(weights / n_rows, means, variances, [])
    for _ in range(iterations):
        new, _ll = _step(rows, model)
        if len(new.history) > 1 and new.history[-1] - new.history[-2] < enough * n_rows:
            return model._replace(history=new.history)
        model = new
    return model._replace(history=[*model.history, _step(rows, model)[1]])


def responsibilities(feat: DataFrame, model: Mixture) -> DataFrame:
    """entity_id, cluster (the likeliest component), prob (of each component), log_density."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                joint = model.log_joint(_stacked(pdf))
                total = _total(joint)
                yield pd.DataFrame({"entity_id": pdf["entity_id"], "cluster": joint.argmax(axis=1), "prob": list(np.exp(joint - total[:, None])), "log_density": total})

    return feat.select("entity_id", "features").mapInPandas(run, "entity_id long, cluster int, prob array<double>, log_density double")


def components(spark, model: Mixture) -> DataFrame:
    """component, weight, pos, mean, variance."""
    rows = [
        (i, float(w), p, float(m), float(v)) for i, w in enumerate(model.weights) for p, (m, v) in enumerate(zip(model.means[i], model.variances[i]))
    ]
    return spark.createDataFrame(rows, "component int, weight double, pos int, mean double, variance double")
