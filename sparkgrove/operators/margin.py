"""Linear support vector machines, one class against the rest, over standardised rows.

All classes are fitted together: an iteration is one pass, in which every task adds up, for
each class, the rows on the wrong side of its margin (the subgradient of the hinge loss) and
the loss itself; the sums of all tasks are added position by position, and the new planes go
to the tasks again. The rows are read from a table in the shared folder, so no iteration
depends on the one before by more than its planes, which are small.

The objective of a class is ``reg / 2`` times the squared length of its plane, without the
intercept, plus the mean hinge loss. Steps are 1 / (reg * t), as for strongly convex losses,
shortened to the ball that holds the best plane; of all planes met, and of the mean of the
later half, each class keeps the one of least objective.

Defined results: features are complete (as ``read_features`` checks); a feature that does not
vary counts 0. Ties between classes go to the lower label. A single class is predicted for
all rows. Without training rows fitting raises.
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

REG, ITERATIONS = 0.01, 30
#: Numbers of all planes at most; classes at most.
MAX_MODEL, MAX_CLASSES = 5_000_000, 10_000


class Planes(NamedTuple):
    """Labels in ascending order; by class an intercept and a weight for each standardised
    feature; the features' means and sample deviations; objectives by iteration and class."""

    labels: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    history: list[np.ndarray]

    def rows(self, pdf: pd.DataFrame) -> np.ndarray:
        """A one, and the standardised features."""
        x = np.stack(pdf["features"].to_numpy()).astype(float)
        return np.column_stack([np.ones(len(x)), np.where(self.scales > 0, (x - self.means) / np.where(self.scales > 0, self.scales, 1.0), 0.0)])


def _sums(planes: Planes):
    """Task function: class, sum of hinge losses, sum of the rows within the margin times their side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, total = np.zeros(len(planes.labels)), np.zeros_like(planes.weights)
        for pdf in batches:
            if len(pdf):
                z = planes.rows(pdf)
                side = np.where(pdf["label"].to_numpy()[:, None] == planes.labels, 1.0, -1.0)
                short = 1 - side * (z @ planes.weights.T)
                loss += np.maximum(short, 0).sum(axis=0)
                total += (side * (short > 0)).T @ z
        yield pd.DataFrame({"class": range(len(loss)), "loss": loss, "s": list(total)})

    return run


def subgradient(rows: DataFrame, planes: Planes, n: int, reg: float) -> tuple[np.ndarray, np.ndarray]:
    """Objective by class, and its subgradient by class and position (intercept first), over
    ``n`` rows (features, label)."""
    parts = rows.select("features", "label").mapInPandas(_sums(planes), "class int, loss double, s array<double>")
    each = parts.select("class", "loss", F.posexplode("s").alias("pos", "v")).groupBy("class", "pos").agg(F.sum("loss").alias("loss"), F.sum("v").alias("v"))
    loss, total = np.zeros(len(planes.labels)), np.zeros_like(planes.weights)
    for r in each.collect():  # MAX_MODEL numbers at most
        loss[r["class"]], total[r["class"], r.pos] = r.loss, r.v
    inner = planes.weights.copy()
    inner[:, 0] = 0
    return reg / 2 * (inner**2).sum(axis=1) + loss / n, reg * inner - total / n


def start(train: DataFrame) -> tuple[DataFrame, Planes, int]:
    """The training rows in the shared folder, planes of zeros over them, and their number."""
    labels = [r.label for r in train.select("label").distinct().limit(MAX_CLASSES + 1).collect()]
    if not labels:
        raise ValueError("no rows to fit")
    if len(labels) > MAX_CLASSES or len(labels) * (1 + width_of(train)) > MAX_MODEL:
        raise ValueError(f"planes of more than {MAX_MODEL} numbers, or of {MAX_CLASSES} classes, are not sent to every task")
    rows = kept(train.select("entity_id", "features", "label"), "margin-rows")
    found = to_long(rows).groupBy("pos").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd")).orderBy("pos").collect()
    means, scales = np.array([r.m for r in found]), np.array([r.sd for r in found])
    scales = np.where(scales > 1e-12 * np.abs(means), scales, 0.0)  # all but rounding
    return rows, Planes(np.array(sorted(labels)), np.zeros((len(labels), 1 + len(means))), means, scales, []), found[0].n if found else rows.count()


def fit(train: DataFrame, reg: float = REG, iterations: int = ITERATIONS) -> Planes:
    """Planes of least objective among those met in so many steps."""
    rows, planes, n = start(train)
    best, least, history, late = planes.weights, np.full(len(planes.labels), np.inf), [], []
    w = planes.weights
    for t in range(1, iterations + 2):
        value, slope = subgradient(rows, planes._replace(weights=w), n, reg)
        history.append(value)
        best, least = np.where((value < least)[:, None], w, best), np.minimum(value, least)
        if t > iterations:
            break
        if t == iterations:  # the last look is at the mean of the later half
            w = np.mean(late or [w], axis=0)
            continue
        w = w - slope / (reg * t)
        # the best plane's length is at most sqrt(2 / reg), as its objective is at most that of zeros
        w = w * np.minimum(1, np.sqrt(2 / reg) / np.maximum(np.linalg.norm(w[:, 1:], axis=1, keepdims=True), 1e-300))
        if 2 * t >= iterations:
            late.append(w)
    return planes._replace(weights=best, history=history)


def predict(test: DataFrame, planes: Planes) -> DataFrame:
    """entity_id, label, predicted (the class of greatest margin), margins (by label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                margins = planes.rows(pdf) @ planes.weights.T
                yield pd.DataFrame({"entity_id": pdf["entity_id"], "label": pdf["label"], "predicted": planes.labels[margins.argmax(axis=1)], "margins": list(margins)})

    return test.select("entity_id", "label", "features").mapInPandas(run, "entity_id long, label int, predicted int, margins array<double>")


def linear_svm(train: DataFrame, test: DataFrame, reg: float = REG, iterations: int = ITERATIONS) -> DataFrame:
    """Fitted on ``train``; ``predict`` of ``test``."""
    return predict(test, fit(train, reg, iterations))
