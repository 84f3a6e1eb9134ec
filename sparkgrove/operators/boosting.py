"""Gradient-boosted trees for classes, from histograms of gradients.

Features are cut into bins at exact quantiles of the training rows, and only bin numbers are
kept, in the shared folder. Every round grows one tree a class, a level at a time: each task
scores its rows by the trees so far and adds their gradients and curvatures into a histogram
by class, node, feature and bin; the histograms of all tasks are added, running sums over the
bins of a feature give every possible split, and Spark takes the best of each node. Only the
splits, a row for each node, reach the driver; the trees go to the tasks with the next pass.

Gradients and curvatures are whole numbers of 2**-20, so sums do not depend on their order:
the same rows give the same trees, whatever their partitions. Leaves hold minus the sum of
gradients over the sum of curvatures plus ``l2``, times ``rate``.

Defined results: features are complete (as ``read_features`` checks). A value equal to a cut
lies below it. Of equally good splits the lower feature, then the lower cut is taken; a node
that no split betters keeps all its rows on one side. Ties between classes go to the lower
label. Without training rows fitting raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import to_long, width_of
from ..shared import kept
from .cells import quantiles

ROUNDS, DEPTH, BINS, RATE, L2, LEAST_ROWS = 10, 2, 32, 0.5, 1.0, 5
#: Whole numbers that gradients and curvatures are counted in.
UNIT = 1 << 20
#: Numbers of a task's histograms at most; nodes of all trees at most.
MAX_HISTOGRAM, MAX_NODES = 20_000_000, 2_000_000


class Trees(NamedTuple):
    """Labels in ascending order; cuts by feature; by round and class the feature and bin of
    each inner node (rows of a bin up to it go left), root first, then level by level, and the
    values of the leaves, from the left."""

    labels: np.ndarray
    cuts: np.ndarray
    features: np.ndarray
    bins: np.ndarray
    leaves: np.ndarray

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Numbers of cuts below each value."""
        return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)]).astype(np.int16)

    def scores(self, b: np.ndarray) -> np.ndarray:
        """By row and class, of rows of bins."""
        out, depth = np.zeros((len(b), len(self.labels))), int(np.log2(self.leaves.shape[-1]))
        for r in range(len(self.features)):
            for c in range(len(self.labels)):
                out[:, c] += self.leaves[r, c][descend(b, self.features[r, c], self.bins[r, c], depth)]
        return out


def descend(b: np.ndarray, features: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    """The place in its level, from the left, that each row of bins reaches."""
    at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for level in range(levels):
        node = (1 << level) - 1 + at
        at = 2 * at + (b[rows, features[node]] > bins[node])
    return at


def gradients(scores: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the cross entropy by row and class, in ``UNIT``s."""
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return np.rint((p - own) * UNIT), np.rint(p * (1 - p) * UNIT)


def _histograms(trees: Trees, grown: tuple[np.ndarray, np.ndarray], level: int, n_bins: int):
    """Task function: class, node (place in the level), pos, then by bin: rows, sums of
    gradients and of curvatures. ``grown``: the features and bins of the round's trees so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, width, nodes = len(trees.labels), len(trees.cuts), 1 << level
        sums = np.zeros((3, k, nodes * width * n_bins), np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            b = np.stack(pdf["bins"].to_numpy()).astype(np.int64)
            each = gradients(trees.scores(b), pdf["label"].to_numpy()[:, None] == trees.labels)
            for c in range(k):
                place = (descend(b, grown[0][c], grown[1][c], level)[:, None] * width + np.arange(width)) * n_bins + b
                sums[0, c] += np.bincount(place.ravel(), minlength=sums.shape[2])
                for i, values in enumerate(each, 1):  # whole numbers: doubles add them exactly
                    sums[i, c] += np.rint(np.bincount(place.ravel(), np.repeat(values[:, c], width), minlength=sums.shape[2])).astype(np.int64)
        c, node, pos = (x.ravel() for x in np.indices((k, nodes, width)))
        n, g, h = sums.reshape(3, -1, n_bins)
        some = n.any(axis=1)
        if some.any():
            yield pd.DataFrame({"class": c[some], "node": node[some], "pos": pos[some], "n": list(n[some]), "g": list(g[some]), "h": list(h[some])})

    return run


def _gain(g: Column, h: Column, l2: float) -> Column:
    g, h = g / UNIT, h / UNIT
    return g * g / (h + l2)


def best_splits(rows: DataFrame, trees: Trees, grown: tuple[np.ndarray, np.ndarray], level: int, l2: float = L2, least_rows: int = LEAST_ROWS) -> DataFrame:
    """class, node, pos, bin, gain and the sums on both sides (g_left, h_left, g_right,
    h_right, in ``UNIT``s): the best split of each node that has rows."""
    n_bins = trees.cuts.shape[1] + 1
    kind = "class int, node int, pos int, n array<long>, g array<long>, h array<long>"
    parts = rows.select("bins", "label").mapInPandas(_histograms(trees, grown, level, n_bins), kind)
    each = parts.select("class", "node", "pos", F.posexplode(F.arrays_zip("n", "g", "h")).alias("bin", "s"))
    each = each.groupBy("class", "node", "pos", "bin").agg(*[F.sum(f"s.{x}").alias(x) for x in ("n", "g", "h")])
    of = Window.partitionBy("class", "node", "pos")  # a row for each bin
    up_to, whole = of.orderBy("bin"), of
    each = each.select("class", "node", "pos", "bin", *[f(x).over(w).alias(x + side) for x in ("n", "g", "h") for f, w, side in ((F.sum, up_to, "_left"), (F.sum, whole, "_all"))])
    g_right, h_right = F.col("g_all") - F.col("g_left"), F.col("h_all") - F.col("h_left")
    gain = _gain(F.col("g_left"), F.col("h_left"), l2) + _gain(g_right, h_right, l2) - _gain(F.col("g_all"), F.col("h_all"), l2)
    last = F.col("bin") == n_bins - 1  # all rows on the left: no split
    fit = last | ((F.col("n_left") >= least_rows) & (F.col("n_all") - F.col("n_left") >= least_rows))
    found = each.where(fit).select("class", "node", F.struct(
        F.when(last, 0.0).otherwise(gain).alias("gain"), (-F.col("pos")).alias("up"), (-F.col("bin")).alias("low"),
        "g_left", "h_left", g_right.alias("g_right"), h_right.alias("h_right")).alias("s"))
    best = found.groupBy("class", "node").agg(F.max("s").alias("s"))
    return best.select("class", "node", (-F.col("s.up")).alias("pos"), (-F.col("s.low")).alias("bin"), *[F.col(f"s.{x}").alias(x) for x in ("gain", "g_left", "h_left", "g_right", "h_right")])


def start(train: DataFrame, bins: int = BINS) -> tuple[DataFrame, Trees]:
    """The training rows as bins in the shared folder, and no trees yet."""
    width = width_of(train)
    labels = sorted(r.label for r in train.select("label").distinct().limit(MAX_HISTOGRAM + 1).collect())
    if not labels or not width:
        raise ValueError("no rows to fit")
    if len(labels) * width * bins > MAX_HISTOGRAM:
        raise ValueError(f"histograms of more than {MAX_HISTOGRAM} numbers do not lie in a task")
    values = to_long(train).select(F.col("pos").alias("entity_id"), F.col("v").alias("value"))
    found = quantiles(values, [i / bins for i in range(1, bins)]).collect()
    cuts = np.round(np.array([r.quantiles for r in sorted(found, key=lambda r: r.entity_id)]), 9)
    none = np.zeros((0, len(labels), 1), np.int64)
    trees = Trees(np.array(labels), cuts, none, none, np.zeros((0, len(labels), 2)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"label": pdf["label"], "bins": list(trees.binned(np.stack(pdf["features"].to_numpy()).astype(float)))})

    return kept(train.select("label", "features").mapInPandas(run, "label int, bins array<smallint>"), "bins"), trees


def no_tree(trees: Trees, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and bins by class of trees that send all rows to the left."""
    shape = (len(trees.labels), (1 << depth) - 1)
    return np.zeros(shape, np.int64), np.full(shape, trees.cuts.shape[1], np.int64)


def fit(train: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2, least_rows: int = LEAST_ROWS) -> Trees:
    """``rounds`` trees of ``depth`` levels a class."""
    rows, trees = start(train, bins)
    k = len(trees.labels)
    if k * len(trees.cuts) * bins << (depth - 1) > MAX_HISTOGRAM or rounds * k << depth > MAX_NODES:
        raise ValueError(f"histograms of more than {MAX_HISTOGRAM} numbers, or trees of {MAX_NODES} nodes, do not lie in a task")
    empty = np.zeros((0, k, (1 << depth) - 1), np.int64)
    trees = trees._replace(features=empty, bins=empty, leaves=np.zeros((0, k, 1 << depth)))
    for _ in range(rounds):
        grown, leaves = no_tree(trees, depth), np.zeros((k, 1 << depth))
        for level in range(depth):
            for r in best_splits(rows, trees, grown, level, l2, least_rows).collect():  # a row for each node
                c, at = r["class"], (1 << level) - 1 + r.node
                grown[0][c, at], grown[1][c, at] = r.pos, r.bin
                if level == depth - 1:
                    for side, (g, h) in enumerate(((r.g_left, r.h_left), (r.g_right, r.h_right))):
                        leaves[c, 2 * r.node + side] = -rate * (g / UNIT) / (h / UNIT + l2) if h or l2 else 0.0
        trees = trees._replace(**{name: np.concatenate([old, new[None]]) for name, old, new in (
            ("features", trees.features, grown[0]), ("bins", trees.bins, grown[1]), ("leaves", trees.leaves, leaves))})
    return trees


def predict(test: DataFrame, trees: Trees) -> DataFrame:
    """entity_id, label, predicted, prob (by label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                scores = trees.scores(trees.binned(np.stack(pdf["features"].to_numpy()).astype(float)))
                p = np.exp(scores - scores.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pd.DataFrame({"entity_id": pdf["entity_id"], "label": pdf["label"], "predicted": trees.labels[scores.argmax(axis=1)], "prob": list(p)})

    return test.select("entity_id", "label", "features").mapInPandas(run, "entity_id long, label int, predicted int, prob array<double>")


def boosted(train: DataFrame, test: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> DataFrame:
    """Fitted on ``train``; ``predict`` of ``test``."""
    return predict(test, fit(train, rounds, depth))
