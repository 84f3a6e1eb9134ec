"""Projection and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tidy

#: Centres, for each cluster wanted, that are joined to a start of k-means.
SPREAD = 4
#: Passes after which k-means from joined centres ends, and the move of a centre that ends it, as in MLlib.
PASSES, STILL = 20, 1e-4


def _vectors(feat: DataFrame) -> DataFrame:
    return feat.select("entity_id", array_to_vector("features").alias("x"))


def pca(feat: DataFrame, k: int) -> DataFrame:
    """entity_id, pc: the first ``k`` components; centred features are projected."""
    model = PCA(k=k, inputCol="x", outputCol="z").fit(_vectors(feat))
    return model.transform(_vectors(feat)).select("entity_id", vector_to_array("z").alias("pc"))


def explained_variance(feat: DataFrame, k: int) -> DataFrame:
    """component (from 1), share of the variance it explains."""
    shares = PCA(k=k, inputCol="x", outputCol="z").fit(_vectors(feat)).explainedVariance.toArray()
    return feat.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(shares)], "component int, share double")


def kmeans(feat: DataFrame, k: int, seed: int = 42, restarts: int = 4) -> DataFrame:
    """entity_id, cluster: of ``restarts`` runs from other seeds, and one from joined centres,
    the one of least cost.

    A random start may leave two classes that lie apart to one centre, and no pass mends that.
    So ``SPREAD`` times as many centres, which hardly miss a class, are fitted, too, and those
    whose union costs least are joined until ``k`` are left."""
    fits = [KMeans(k=k, seed=seed + i, featuresCol="x", predictionCol="cluster").fit(_vectors(feat)) for i in range(restarts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    fine = KMeans(k=SPREAD * k, seed=seed, featuresCol="x", predictionCol="cluster").fit(_vectors(feat))
    fine_centres = np.array(fine.clusterCenters())  # fewer, where rows are alike
    sizes = np.array(fine.summary.clusterSizes, float)[: len(fine_centres)]
    centres, cost = _settled(feat, _joined(fine_centres[sizes > 0], sizes[sizes > 0], k))
    if cost < model.summary.trainingCost * (1 - 1e-9):
        return _assigned(feat, centres)
    return model.transform(_vectors(feat)).select("entity_id", "cluster")


def _joined(centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centres: the two whose union adds least to the cost become one, again and
    again. Ties go to the first."""
    centres, sizes, left = centres.copy(), sizes.copy(), np.ones(len(sizes), bool)

    def costs(i: int) -> np.ndarray:
        added = ((centres - centres[i]) ** 2).sum(axis=1) * sizes * sizes[i] / (sizes + sizes[i])
        return np.where(left & (np.arange(len(left)) != i), added, np.inf)

    each = [costs(i) for i in range(len(left))] if len(left) > k else []
    to, least = np.array([int(c.argmin()) for c in each]), np.array([c.min() for c in each])
    for _ in range(len(left) - k):
        i = int(least.argmin())
        j = int(to[i])
        centres[i] += (centres[j] - centres[i]) * sizes[j] / (sizes[i] + sizes[j])
        sizes[i] += sizes[j]
        left[j], least[j] = False, np.inf
        new = costs(i)
        for r in np.flatnonzero(left & ((to == i) | (to == j) | (np.arange(len(left)) == i))):
            own = costs(r)
            to[r], least[r] = own.argmin(), own.min()
        nearer = new < least
        to[nearer], least[nearer] = i, new[nearer]
    return centres[left]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, ties to the first, and its squared distance."""
    at, least = np.zeros(len(x), int), np.full(len(x), np.inf)
    for j, c in enumerate(centres):
        d = ((x - c) ** 2).sum(axis=1)
        at, least = np.where(d < least, j, at), np.minimum(d, least)
    return at, least


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["features"].to_numpy()).astype(float)


def _settled(feat: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """Centres after passes of k-means, and their cost; one without rows stays where it is.
    A pass sums each task's rows by centre, then all tasks' sums."""
    cost = np.inf
    for _ in range(PASSES):

        def run(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            n, total, moved = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros_like(centres)
            for pdf in batches:
                if len(pdf):
                    x = _stacked(pdf)
                    at, d = _nearest(x, centres)
                    n += np.bincount(at, minlength=len(centres))
                    total += np.bincount(at, d, minlength=len(centres))
                    np.add.at(moved, at, x - centres[at])
            yield pd.DataFrame({"cluster": range(len(centres)), "n": n, "cost": total, "moved": list(moved)})

        parts = feat.select("features").mapInPandas(run, "cluster int, n double, cost double, moved array<double>")
        each = parts.select("cluster", "n", "cost", F.posexplode("moved").alias("pos", "v"))
        found = each.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("v").alias("v")).collect()
        step = np.zeros_like(centres)
        for r in found:
            step[r.cluster, r.pos] = r.v / max(r.n, 1.0)
        cost = sum(r.cost for r in found if r.pos == 0)
        if (step**2).sum(axis=1).max(initial=0.0) <= STILL**2:
            break
        centres = centres + step
    return centres, cost


def _assigned(feat: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"entity_id": pdf["entity_id"], "cluster": _nearest(_stacked(pdf), centres)[0]})

    return feat.select("entity_id", "features").mapInPandas(run, "entity_id long, cluster int")


def silhouette(feat: DataFrame, clusters: DataFrame) -> float:
    """Mean silhouette (squared Euclidean) of a clustering."""
    joined = _vectors(feat).join(clusters, "entity_id")
    return ClusteringEvaluator(featuresCol="x", predictionCol="cluster").evaluate(joined)


def cluster_by_class(clusters: DataFrame, feat: DataFrame) -> DataFrame:
    """cluster, label, n, share: counts of classes in each cluster and their share of it;
    a cluster's purity is its highest share."""
    counts = clusters.join(feat.select("entity_id", "label"), "entity_id").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    return counts.withColumn("share", tidy(share))
