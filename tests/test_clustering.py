"""k-means on classes that lie apart, where random starts fail."""

from __future__ import annotations

import numpy as np

from sparkgrove.operators import clustering


def test_every_far_class_has_a_centre(spark):
    """16 classes, all equally far from each other: none shares a cluster, none is split."""
    rng = np.random.default_rng(3)
    rows = [(i, (3.0 * np.eye(16)[i % 16] + rng.normal(0, 0.125, 16)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "entity_id long, features array<double>").repartition(3).persist()
    for seed in (1, 2, 3):
        made = clustering.kmeans(df, 16, seed, restarts=1).collect()
        assert len(made) == 800 and len({(r.entity_id % 16, r.cluster) for r in made}) == len({r.cluster for r in made}) == 16


def test_centres_are_joined_where_that_costs_least():
    centres = np.array([[0.0], [1.0], [10.0], [10.5], [20.0]])
    assert clustering._joined(centres, np.array([1.0, 3.0, 2.0, 2.0, 5.0]), 3).tolist() == [[0.75], [10.25], [20.0]]
    assert clustering._joined(centres, np.ones(5), 5).tolist() == centres.tolist() == clustering._joined(centres, np.ones(5), 9).tolist()
    assert len(clustering._joined(np.zeros((4, 2)), np.ones(4), 1)) == 1
