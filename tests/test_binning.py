"""Cuts in gaps, and the forest that needs them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrove.operators import binning, classify
from sparkgrove.plans import catalogue


def test_a_forest_tells_all_classes_that_a_gap_parts(spark, sf_dir):
    """Each class is apart in one element: no test row goes to another class."""
    made = classify.random_forest(*catalogue.split(catalogue.planted(catalogue.features(spark, sf_dir))))
    assert made.where(F.col("label") != F.col("predicted")).count() == 0 < made.count()


@pytest.mark.parametrize("parts", [1, 5])
def test_cuts_lie_in_gaps_and_odd_features_have_fewer(spark, parts):
    rng = np.random.default_rng(2)
    gap = np.where(np.arange(1000) % 9 == 0, 5.0, 0.0) + rng.normal(0, 0.1, 1000)
    far = np.where(np.arange(1000) == 0, 1e15, rng.uniform(0, 1, 1000))
    x = np.column_stack([gap, far, np.ones(1000), np.arange(1000) % 2])
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(x.tolist())], "entity_id long, label int, features array<double>").repartition(parts)
    cuts = binning.gap_cuts(df, 32)
    assert any(1 < c < 4 for c in cuts[0]) and all((np.diff(c) > 0).all() for c in cuts)
    sizes = [np.bincount(np.searchsorted(c, v), minlength=len(c) + 1) for c, v in zip(cuts, x.T)]
    assert 25 <= len(cuts[1]) <= 31 and sizes[0].max() < 100 and sizes[1].max() < 100
    assert len(cuts[2]) == 0 and cuts[3].tolist() == [0.5]
    codes = np.array([r.features for r in binning.binned(df, cuts).orderBy("entity_id").collect()])
    assert (codes == np.column_stack([(v[:, None] > c).sum(axis=1) for c, v in zip(cuts, x.T)])).all()
