"""Centring and scaling."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(feat: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Features minus the mean, over the sample deviation, of ``fit_on`` (training
    rows; by default all). A feature that does not vary becomes 0."""
    vector = array_to_vector("features").alias("x")
    model = StandardScaler(withMean=True, withStd=True, inputCol="x", outputCol="z").fit((fit_on or feat).select(vector))
    keys = [c for c in feat.columns if c != "features"]
    scaled = model.transform(feat.select(*keys, vector))
    rest = [k for k in keys if k != "entity_id"]
    return scaled.select("entity_id", vector_to_array("z").alias("features"), *rest)


def rounded(feat: DataFrame, places: int = 6) -> DataFrame:
    return feat.withColumn("features", F.transform("features", lambda x: F.round(x, places) + F.lit(0.0)))
