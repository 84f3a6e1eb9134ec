"""Missing features, filled from training rows only.

A feature table may have null elements here; NaN counts as null. Known elements stay as they
are. Nothing is learned from the rows to be filled, unless they are the training rows, and
never from labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import to_long
from .neighbours import nearest, over_shared

#: Features whose means go to every task at most.
MAX_WIDTH = 1_000_000


def _known(feat: DataFrame) -> DataFrame:
    return feat.withColumn("features", F.transform("features", lambda x: F.when(~F.isnan(x), x)))


def _missing() -> Column:
    return F.exists("features", lambda x: x.isNull())


def feature_means(train: DataFrame) -> list[float | None]:
    """Mean of the known elements by position, None where there are none."""
    found = to_long(_known(train)).groupBy("pos").agg(F.avg("v").alias("m")).limit(MAX_WIDTH + 1).collect()
    if len(found) > MAX_WIDTH:
        raise ValueError(f"means of more than {MAX_WIDTH} features are not sent to every task")
    means = {r.pos: r.m for r in found}
    return [means.get(i) for i in range(max(means, default=-1) + 1)]


def _filled(x: Column, i: Column, means: Column) -> Column:
    return F.coalesce(x, F.get(means, i))


def mean_fill(feat: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """``feat`` with the training rows' mean (by default its own) in place of each missing
    element; a feature that no training row has stays null."""
    means = feat.sparkSession.createDataFrame([(feature_means(feat if train is None else train),)], "means array<double>")
    met = _known(feat).select("*", means.scalar().alias("__means"))
    return met.withColumn("features", F.transform("features", lambda x, i: _filled(x, i, F.col("__means")))).drop("__means")


def neighbour_fill(feat: DataFrame, train: DataFrame | None = None, k: int = 5) -> DataFrame:
    """``feat`` with, in place of each missing element, the mean of those that the k nearest
    training rows have; where none of them has it, the mean of all training rows.

    Nearness is the mean squared difference over the elements that both rows have, so rows
    that share none are never neighbours; nor is a row its own. Ties go to the lower id.
    Complete rows are not moved."""
    own = feat if train is None else train
    feat, own = _known(feat), _known(own)
    complete, lacking = feat.where(~_missing()), feat.where(_missing())
    near = nearest(lacking, own, k, over_shared, others=True).select("entity_id", "i", "train_id")
    met = near.join(own.select(F.col("entity_id").alias("train_id"), F.col("features").alias("x")), "train_id")
    lists = met.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("__near"))  # k rows

    def of_neighbours(i: Column) -> Column:
        have = F.filter(F.transform("__near", lambda r: F.get(r["x"], i)), lambda v: v.isNotNull())
        return F.aggregate(have, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(have), F.lit(0))

    filled = lacking.join(lists, "entity_id", "left").withColumn("features", F.transform("features", lambda x, i: F.coalesce(x, of_neighbours(i))))
    return complete.unionByName(mean_fill(filled.select(feat.columns), own))


def fill_error(filled: DataFrame, hidden: DataFrame, true: DataFrame) -> DataFrame:
    """n and rmse of the filled elements against the true ones, where ``hidden`` lacks them.
    All three are wide."""
    lacking = to_long(_known(hidden)).where(F.col("v").isNull()).select("entity_id", "pos")
    pairs = lacking.join(to_long(filled).select("entity_id", "pos", F.col("v").alias("made")), ["entity_id", "pos"])
    pairs = pairs.join(to_long(true).select("entity_id", "pos", "v"), ["entity_id", "pos"])
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((F.col("made") - F.col("v")) ** 2)).alias("rmse"))
