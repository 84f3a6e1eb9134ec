"""How features are distributed over classes, and how they go together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tidy, width_of

#: Features of a correlation matrix at most: MLlib gathers it on the driver.
MAX_CORRELATED = 4096


def class_summary(long: DataFrame) -> DataFrame:
    """label, pos, n, mean_v, sd_v, min_v, max_v: one shuffle of partial aggregates."""
    return long.groupBy("label", "pos").agg(
        F.count("v").alias("n"), tidy(F.avg("v")).alias("mean_v"), tidy(F.stddev_samp("v")).alias("sd_v"),
        tidy(F.min("v")).alias("min_v"), tidy(F.max("v")).alias("max_v"),
    )


def feature_corr(feat: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of features, p1 < p2 → p1, p2, r (null where
    a feature does not vary)."""
    width = width_of(feat)
    if width > MAX_CORRELATED:
        raise ValueError(f"{width} features; a correlation matrix of more than {MAX_CORRELATED} does not fit the driver")
    if not width:
        return feat.sparkSession.createDataFrame([], "p1 int, p2 int, r double")
    matrix = Correlation.corr(feat.select(array_to_vector("features").alias("x")), "x").first()[0].toArray()
    # the matrix goes back by rows; Spark makes the pairs
    rows = pa.table({"p1": pa.array(range(width), pa.int32()), "row": pa.array(list(matrix), pa.list_(pa.float64()))})
    pairs = feat.sparkSession.createDataFrame(rows).select("p1", F.posexplode("row").alias("p2", "r")).where("p2 > p1")
    return pairs.withColumn("r", F.when(~F.isnan("r"), tidy(F.col("r"))))


def welch_t(long: DataFrame, a: int, b: int) -> DataFrame:
    """Welch's t of each feature, class ``a`` minus class ``b`` → pos, t (null without
    two rows of each class or without any variance)."""

    def of(label: int, what):
        return what(F.when(F.col("label") == label, F.col("v")))

    error = F.sqrt(of(a, F.var_samp) / of(a, F.count) + of(b, F.var_samp) / of(b, F.count))
    t = (of(a, F.avg) - of(b, F.avg)) / F.when(error > 0, error)
    return long.where(F.col("label").isin(a, b)).groupBy("pos").agg(tidy(t).alias("t"))


def anova_f(long: DataFrame) -> DataFrame:
    """One-way F of each feature over all classes → pos, f (null without variance
    within classes or with fewer than two classes)."""
    groups = long.groupBy("pos", "label").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s2"))
    grand = Window.partitionBy("pos")
    mean = F.sum(F.col("n") * F.col("m")).over(grand) / F.sum("n").over(grand)
    sums = groups.withColumn("g", mean).groupBy("pos").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"),
        F.sum((F.col("n") - 1) * F.col("s2")).alias("within"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
    )
    within = F.col("within") / F.when(F.col("n") > F.col("k"), F.col("n") - F.col("k"))
    f = F.col("between") / F.when(F.col("k") > 1, F.col("k") - 1) / F.when(within > 0, within)
    return sums.select("pos", tidy(f).alias("f"))


def rank_features(long: DataFrame, top: int | None = None) -> DataFrame:
    """Features by how well they separate the classes → rank, pos, f; ties by pos."""
    order = Window.orderBy(F.col("f").desc_nulls_last(), "pos")  # one row for each feature
    ranked = anova_f(long).withColumn("rank", F.row_number().over(order))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("rank", "pos", "f")
