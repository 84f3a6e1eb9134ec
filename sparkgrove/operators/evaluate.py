"""How good predictions are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tidy
from ..shared import fresh_path
from .classify import CLOSED_FORMS, out_of_fold
from .folds import with_folds, with_grouped_folds


def confusion(predictions: DataFrame) -> DataFrame:
    """label, predicted, n."""
    return predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_scores(predictions: DataFrame) -> DataFrame:
    """label, precision, recall, f1; null where a score has no denominator."""
    each = predictions.select(F.explode(F.array_distinct(F.array("label", "predicted"))).alias("of"), "label", "predicted")

    def n(test) -> F:
        return F.sum(test.cast("long"))

    label, predicted, of = F.col("label"), F.col("predicted"), F.col("of")
    sums = each.groupBy("of").agg(n((label == of) & (predicted == of)).alias("tp"), n(label == of).alias("actual"), n(predicted == of).alias("claimed"))
    ratio = lambda a, b: tidy(a / F.when(b > 0, b))
    return sums.select(
        of.alias("label"), ratio(F.col("tp"), F.col("claimed")).alias("precision"), ratio(F.col("tp"), F.col("actual")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("actual") + F.col("claimed")).alias("f1"),
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(tidy(F.avg((F.col("label") == F.col("predicted")).cast("double"))).alias("accuracy"))


def evaluate(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The confusion counts, and the scores of each class."""
    return confusion(predictions), class_scores(predictions)


def cross_validate(feat: DataFrame, k: int, classifier: Callable[[DataFrame, DataFrame], DataFrame], prepare=None, groups: DataFrame | None = None) -> DataFrame:
    """fold, accuracy: each fold is predicted by a model fitted on the others.

    ``prepare(train, test)`` returns both, changed by what is learned from the training
    rows only (scaling, say). With ``groups`` (entity_id, group) no group is on both sides.
    Closed forms without ``prepare`` are fitted by one aggregate for all folds and scored in
    one pass; others are fitted fold by fold."""
    spark = feat.sparkSession
    path = fresh_path(spark, "folds")
    (with_folds(feat, k) if groups is None else with_grouped_folds(feat, groups, k)).write.parquet(path)  # read once for each fold
    folded = spark.read.parquet(path)
    if classifier in CLOSED_FORMS and not prepare:
        right = out_of_fold(folded, k, classifier).groupBy("fold").agg(tidy(F.avg((F.col("label") == F.col("predicted")).cast("double"))).alias("accuracy"))
        return spark.range(k).select(F.col("id").cast("int").alias("fold")).join(right, "fold", "left")
    scores = None
    for fold in range(k):
        train, test = (folded.where(F.col("fold") != fold).drop("fold"), folded.where(F.col("fold") == fold).drop("fold"))
        if prepare:
            train, test = prepare(train, test)
        one = accuracy(classifier(train, test)).select(F.lit(fold).alias("fold"), "accuracy")
        scores = one if scores is None else scores.unionByName(one)
    return scores


def summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation of the accuracy over folds."""
    return scores.agg(tidy(F.avg("accuracy")).alias("mean_accuracy"), tidy(F.stddev_samp("accuracy")).alias("sd_accuracy"))
