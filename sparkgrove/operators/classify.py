"""Classifiers: ``(train, test)`` wide features → entity_id, label, predicted, …

The closed forms fit by one aggregate over the training rows and score the test rows
where they are: their model, classes times features, is a scalar subquery, so test rows
are neither exploded nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import to_long, width_of
from .approximate import approximate
from .binning import binned, gap_cuts
from .neighbours import cosine, nearest

Loss = Callable[[Column, Column], Column]
#: Least variance of a feature in a class.
VARIANCE_FLOOR = 1e-9
#: Test rows that tasks of nearest neighbours read at a time.
TEST_BLOCK = 20_000
#: Numbers of one product of test and training rows at most, in doubles 32 MB.
PRODUCT = 4_000_000
#: Numbers of a closed-form model at most; it goes to every task.
MAX_MODEL = 5_000_000
#: Bins of a feature in a forest, as MLlib has by default.
BINS = 32


def _classes(train: DataFrame) -> DataFrame:
    """label, n, m, s2: count, means and population variances by position."""
    per = to_long(train).groupBy("label", "pos").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m", "s2")))
    return per.groupBy("label").agg(F.max("n").alias("n"), ordered.alias("at")).select(
        "label", "n", F.transform("at", lambda x: x["m"]).alias("m"), F.transform("at", lambda x: F.greatest(x["s2"], F.lit(VARIANCE_FLOOR))).alias("s2")
    )


def _bounded(classes: DataFrame, train: DataFrame, n_models: int = 1) -> list:
    """The rows of a model, if they are few enough to go to every task."""
    most = MAX_MODEL // max(1, n_models * width_of(train))
    found = classes.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a model of more than {MAX_MODEL} numbers is not sent to every task")
    return found


def _of_least(x: Column, model: Column, loss: Loss) -> Column:
    """The class of ``model`` with the least loss, ties to the lower label."""
    return F.array_min(F.transform(model, lambda c: F.struct(loss(x, c).alias("loss"), c["label"].alias("label"))))["label"]


def _least(train: DataFrame, test: DataFrame, loss: Loss) -> DataFrame:
    """The class of least loss, ties to the lower label. The model is fitted at once, by one
    aggregate, and goes to the test rows as a scalar."""
    classes = _classes(train)
    schema = StructType([StructField("model", ArrayType(classes.schema))])
    model = train.sparkSession.createDataFrame([(_bounded(classes, train),)], schema)
    scored = test.select("entity_id", "label", "features", model.scalar().alias("model"))
    return scored.select("entity_id", "label", _of_least(F.col("features"), F.col("model"), loss).alias("predicted"))


def _distance(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def _minus_log(x: Column, c: Column) -> Column:
    # the number of training rows is the same for all classes and may be left out
    parts = F.zip_with(F.zip_with(x, c["m"], lambda a, b: (a - b) * (a - b)), c["s2"], lambda d, s: F.log(s) + d / s)
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p) / 2 - F.log(c["n"])


def nearest_centroid(train: DataFrame, test: DataFrame) -> DataFrame:
    """The class whose mean is closest (Euclidean)."""
    return _least(train, test, _distance)


def gaussian_nb(train: DataFrame, test: DataFrame) -> DataFrame:
    """Gaussian naive Bayes: the class of highest posterior."""
    return _least(train, test, _minus_log)


#: Classifiers whose models for all folds come from one aggregate.
CLOSED_FORMS: dict[Callable, Loss] = {nearest_centroid: _distance, gaussian_nb: _minus_log}


def _without(parts: list) -> list[tuple]:
    """(label, n, m, s2) of all rows of the given parts of a training table, by class: the
    parts' counts, means and squared deviations put together."""
    out = []
    for label in sorted({r.label for r in parts}):
        own = [r for r in parts if r.label == label]
        n, m = np.array([r.n for r in own], float), np.array([r.m for r in own])
        mean = n @ m / n.sum()
        s2 = n @ (np.array([r.s2 for r in own]) + (m - mean) ** 2) / n.sum()
        out.append((label, int(n.sum()), mean.tolist(), np.maximum(s2, VARIANCE_FLOOR).tolist()))
    return out


def out_of_fold(folded: DataFrame, k: int, classifier: Callable) -> DataFrame:
    """entity_id, label, fold, predicted: rows of each fold by the model of the others, for a
    closed form. One aggregate by fold, class and position holds all k models, and one pass
    scores all rows."""
    per = to_long(folded, "fold").groupBy("fold", "label", "pos").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m", "s2")))
    parts = per.groupBy("fold", "label").agg(F.max("n").alias("n"), ordered.alias("at")).select(
        "fold", "label", "n", F.transform("at", lambda x: x["m"]).alias("m"), F.transform("at", lambda x: x["s2"]).alias("s2")
    )
    found = _bounded(parts, folded)
    kind = "array<array<struct<label: int, n: long, m: array<double>, s2: array<double>>>>"
    models = folded.sparkSession.createDataFrame([([_without([r for r in found if r.fold != fold]) for fold in range(k)],)], f"models {kind}")
    scored = folded.select("entity_id", "label", "fold", "features", models.scalar().alias("models"))
    return scored.select("entity_id", "label", "fold", _of_least(F.col("features"), F.get("models", F.col("fold")), CLOSED_FORMS[classifier]).alias("predicted"))


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Majority class of the k nearest training rows by cosine (rounded to 9 places).
    Ties in distance go to the lower id, in votes to the lower label."""
    return _voted(nearest(test, train.withColumn("vote", F.col("label")), k, cosine, ["vote"], tile_rows=TEST_BLOCK, product=PRODUCT), test)


def knn_approximate(train: DataFrame, test: DataFrame, k: int = 5, **tables: int) -> DataFrame:
    """``knn_classify`` by the neighbours that ``approximate`` finds."""
    near = approximate(test, train, k, **tables)
    return _voted(near.join(train.select(F.col("entity_id").alias("train_id"), F.col("label").alias("vote")), "train_id"), test)


def _voted(near: DataFrame, test: DataFrame) -> DataFrame:
    """The majority class of each test row's neighbours, ties to the lower label."""
    votes = near.groupBy("entity_id", "vote").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("entity_id").agg(F.min(F.struct((-F.col("n")).alias("down"), "vote"))["vote"].alias("predicted"))
    return test.select("entity_id", "label").join(chosen, "entity_id")


def _fitted(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    def vectors(feat: DataFrame) -> DataFrame:
        return feat.select("entity_id", F.col("label").cast("double").alias("y"), array_to_vector("features").alias("x"))

    made = estimator.fit(vectors(train)).transform(vectors(test))
    return made.select("entity_id", F.col("y").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("prob"))


def logistic(train: DataFrame, test: DataFrame, reg: float = 0.0, max_iter: int = 50) -> DataFrame:
    """Multinomial logistic regression; adds prob, by label."""
    return _fitted(LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=reg, maxIter=max_iter), train, test)


def random_forest(train: DataFrame, test: DataFrame, trees: int = 50, seed: int = 42, depth: int = 5) -> DataFrame:
    """Random forest; adds prob, by label. Features are cut where values leave gaps, not at
    MLlib's quantiles, which mix the classes that such a gap parts."""
    cuts = gap_cuts(train, BINS)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, seed=seed, maxDepth=depth, maxBins=BINS)
    return _fitted(forest, binned(train, cuts), binned(test, cuts))


def forest_importance(train: DataFrame, trees: int = 50, seed: int = 42) -> DataFrame:
    """pos, importance of each feature in a random forest."""
    vectors = binned(train, gap_cuts(train, BINS)).select(F.col("label").cast("double").alias("y"), array_to_vector("features").alias("x"))
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, seed=seed, maxBins=BINS).fit(vectors)
    rows = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    return train.sparkSession.createDataFrame(rows, "pos int, importance double")
