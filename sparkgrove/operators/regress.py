"""Ridge regression with a closed form: one pass of sums of products.

Rows are wide features, from which one is the target and the others explain it. Every task
sums the products of its rows, a block of rows at a time, into one matrix (the features, a
one, and their products); the matrices are added, and the model is the solution of a small
system. Products are taken of features less those of one row, which changes no result but
keeps large numbers from eating small differences. With folds, the matrix of each fold is
kept apart: the sums of all other folds are the total less its own, so k models come from
one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import width_of

#: Numbers of one matrix at most, and of all folds' that reach the driver.
MAX_GRAM, MAX_TOTAL = 4_000_000, 40_000_000


def _sums(shift: np.ndarray, fold: str | None):
    """Task function: for each fold a matrix, as rows of (fold, i, products with all others)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(pdf[fold] if fold else np.zeros(len(pdf), np.int64)):
                x = np.column_stack([np.ones(len(part)), np.stack(part["features"].to_numpy()).astype(float) - shift])
                held[int(key)] = held.get(int(key), 0) + x.T @ x
        for key, m in held.items():
            yield pd.DataFrame({"fold": key, "i": np.arange(len(m)), "products": list(m)})

    return run


def gram(feat: DataFrame, fold: str | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The features of one row, and by fold (0 without) the sums of products of a one and all
    features less those; added among the tasks, and fetched as one row for each feature and
    fold."""
    width = width_of(feat)
    if (width + 1) ** 2 > MAX_GRAM:
        raise ValueError(f"a matrix of more than {MAX_GRAM} numbers is not sent to the driver")
    row = feat.select("features").first()
    shift = np.array(row[0] if row else [], float)
    parts = feat.select("features", *([fold] if fold else [])).mapInPandas(_sums(shift, fold), "fold long, i int, products array<double>")
    # element by element, so that equal rows of all tasks meet in partial sums
    each = parts.select("fold", "i", F.posexplode("products").alias("j", "p")).groupBy("fold", "i", "j").agg(F.sum("p").alias("p"))
    rows = each.groupBy("fold", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "p"))), lambda x: x["p"]).alias("products"))
    found = rows.limit(MAX_TOTAL // (width + 1) + 1).collect()
    if len(found) * (width + 1) > MAX_TOTAL:
        raise ValueError(f"matrices of more than {MAX_TOTAL} numbers are not sent to the driver")
    out: dict[int, np.ndarray] = {}
    for r in found:
        out.setdefault(r.fold, np.zeros((width + 1, width + 1)))[r.i] = r.products
    return shift, out


def solved(shift: np.ndarray, sums: np.ndarray, target: int, reg: float) -> np.ndarray:
    """Intercept, then a coefficient for each feature, 0 for the target's own: least squares
    plus ``reg`` times the number of rows times the squared coefficients, without the intercept."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    centred = sums[1:, 1:] - n * np.outer(mean, mean)
    others = np.array([i for i in range(len(mean)) if i != target])
    out = np.zeros(len(mean) + 1)
    if len(others) and n:
        a = centred[np.ix_(others, others)] + reg * n * np.eye(len(others))
        out[others + 1] = np.linalg.lstsq(a, centred[others, target], rcond=None)[0]
    out[0] = mean[target] + shift[target] - out[1:] @ (mean + shift)
    return out


def ridge(feat: DataFrame, target: int, reg: float = 0.1) -> np.ndarray:
    """The coefficients of ``solved`` over all rows."""
    shift, sums = gram(feat)
    if not sums:
        raise ValueError("no rows to fit")
    return solved(shift, sums[0], target, reg)


def predict(feat: DataFrame, target: int, coefficients: np.ndarray) -> DataFrame:
    """entity_id, v (the target's value), predicted."""
    intercept, *each = (float(x) for x in coefficients)
    model = F.array(*[F.lit(x) for x in each])
    value = F.aggregate(F.zip_with("features", model, lambda x, c: x * c), F.lit(intercept), lambda s, x: s + x)
    return feat.select("entity_id", F.col("features")[target].alias("v"), value.alias("predicted"))


def out_of_fold(folded: DataFrame, target: int, reg: float = 0.1) -> DataFrame:
    """entity_id, fold, v, predicted: the rows of each fold by the model of all others, from
    one pass over the sums and one over the rows. ``folded``: wide, with a fold."""
    shift, sums = gram(folded, "fold")
    total = sum(sums.values())
    models = {fold: solved(shift, total - own, target, reg).tolist() for fold, own in sums.items() if (total - own)[0, 0] > 0}
    table = folded.sparkSession.createDataFrame(list(models.items()), "fold long, model array<double>")
    met = folded.withColumn("fold", F.col("fold").cast("long")).join(F.broadcast(table), "fold")  # a row for each fold
    value = F.aggregate(F.zip_with("features", F.slice("model", 2, F.size("features")), lambda x, c: x * c), F.get("model", F.lit(0)), lambda s, x: s + x)
    return met.select("entity_id", "fold", F.col("features")[target].alias("v"), value.alias("predicted"))
