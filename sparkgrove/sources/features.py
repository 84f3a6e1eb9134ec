"""Feature tables: one row per entity, read against a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BadFeatures(ValueError):
    """A feature table that breaks its contract; says which column and how many rows."""


def read_features(
    spark: SparkSession, path: str, id_col: str = "entity_id", vec_col: str = "features", label_col: str | None = "label", check: bool = True
) -> DataFrame:
    """Reads Parquet into entity_id long, features array<double>, label int.

    Fails on null ids, vectors, elements or labels, on NaN or infinite elements, unequal
    vector lengths and repeated ids; nothing is imputed. ``check=False`` skips the two
    passes of the check for a table that is known to be good.
    """
    return checked(spark.read.parquet(path), id_col, vec_col, label_col, check)


def checked(table: DataFrame, id_col: str = "entity_id", vec_col: str = "features", label_col: str | None = "label", check: bool = True) -> DataFrame:
    columns = [F.col(id_col).cast("long").alias("entity_id"), F.col(vec_col).cast("array<double>").alias("features")]
    if label_col is not None:
        columns.append(F.col(label_col).cast("int").alias("label"))
    wide = table.select(columns)
    if check:
        _check(wide, {"entity_id": id_col, "features": vec_col, "label": label_col})
    return wide


def _check(wide: DataFrame, names: dict[str, str | None]) -> None:
    bad = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    faults = {f"null {names[c]}": F.sum(F.col(c).isNull().cast("long")) for c in wide.columns}
    faults[f"null, NaN or infinite element of {names['features']}"] = F.sum(F.coalesce(bad, F.lit(False)).cast("long"))
    row = wide.agg(F.min(F.size("features")), F.max(F.size("features")), F.count(F.lit(1)), *faults.values()).first()
    for name, n in zip(faults, row[3:]):
        if n:
            raise BadFeatures(f"{name}: {n} rows")
    if row[2] and row[0] != row[1]:
        n = wide.where(F.size("features") != row[1]).count()
        raise BadFeatures(f"{names['features']} has unequal lengths: {n} rows are shorter than {row[1]}")
    repeated = wide.groupBy("entity_id").count().where("count > 1").agg(F.sum("count")).first()[0]
    if repeated:
        raise BadFeatures(f"repeated {names['entity_id']}: {repeated} rows")
