"""Column helpers that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy(x: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def to_long(feat: DataFrame, *more: str) -> DataFrame:
    """Wide features → entity_id, [label], more columns, pos (0-based), v: one row per feature."""
    keys = [*(c for c in ("entity_id", "label") if c in feat.columns), *more]
    return feat.select(*keys, F.posexplode("features").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def to_wide(long: DataFrame) -> DataFrame:
    """The way back: entity_id, features by pos, [label]."""
    keys = [c for c in ("entity_id", "label") if c in long.columns]
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    return long.groupBy(*keys).agg(packed.alias("features")).select("entity_id", "features", *[k for k in keys if k == "label"])


def width_of(feat: DataFrame) -> int:
    """Number of features, from one row."""
    row = feat.select(F.size("features")).first()
    return row[0] if row else 0
