"""Running sums along an axis, without a window over all rows.

Rows are range-sorted into files of the shared folder, one for each range; a sum runs within
a file, and what the files before hold is added to it. No task sees more than its range,
and the sums of the files are a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

_FILE = "__file"


def ranged(df: DataFrame, axis: str, n: int | None = None) -> DataFrame:
    """``df`` in files by ranges of ``axis`` (``n`` of them, by default as many as shuffle
    partitions), with the number of each row's file."""
    sized = df.repartitionByRange(n, axis) if n else df.repartitionByRange(axis)
    name = F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).cast("long")
    return kept(sized.sortWithinPartitions(axis), "ranged").withColumn(_FILE, name)


def running(df: DataFrame, axis: str, sums: dict[str, Column]) -> DataFrame:
    """``df``, of ``ranged``, with the sum of each of ``sums`` over all rows up to its own on
    ``axis``, whose values are distinct."""
    inside = Window.partitionBy(_FILE).orderBy(axis).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)
    files = df.groupBy(_FILE).agg(*[F.sum(x).alias(f"__{c}") for c, x in sums.items()])
    files = files.select(_FILE, *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    run = df.select("*", *[F.sum(x).over(inside).alias(c) for c, x in sums.items()])
    met = run.join(F.broadcast(files), _FILE)  # a row for each file
    return met.select(*df.columns, *[(F.coalesce(F.col(c), F.lit(0)) + F.col(f"__{c}")).alias(c) for c in sums])
