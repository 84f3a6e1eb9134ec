"""What several operators share: table readers, word patterns, shared storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path, remove, shared_dir  # noqa: F401

#: A word of the size and fingerprint contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there,
    and a lost executor costs a reread, not a recomputation."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder for the time of a ``with`` block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, kind: str) -> DataFrame:
        path = fresh_path(self.spark, kind)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)


def in_files(docs: DataFrame) -> list[Column] | None:
    """Columns by which rows of files that Spark wrote sort as they lie in them: the
    files by the numbers of their tasks. None for rows that are not read from files."""
    name = F.col("_metadata.file_name")
    place = [F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:
        return None
    return place


#: Bytes of an Arrow batch that a task takes at a time.
ARROW_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with batches of few bytes: the session's bound is lowered where it
    is Spark's own, which lets a task hold 64 MB of text several times over."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) == f"{64 << 20}b":
        conf.set(_BATCH, f"{ARROW_BYTES}b")
    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, text_column: int, n_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``n_bytes`` of text or one row, so that what a task
    makes of a part stays small, however long the texts of a batch are."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, n_bytes + (ends[at - 1] if at else 0), side="right")))
        yield batch.slice(at, end - at)
        at = end


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
