"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, None] = {}
#: By application: the folder of a session on one machine that names none.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine (master ``local``) that names none, as in tests, gets a
    local one; on a cluster that would be another folder for each executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _local.get(context.applicationId)
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # the setting itself cannot change while a session lives
        named = _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="sparkgrove-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


def kept(df: DataFrame, kind: str) -> DataFrame:
    """``df``, written to the shared folder and read again, until ``cleanup``."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``fresh_path`` named, with all it holds."""
    if path in _made:
        del _made[path]
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes every folder that this process has written to the shared one. Results that
    were not written elsewhere are gone, too."""
    for path in list(_made):
        remove(spark, path)
