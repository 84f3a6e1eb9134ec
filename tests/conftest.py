"""One local session for all tests, and what several of them share."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", local).config("spark.sql.warehouse.dir", f"{local}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return str(DATA)


def tidied(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Asserts that a query and its SQL give the same rows over the test tables."""
    tables = duckdb.connect()
    for path in DATA.iterdir():
        tables.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")

    def check(query, sql: str) -> int:
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        ours = sorted((tuple(tidied(r[c]) for c in names) for r in df.collect()), key=repr)
        result = tables.execute(sql)
        at = {d[0]: i for i, d in enumerate(result.description)}
        assert sorted(at) == names
        theirs = sorted((tuple(tidied(r[at[c]]) for c in names) for r in result.fetchall()), key=repr)
        assert ours == theirs
        return len(ours)

    return check
