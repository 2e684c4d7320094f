from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", f"{scratch}/local")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that Spark and DuckDB write alike."""
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return value


def same_rows(df, sql: str) -> None:
    """Asserts that a DataFrame has the columns and rows, in any order, that DuckDB gives for the SQL."""
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    wanted = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(wanted.columns) == names
    places = [wanted.columns.index(n) for n in names]
    ours = sorted((str([plain(r[n]) for n in names]) for r in df.collect()))
    theirs = sorted(str([plain(r[i]) for i in places]) for r in wanted.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
