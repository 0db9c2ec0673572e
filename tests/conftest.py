import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels pages conversations events orders lineitem customer part supplier nation region".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(_norm, x))
    if isinstance(x, bool):
        return x
    if isinstance(x, str):
        return x
    return round(float(x), 6)


@pytest.fixture(scope="session")
def same():
    """Compare a Spark DataFrame with a DuckDB relation: columns by name, rows in any order."""

    def check(df, rel):
        got, want = df.toArrow(), rel.to_arrow_table()
        names = sorted(got.column_names)
        assert names == sorted(want.column_names)
        rows = [sorted((repr([_norm(r[c]) for c in names]) for r in t.to_pylist())) for t in (got, want)]
        assert rows[0] == rows[1]

    return check
