import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = REPO + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("quillon-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a DataFrame and a SQL text give the same columns and rows."""

    def check(df, sql):
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        want = cur.fetchall()
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        at = [names.index(c) for c in order]
        left = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
        right = sorted(repr(tuple(r[i] for i in at)) for r in want)
        assert left == right

    return check
