import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Spark's Python workers
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs001(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def same_rows(df, cursor):
    """Whether a Spark result and a DuckDB result hold the same columns and rows, in any order."""

    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 9) + 0.0
        return tuple(map(plain, v)) if isinstance(v, list) else v

    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect())
    assert got == want
    return len(got)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con
