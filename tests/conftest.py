import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test data")
    return str(path)


@pytest.fixture(scope="session")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def same_rows(spark_df, con, sql):
    """Whether a Spark result and a DuckDB query hold the same rows, floats to 7 places."""
    import pandas as pd

    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(float(x), 7) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    rows = lambda d: sorted((tuple(cell(x) for x in r) for r in d[columns].itertuples(index=False)), key=repr)
    assert rows(a) == rows(b)
    return len(a)
