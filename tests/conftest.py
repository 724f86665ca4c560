import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL by value, in any order."""

    import pandas as pd

    def check(query, sql):
        got, want = query(spark, DATA).toPandas(), duck.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert len(got) == len(want) and len(got) > 0

        def rows(df):
            def plain(v):
                if not isinstance(v, (list, dict)) and pd.isna(v):
                    return "-"
                return f"{v:.6g}" if isinstance(v, float) or type(v).__name__.startswith(("int", "float")) else str(v)

            return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None))

        assert rows(got) == rows(want)

    return check
