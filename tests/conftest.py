from __future__ import annotations

import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(x):  # no arrays: queries return scalars
    if pd.isna(x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if hasattr(x, "strftime"):
        return str(x)[:10]
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def same_rows(result, oracle) -> None:
    """Equal columns and equal rows in any order."""
    columns = sorted(result.columns)
    assert columns == sorted(oracle.columns)
    rows = [sorted((tuple(map(_cell, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=repr) for df in (result, oracle)]
    assert rows[0] == rows[1]
