"""A session, and a comparison of DataFrames with DuckDB."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def oracle():
    def run(sf, sql):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for p in (DATA / sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        got = con.execute(sql)
        return got.fetchall(), [c[0] for c in got.description]

    return run


@pytest.fixture
def same(spark, oracle):
    def check(make, sql, sf="sf0.001"):
        df = make(spark, str(DATA / sf))
        mine = rows_of([tuple(r) for r in df.collect()], df.columns)
        rows, columns = oracle(sf, sql)
        assert sorted(df.columns) == sorted(columns)
        theirs = rows_of(rows, columns)
        assert len(mine) == len(theirs)
        wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
        assert not wrong, wrong[:3]

    return check
