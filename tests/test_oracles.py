"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
from pathlib import Path

import __spark_entry__
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        found.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return found


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6g}"
    return f"{float(x):.6g}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
