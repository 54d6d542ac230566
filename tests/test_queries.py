"""Every query with SQL gives DuckDB's rows; the others run. Row order and partitions don't matter."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from plotgauge.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in own.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(own.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert rows == sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 28
