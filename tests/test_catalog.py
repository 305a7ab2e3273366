"""The catalogue against DuckDB on the smallest tables, and the driver's entry points."""

import glob
import os

import pytest

import __spark_entry__
from nearfield.plans import catalog

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(rows):
    return sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = tables.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(dict(zip(names, r))[c] for c in columns) for r in found.fetchall()]
    assert normal(tuple(r[c] for c in columns) for r in df.collect()) == normal(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 467
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flat_vs_hier_over_zero_bytes_and_halves(spark, tmp_path):
    # 205/3200 and 1615/3200 are halves at the sixth digit that no product with a power of ten shows
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier (s_suppkey BIGINT, s_nationkey INT, s_acctbal DOUBLE)")
    for key, seed in [(0, 1), (5, 1), (3200, 2), (205, 2), (1615, 2), (3205, 2)]:
        con.execute("INSERT INTO supplier VALUES (?, ?, ?)", [key, seed, key * 1.25 - 3])
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    found = catalog.QUERIES["flat_vs_hier"](spark, str(tmp_path)).select("name", "repetitions", "seed", "delta_us", "delta_agreement", "size_ratio").collect()
    expected = con.execute(catalog.SQL["flat_vs_hier"]).fetchall()
    assert normal(found) == normal(expected) and any(r[5] == float("inf") for r in expected)
