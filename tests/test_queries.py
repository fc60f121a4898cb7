"""Every query with a SQL twin, side by side with DuckDB on the smallest tables."""

import math
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in names]).collect())
    if name not in registry.SQL:
        assert rows or name in ("drawdown_episodes",), sys.maxsize
        return
    found = duck.execute(registry.SQL[name])
    theirs = [d[0] for d in found.description]
    order = sorted(range(len(theirs)), key=lambda k: theirs[k])
    assert names == sorted(theirs)
    assert rows == sorted(tuple(norm(r[k]) for k in order) for r in found.fetchall())


def test_all_columns(spark, sf):
    x = np.array([r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], float)
    values = np.sort(np.linalg.svd(x, compute_uv=False))[::-1]
    got = [r["value"] for r in registry.QUERIES["singular_values"](spark, sf).orderBy("k").collect()]
    np.testing.assert_allclose(got, values, rtol=1e-6)
    rows = registry.QUERIES["gram_eigenvalues"](spark, sf).orderBy("k").collect()
    np.testing.assert_allclose(sorted((r["value"] for r in rows), reverse=True), values[:10] ** 2, rtol=1e-9)
    assert len(rows) == 10 and max(r["residual"] for r in rows) < 1e-8


def _both(spark, name, folder):
    """Rows of a query and of its SQL on tables of a folder."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df, found = registry.QUERIES[name](spark, str(folder)), con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    return sorted(tuple(map(norm, r)) for r in df.select(*names).collect()), sorted(tuple(map(norm, r)) for r in found.fetchall())


def test_quotients_by_zero(spark, tmp_path):
    duckdb.sql("SELECT row_number() OVER () AS l_orderkey, 1 AS l_linenumber, 1::BIGINT AS l_partkey, q AS l_quantity, 900.0::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, t AS l_tax FROM (VALUES (0.0::DOUBLE), (-3.0), (7.0), (NULL)) a(q), (VALUES (0.0::DOUBLE), (0.03), (NULL)) b(t)").write_parquet(str(tmp_path / "lineitem.parquet"))
    ours, theirs = _both(spark, "arithmetic", tmp_path)
    assert ours == theirs and len(ours) == 12


def test_formats_at_ties(spark, tmp_path):
    duckdb.sql("SELECT i AS o_orderkey, 500.0::DOUBLE * i AS o_totalprice FROM range(-3, 3000) a(i) UNION ALL SELECT -9, NULL").write_parquet(str(tmp_path / "orders.parquet"))
    ours, theirs = _both(spark, "number_formats", tmp_path)
    assert ours == theirs and len(ours) == 3004


def test_rounding_of_arithmetic(spark, tmp_path):
    """Ties, values beyond 2^53 / 10^4, signs of zero, and NULL beside NaN, to the last bit."""
    values = "(VALUES (NULL::DOUBLE), ('nan'), ('inf'), (0.0), ('-0.0'), (-0.00001), (0.00005), (1.00005), (-17.00015), (0.285), (123456789012.12345), (4503599627370497.5), (-1e15 / 3), (1e305))"
    duckdb.sql(f"SELECT row_number() OVER () AS l_orderkey, 1 AS l_linenumber, 1::BIGINT AS l_partkey, q AS l_quantity, p AS l_extendedprice, d AS l_discount, t AS l_tax FROM {values} a(q), {values} b(p), (VALUES (0.0::DOUBLE), (0.05)) c(d), {values} e(t)").write_parquet(str(tmp_path / "lineitem.parquet"))
    found = duckdb.sql(registry.SQL["arithmetic"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet'"))
    ours = registry.QUERIES["arithmetic"](spark, str(tmp_path)).select(*found.columns).collect()
    ours, theirs = (sorted(tuple(map(repr, r)) for r in rows) for rows in (ours, found.fetchall()))
    assert ours == theirs and len(ours) == 2 * 14**3
