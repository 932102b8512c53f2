"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from cladeloom.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    rel = con.execute(ORACLE_SQL[name])
    at = {d[0]: k for k, d in enumerate(rel.description)}
    assert sorted(at) == cols
    assert got == sorted(repr(tuple(r[at[c]] for c in cols)) for r in rel.fetchall())


@pytest.mark.parametrize("prices", [[1200.5, 77000.25, 105000.0, 105000.0], [900.0, 1000.0, None, None], [500.0], [700.5, 700.5], [None]])
def test_density_where_values_lie_on_lattice_points(spark, tmp_path, prices):
    """The point above a highest value that lies on one is no bin; nulls do not count, and one value has no curve."""
    rows = [(k, 1, 1, 1, p, "R") for k, p in enumerate(prices)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["score_density"](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(ORACLE_SQL["score_density"]).fetchall())
    assert len(got) == (200 if len({p for p in prices if p is not None}) > 1 else 0)


def test_filters_stand_below_the_shuffle(spark):
    plan = QUERIES["hits_ranked"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "l_tax" not in plan


def test_entry_module_without_the_llm_folder(spark, monkeypatch):
    import builtins
    import importlib

    import __spark_entry__ as e

    real = builtins.__import__

    def without(name, *a, **k):
        if name.startswith(("cladeloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name.removesuffix(".queries"))
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", without)
    importlib.reload(e)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)
    assert e.entry(spark).count() > 0


def test_entry_module_doesnt_hide_a_missing_dependency(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def without(name, *a, **k):
        if name.startswith("cladeloom.llm"):
            raise ModuleNotFoundError("xxhash", name="xxhash")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.raises(ModuleNotFoundError):
        e.queries()
