"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from meshwright import api_queries, catalog, scale_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


QUERIES = catalog.queries() | api_queries.queries() | scale_queries.queries()
SQL = catalog.oracle_sql() | api_queries.oracle_sql() | scale_queries.oracle_sql()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(SQL))
def test_query_gives_the_sql_rows(spark, db, name):
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    wanted = sorted(tuple(r[names.index(c)] for c in order) for r in cursor.fetchall())
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == wanted


def test_no_python_in_plans(spark):
    for name, query in QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name


def test_a_sweep_makes_its_graph_once(spark, monkeypatch):
    """Its runs read what was written of the graph, not the tables again."""
    seen = []
    real = api_queries.aggregate
    monkeypatch.setattr(api_queries, "aggregate", lambda g, *x, **k: seen.append(g.edges._jdf.queryExecution().executedPlan().toString()) or real(g, *x, **k))
    assert api_queries.sweep_file(spark, "/root/testdata/sf0.001").count() == 12
    assert len(seen) == 12 and not any("FileScan" in x for x in seen)
