"""Queries beside their SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from codestrata.plans import registry, virtual

TABLES = "/root/testdata/sf0.001"
SAMPLE = [n for k, n in enumerate(registry.QUERIES) if k % 5 == 0 or n.startswith(("graph", "tree", "rule", "group", "module", "format", "should", "rows", "targets", "scan"))]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    made = registry.QUERIES[name](spark, TABLES)
    columns = sorted(made.columns)
    rows = duck.execute(registry.ORACLES[name])
    assert sorted(d[0] for d in rows.description) == columns
    at = [[d[0] for d in rows.description].index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in made.collect()) == sorted(str(tuple(r[k] for k in at)) for r in rows.fetchall())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_flagship(spark):
    assert registry.flagship(spark, TABLES).count() == 50


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_whole_graph_loses_no_edge(spark):
    deps = virtual.imports(spark, TABLES).where("within_workspace")
    want = {r[0] for r in deps.select("package_id").union(deps.select("import_path")).distinct().collect()}
    assert {r["id"] for r in registry.QUERIES["graph_nodes"](spark, TABLES).collect()} == want
