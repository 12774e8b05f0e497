"""Every query with SQL against DuckDB on the smallest tables, and what the others promise."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from matrixloom.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, db, name):
    df, want = QUERIES[name](spark, sf), db.sql(SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}
    assert {c: kinds[str(t)] for c, t in zip(want.columns, want.types)} == dict(df.dtypes)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(map(str, want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{entry.SMALL}/lineitem.parquet").selectExpr("l_partkey", "floor((l_quantity - 1) / 17)").distinct().count()
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_trees(spark, sf):
    nodes = QUERIES["seymour_nodes"](spark, sf).collect()
    by = {(r.mid, r.node): r for r in nodes}
    below = QUERIES["seymour_attributes"](spark, sf).collect()
    assert all(by[r.mid, r.node].regularity == r.regularity for r in below) and below
    for r in nodes:
        if r.kind == "ONESUM":
            mine = [x for x in nodes if x.mid == r.mid and x.parent == r.node]
            assert sorted(i for x in mine for i in x.rows) == r.rows and sorted(j for x in mine for j in x.cols) == r.cols


def test_graphs_rebuild_their_matrices(spark, sf):
    graphic = {r.mid for r in QUERIES["graphic"](spark, sf).collect() if r.is_graphic}
    rebuilt = {r.mid: r.equal for r in QUERIES["graphic_reconstruction"](spark, sf).collect()}
    assert set(rebuilt) == graphic and all(rebuilt.values())


def test_verdicts_fit_together(spark, sf):
    at = lambda name, col: {r.mid: r[col] for r in QUERIES[name](spark, sf).collect()}
    tu, balanced, camion, network = at("tu_masks", "is_tu"), at("balanced", "is_balanced"), at("camion", "is_camion"), at("network", "is_network")
    regular, graphic, sp = at("regular", "is_regular"), at("graphic", "is_graphic"), at("series_parallel", "is_sp")
    assert all((not tu[k] or balanced[k] and camion[k]) and (not network[k] or tu[k]) and (not sp[k] or tu[k]) for k in tu)
    assert all(regular[k] or not graphic[k] for k in regular)
    assert all(r.is_network for r in QUERIES["generated_networks"](spark, sf).collect())
    assert all(r.is_sp for r in QUERIES["generated_series_parallel"](spark, sf).collect())
