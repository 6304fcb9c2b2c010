"""Every registered query with SQL gives what DuckDB gives; the operators' edge cases."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph, links, ordered, report, sets
from plumbline.plans import formats, relational, stores

SF = "/root/testdata/sf0.001"
QUERIES, SQL = relational.queries() | stores.queries() | formats.queries(), relational.oracle_sql() | stores.oracle_sql() | formats.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(names, values):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return order, sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        r = db.execute(SQL[name])
        assert got == rows([x[0] for x in r.description], r.fetchall())
    else:
        assert got[1]


def test_reach_with_cycles_and_sharing(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (9, 9)], "src long, dst long")
    got = graph.reach(spark.createDataFrame([(1,), (1,)], "node long"), edges).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert graph.reach(spark.createDataFrame([], "node long"), edges).count() == 0


def test_reach_down_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.reach(spark.createDataFrame([(0,)], "node long"), edges).agg(F.max("level")).first()[0] == 40


def test_chain_roots_refuses_a_ring(spark):
    with pytest.raises(ValueError):
        graph.chain_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, base long"), most=6)


def test_layers_and_positions(spark):
    layers = spark.createDataFrame([("a", 0, 10), ("b", 10, 11), ("c", 11, 5000)], "layer string, low long, high long")
    points = spark.createDataFrame([(0,), (9,), (10,), (11,), (4999,), (5000,)], "pos long")
    assert sorted((r["pos"], r["layer"]) for r in links.in_layer(points, layers, "pos", "low", "high", 16).collect()) == [(0, "a"), (9, "a"), (10, "b"), (11, "c"), (4999, "c")]
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["v"] == r["at"] for r in links.positions(df, ["v"], "at").collect())


def test_sets_with_a_winner(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "k long, v string"), spark.createDataFrame([(2, "b"), (3, "b")], "k long, v string")
    assert sorted((r["k"], r["v"]) for r in sets.overlay(a, b, key="k").collect()) == [(1, "a"), (2, "b"), (3, "b")]
    assert sorted((r["k"], r["v"]) for r in sets.first_wins(a, b, key="k").collect()) == [(1, "a"), (2, "a"), (3, "b")]


def test_status_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "g long, bit int")
    assert report.status(none, F.col("bit")).first()["status"] == 0
    assert ordered.duplicates(none, ["g"]).count() == 0


def test_released_tables_are_gone(spark, tmp_path):
    from plumbline import shared

    df = shared.written(spark.range(3), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert shared.release(spark) > 0 and not os.path.exists(path) and shared.release(spark) == 0
