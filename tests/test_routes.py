import pytest

from plumbline.operators import graph


def test_a_source_that_no_root_reaches_hides_no_route(spark):
    edges = spark.createDataFrame([("a", "x"), ("r", "x"), ("b", "y"), ("c", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    damaged = spark.createDataFrame([("x",), ("y",), ("b",)], "node string")
    got = graph.routes(damaged, edges, spark.createDataFrame([("r",)], "node string")).collect()
    assert sorted(tuple(r) for r in got) == [("x", "r", "r/x"), ("y", "r", "r/x/y")]


@pytest.mark.parametrize("few", [1, 1 << 16])
def test_only_links_that_lead_to_damage_are_walked(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "_FEW", few)
    walked, reach = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda roots, edges, *more: walked.append(edges) or reach(roots, edges, *more))
    edges = spark.range(3000).selectExpr("concat('n', id div 10) AS src", "concat('x', id) AS dst")
    edges = edges.unionByName(spark.createDataFrame([("r", "n7"), ("s", "n7"), ("x71", "deep"), (None, "x71"), ("x71", None), ("lost", "deeper")], "src string, dst string"))
    damaged = spark.createDataFrame([("deep",), ("x75",), ("deeper",)], "node string")
    got = graph.routes(damaged, edges, spark.createDataFrame([("r",), ("s",)], "node string")).collect()
    assert sorted(map(tuple, got)) == [("deep", "r", "r/n7/x71/deep"), ("x75", "r", "r/n7/x75")]
    assert walked[-1].count() <= 8


def test_a_sieve_drops_nothing_that_is_wanted(spark):
    nodes = spark.range(0, 200_000, 2).selectExpr("concat('k', id) AS node")
    rows = spark.range(200_000).selectExpr("concat('k', id) AS at", "id")
    got = graph._sieved(rows, "at", nodes, nodes.count())
    assert got.columns == rows.columns and got.count() < 110_000
    assert got.where("id % 2 = 0").count() == 100_000
