import pytest

from plumbline.functions import checks
from plumbline.operators import graph


def nodes(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "node long")


def test_a_chain_of_a_hundred_thousand_links(spark):
    edges = spark.range(100_000).selectExpr("id AS src", "id + 1 AS dst")
    got = graph.reach(nodes(spark, 0), edges)
    assert got.count() == 100_001 and got.where("level <> node").isEmpty()


def test_levels_are_those_of_a_walk_where_chains_meet(spark):
    import random

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300) if i % 97] + [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(20)] + [(300, 0), (7, 7)]
    want, at, level = {0: 0}, [0], 0
    while at:
        level += 1
        at = sorted({d for s, d in edges for n in at if s == n} - set(want))
        want |= {n: level for n in at}
    df = spark.createDataFrame(edges, "src long, dst long")
    for along in (None, df.where("dst = src + 1")):
        assert {r["node"]: r["level"] for r in graph.reach(nodes(spark, 0), df, along, shallow=2).collect()} == want


def test_contracted_chains_give_the_levels_of_a_walk(spark):
    """Rings, chains that meet in trees, ends, and starts anywhere: as a walk of one link a step finds them."""
    import random

    rng = random.Random(5)
    next_ = {i: i + 1 for i in range(120) if i % 41} | {i: rng.randint(0, 199) for i in range(120, 200) if i % 9}
    next_ |= {300: 301, 301: 300, 310: 311, 311: 312, 312: 310, 320: 310} | {400 + i: 500 for i in range(30)} | {500: 501}
    links = spark.createDataFrame([(s, d) for s, d in next_.items() if s != d], "src long, dst long")
    starts = {n: rng.randint(0, 50) for n in [*rng.sample(range(200), 25), 300, 320, 311, 405, 406, 501, 999]}
    want = dict(starts)
    for n, level in starts.items():
        while (n := next_.get(n)) is not None and (level := level + 1) < want.get(n, 1 << 60):
            want[n] = level
    chains = graph._Chains(links, 2)
    assert len(chains.rounds) > 5
    got = chains.along(spark.createDataFrame(list(starts.items()), "node long, level long")).collect()
    assert len(got) == len(want) and {r["node"]: r["level"] for r in got} == want


def test_links_moved_by_contraction_stay_in_proportion(spark):
    """All rounds together hold a few times the links there are; doubling would hold them once a doubling."""
    links = spark.range(4000).selectExpr("id AS src", "id + 1 AS dst")
    held = sum(now.count() for now, _ in graph._Chains(links, 50).rounds)
    assert held < 6 * 4000


def test_walks_of_nothing(spark):
    none, edges = spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long")
    assert graph.reach(none, edges).count() == 0
    assert graph.reach(nodes(spark, 1), edges).count() == 1
    assert graph.routes(none, edges, nodes(spark, 1)).count() == 0
    named = spark.createDataFrame([], "node long, name string")
    assert graph.named(named, spark.createDataFrame([], "src long, dst long, ord long, step string")).count() == 0
    entries = spark.createDataFrame([], "tree string, name string, child string, is_tree boolean")
    assert graph.flatten(entries, spark.createDataFrame([("a",)], "tree string")).columns == ["root", "path", "child"]
    assert graph.flatten(entries, spark.createDataFrame([("a",)], "tree string")).count() == 0


def test_trees_of_130_levels_and_trees_that_hold_themselves(spark):
    rows = [(f"t{i}", "d", f"t{i + 1}", True) for i in range(130)] + [("t130", "file", "x", False)]
    entries = spark.createDataFrame(rows, "tree string, name string, child string, is_tree boolean")
    (got,) = graph.flatten(entries, spark.createDataFrame([("t0",)], "tree string")).collect()
    assert got["path"] == "d/" * 130 + "file" and got["child"] == "x"
    ring = spark.createDataFrame([("a", "b", "b", True), ("b", "a", "a", True)], "tree string, name string, child string, is_tree boolean")
    with pytest.raises(ValueError, match="holds itself"):
        graph.flatten(ring, spark.createDataFrame([("a",)], "tree string"))


@pytest.mark.parametrize(
    "url, ok",
    [
        ("..//example.com/x", False), (".././/x", False), ("../foo/:bar", True), ("../:x", False), ("./:x", True), ("./a%0ab", False), ("..\\/x", False),
        ("http::https://h/x", True), ("http::", False), ("ftp::nothing", False), ("https:///x", False), ("https://a@/x", False), ("https://u:p@h/x", True),
        ("https://h/%0a", False), ("git://h/%0a", False), ("git://h/x", True), ("-x", False), ("ssh://-h/x", True), ("a.git", True), ("HTTP://", True),
    ],
)
def test_submodule_urls(url, ok):
    assert checks.submodule_url_ok(url) is ok
