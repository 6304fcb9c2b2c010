"""Graphs of typed links: reachability, verdicts, routes, chains, bounded chases, folds.

Loops write each round to the shared folder: lineage stays short, and a lost executor
takes no round with it.  A node is expanded once, however many links lead to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.shared import written


def _nearest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.min("level").alias("level"))


_BITS = 26
_FEW, _MANY = 1 << 16, 1 << 24


def _sieved(rows: DataFrame, column: str, nodes: DataFrame, size: int) -> DataFrame:
    """The rows whose column may be one of `size` nodes (node), so that a join with them does not shuffle all rows.

    A node has a bit, by its hash; the bits are broadcast, a million words of 64 at most.  Only what cannot
    match is dropped; the join that follows is exact.  So few nodes that Spark broadcasts them, or so
    many that too many bits would be set, are joined as they are.
    """
    if not _FEW <= size <= _MANY:
        return rows
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << _BITS))
    hashed = nodes.select(bit("node").alias("_bit")).select(F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, cast(_bit & 63 as int))").alias("_set"))
    words = written(hashed.groupBy("_word").agg(F.bit_or("_set").alias("_set")), "sieve")
    met = rows.withColumn("_bit", bit(column)).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(words), "_word")
    return met.where("getbit(_set, cast(_bit & 63 as int)) = 1").select(*rows.columns)


def _jumps(links: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ... where one comes from a node by 2^k links (src, dst, far) of a chain; each node has one next node at most."""
    now, out, most = links, [], links.count()
    while 1 << len(out) <= 2 * most:  # on a ring the jumps never run out
        out.append(now)
        then = now.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("far").alias("more"))
        now = written(now.join(then, "dst").select("src", F.col("to").alias("dst"), (F.col("far") + F.col("more")).alias("far")), "jumps")
        if now.isEmpty():
            break
    return out


def _doubled(rows: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """rows (node, level) and all that the chains behind them hold: a logarithm of joins in place of one a link."""
    for k, jump in reversed(list(enumerate(jumps))):
        jumped = F.when(F.col("dst").isNotNull(), F.struct(F.col("dst").alias("node"), (F.col("level") + F.col("far")).alias("level")))
        both = rows.join(jump, F.col("node") == F.col("src"), "left").select(F.inline(F.array_compact(F.array(F.struct("node", "level"), jumped))))
        rows = _nearest(both)
        if k % 6 == 0:
            rows = written(rows, "along")
    return rows


class _Chains:
    """Links (src, dst), one a node at most, contracted so that a walk along all of them moves each a bounded number of times.

    A round takes nodes out of the chains, none of them next to another (those whose coin is 1
    and whose next node's is 0, a quarter), and links what led to them to what they led to, with the
    length of both.  The links shrink geometrically, so all rounds together cost a few times the
    first; doubling all of them would move every link once for each doubling.  The last `few` are doubled.
    """

    def __init__(self, links: DataFrame, few: int):
        self.rounds, now = [], links.withColumn("far", F.lit(1).cast("long"))
        while now.count() > few:
            coin = lambda c, k=len(self.rounds): F.pmod(F.xxhash64(F.lit(k), c), F.lit(2))
            now = now.withColumn("out", (coin("src") == 1) & (coin("dst") == 0))
            out = now.where("out").select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("far").alias("more"))
            led = written(now.where("not out").select("src", "dst", "far").join(out, "dst", "left"), "contracted")
            self.rounds.append((now, led.where("to is not null").select("src", "dst", "far")))
            now = led.select("src", F.coalesce("to", "dst").alias("dst"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
            now = now.where("src <> dst")  # a ring that has come down to one node
        self.jumps = _jumps(now)

    def along(self, rows: DataFrame) -> DataFrame:
        """rows (node, level), each node once, and all that the chains behind them hold."""
        ends, taken = [], []  # a round's nodes without a link; its nodes taken out
        for links, _ in self.rounds:  # what is known of a node that is taken out goes to the next one
            met = written(rows.join(links, F.col("node") == F.col("src"), "left"), "passed")
            ends.append(met.where("src is null").select("node", "level"))
            taken.append(met.where("out").select("node", "level"))
            passed = met.where("out").select(F.col("dst").alias("node"), (F.col("level") + F.col("far")).alias("level"))
            rows = _nearest(met.where("not out").select("node", "level").unionByName(passed))
        known = rest = _doubled(written(rows, "passed"), self.jumps)
        found = None
        for k in reversed(range(len(self.rounds))):  # and back, from the node before it
            before = known.select(F.col("node").alias("src"), "level")
            back = before.join(self.rounds[k][1], "src").select(F.col("dst").alias("node"), (F.col("level") + F.col("far")).alias("level"))
            back = written(_nearest(back.unionByName(taken[k])), "back")
            found = back if found is None else found.unionByName(back)
            known, rest = known.unionByName(ends[k]).unionByName(back), rest.unionByName(ends[k])
        return rest if found is None else _nearest(rest).unionByName(found)


def reach(roots: DataFrame, edges: DataFrame, along: DataFrame | None = None, shallow: int = 16, few: int = 1 << 18) -> DataFrame:
    """roots (node), edges (src, dst) -> (node, level): all that can be reached, and in how few steps.  Cycles are fine.

    The first `shallow` levels are walked one by one.  What lies deeper is reached through
    chains: of every node one link (of `along`, if given, as the first parents of a history),
    contracted and, the last `few`, doubled until the chains end, so a round passes a whole chain,
    and the number of rounds is that of the changes from chain to chain on a way, whatever the depth.
    """
    frontier = written(roots.select("node").distinct().withColumn("level", F.lit(0).cast("long")), "reach")
    seen, chains, level, left = frontier, None, 0, edges
    while size := frontier.count():
        level += 1
        step = frontier.join(_sieved(left, "src", frontier, size), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("level") + 1).alias("level"))
        if level < shallow:
            frontier = written(_nearest(step).join(seen.select("node"), "node", "left_anti"), "reach")
            seen = seen.unionByName(frontier)
            continue
        better = "_before is null or level < _before"
        if chains is None:
            links = written((along if along is not None else edges).select("src", "dst").where("dst is not null"), "chains")
            first = written(links.groupBy("src").agg(F.min("dst").alias("dst")).where("src <> dst"), "chains")
            crossed = along is not None or links.count() > first.count()
            left = written(edges.join(first, ["src", "dst"], "left_anti"), "crossings") if crossed else None  # chains are passed whole
            chains, seen, step = _Chains(first, few), written(seen, "reached"), frontier
            better = "_before is null or level <= _before"  # what has been reached last has not been left yet
        found = chains.along(written(_nearest(step), "reach"))
        before = seen.select("node", F.col("level").alias("_before"))
        frontier = written(found.join(before, "node", "left").where(better).select("node", "level"), "reach")
        seen = written(_nearest(seen.unionByName(frontier)), "reached")
        if left is None:
            break
    return seen


def named(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (node, name), edges (src, dst, ord, step) -> (node, level, name): how each reached node can be called.

    A name is that of the node it was reached from with the step put behind it; a first
    parent's step "^" after "~n" or "^" counts on ("~2").  Of several ways the shortest
    counts, then the least name and ord, so names do not depend on the order of work.  A name
    is made of that of the level before, so there is a round a level.
    """
    first = roots.groupBy("node").agg(F.min("name").alias("name")).withColumn("level", F.lit(0).cast("long"))
    frontier = written(first.select("node", "level", "name"), "named")
    seen, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        ways = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.struct("name", "ord", "step").alias("_w"))
        best = ways.groupBy("node").agg(F.min("_w").alias("_w")).join(seen.select("node"), "node", "left_anti")
        name, step = F.col("_w.name"), F.col("_w.step")
        run = F.regexp_extract(name, r"~(\d+)$", 1)
        counted = (
            F.when((step == "^") & (run != ""), F.concat(F.regexp_replace(name, r"~\d+$", "~"), (F.try_to_number(run, F.lit("9" * 9)).cast("long") + 1).cast("string")))
            .when((step == "^") & name.endswith("^"), F.concat(F.regexp_replace(name, r"\^$", ""), F.lit("~2")))
            .otherwise(F.concat(name, step))
        )
        frontier = written(best.select("node", F.lit(level).cast("long").alias("level"), counted.alias("name")), "named")
        seen = seen.unionByName(frontier)
        if level % 16 == 0:
            seen = written(seen, "named")
    return seen


def verdicts(nodes: DataFrame, reached: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, present) -> (node, verdict) of those that a report names.

    missing: reached and not present.  dangling: present, not reached, nothing links to it.
    unreachable: present, not reached, something does.
    """
    used = edges.select(F.col("dst").alias("node")).distinct().withColumn("_used", F.lit(True))
    all_ = nodes.join(reached.select("node").withColumn("_reached", F.lit(True)), "node", "left").join(used, "node", "left")
    verdict = (
        F.when(F.col("_reached") & ~F.col("present"), F.lit("missing"))
        .when(F.col("_reached").isNull() & F.col("present") & F.col("_used").isNull(), F.lit("dangling"))
        .when(F.col("_reached").isNull() & F.col("present"), F.lit("unreachable"))
    )
    return all_.select("node", verdict.alias("verdict")).where("verdict is not null")


def routes(damaged: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) -> (node, root, route): the ways from roots to damaged nodes, found backwards from the damage.

    Of several links into a node that from the source nearest to a root is taken, then the
    least, so each damaged node that can be reached has a route; one without a way from a
    root has no row.  A round goes one step nearer to the roots, as a route has that many steps.
    Only links into what leads to damage are walked: all that a shortest way to it can hold.
    """
    damaged = written(damaged.select("node"), "damaged")
    above = reach(damaged, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    into = above.select(F.col("node").alias("dst"))
    edges = written(_sieved(edges, "dst", above, above.count()).join(into, "dst", "left_semi").select("src", "dst"), "leading")
    near = reach(roots, edges).select(F.col("node").alias("src"), "level")
    up = edges.join(near, "src").groupBy(F.col("dst").alias("at")).agg(F.min(F.struct("level", "src")).alias("up")).select("at", F.col("up.src").alias("up"))
    walk = damaged.select("node", F.col("node").alias("at"), F.array("node").alias("route"))
    out, rounds = None, 0
    while True:
        walk, rounds = written(walk, "routes"), rounds + 1
        done = walk.join(roots.select(F.col("node").alias("at")), "at", "left_semi")
        done = done.select("node", F.col("at").alias("root"), F.array_join(F.reverse("route"), "/").alias("route"))
        out = done if out is None else out.unionByName(done)
        if rounds % 16 == 0:
            out = written(out, "routed")
        if walk.isEmpty():
            return out
        walk = walk.join(up, "at").where(~F.array_contains("route", F.col("up"))).select("node", F.col("up").alias("at"), F.concat("route", F.array("up")).alias("route"))


def chain_roots(links: DataFrame, most: int = 64) -> DataFrame:
    """(node, base) with base null at a root -> (node, root, depth), by pointer doubling.

    A base that is no node is a root of its own.  Rounds: the logarithm of the longest
    chain.  A ring of bases is an error.
    """
    now = written(links.select("node", F.coalesce("base", "node").alias("root"), F.when(F.col("base").isNull(), 0).otherwise(1).cast("long").alias("depth")), "chain")
    for _ in range(most):
        up = now.select(F.col("node").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        new = now.join(up, "root", "left").select(
            "node", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.when(F.col("_r").isNotNull() & (F.col("root") != F.col("node")), F.col("_d")).otherwise(0)).alias("depth"), (F.coalesce("_r", "root") != F.col("root")).alias("_moved")
        )
        new = written(new, "chain")
        if new.where("_moved").isEmpty():
            return new.drop("_moved")
        now = new.drop("_moved")
    raise ValueError("a chain of bases has no root")


def chase(pointers: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """start (name) -> (name, last, hops): follow pointers (name, target) at most `hops` times.  An unrolled self-join."""
    out = start.select("name", F.col("name").alias("last"), F.lit(0).cast("long").alias("hops"))
    for _ in range(hops):
        p = pointers.select(F.col("name").alias("last"), F.col("target").alias("_t"))
        out = out.join(p, "last", "left").select("name", F.coalesce("_t", "last").alias("last"), (F.col("hops") + F.col("_t").isNotNull().cast("long")).alias("hops"))
    return out


def flatten(entries: DataFrame, root: DataFrame) -> DataFrame:
    """entries (tree, name, child, is_tree, more columns), root (tree) -> (root, path, child, more): every path below, level by level.

    Ends when no tree is left, however deep; a tree that holds itself is an error.
    """
    more = [c for c in entries.columns if c not in ("tree", "name", "child", "is_tree")]
    at = root.select(F.col("tree").alias("root"), "tree", F.lit("").alias("prefix"), F.array("tree").alias("_above"))
    out, level = None, 0
    while True:
        level += 1
        below = at.join(entries, "tree").select("root", F.concat("prefix", "name").alias("path"), "child", "is_tree", "_above", *more)
        below = written(below, "flatten")
        leaves = below.where("not is_tree").select("root", "path", "child", *more)
        out = leaves if out is None else out.unionByName(leaves)
        if level % 16 == 0:
            out = written(out, "flattened")
        trees = below.where("is_tree")
        if trees.isEmpty():
            return out
        if not trees.where(F.array_contains("_above", F.col("child"))).isEmpty():
            raise ValueError("a tree holds itself")
        at = trees.select("root", F.col("child").alias("tree"), F.concat("path", F.lit("/")).alias("prefix"), F.array_append("_above", F.col("child")).alias("_above"))


def fold_up(leaves: DataFrame, levels: list[tuple[str, str]], digest) -> list[DataFrame]:
    """A hash tree from the bottom: leaves (key columns, value), then for each (child, parent) level the digest of the sorted children.

    levels name the columns: each level groups by its parent and joins `child:value` in
    order of the child.  digest turns the joined text into the parent's value.
    """
    out, now = [], leaves
    for child, parent in levels:
        keep = [c for c in now.columns if c not in (child, "value")]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(child, "value"))), lambda x: F.concat(x[child].cast("string"), F.lit(":"), x["value"])), ",")
        now = now.groupBy(*keep).agg(digest(joined).alias("value"), F.count("*").alias("n"))
        out.append(now)
        now = now.drop("n")
    return out
