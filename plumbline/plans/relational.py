"""The operators over keyed tables: one query for each, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import content, names
from plumbline.model import severity_table
from plumbline.operators import graph, links, ordered, report, sets
from plumbline.shared import written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (t) -> DataFrame, where t(name) is a table, under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def long(name: str):
    return F.col(name).cast("long")


# --- links -------------------------------------------------------------------------------


@query("""
SELECT 5::BIGINT AS phase, o_orderkey AS oid, 'dangling' AS verdict,
       'dangling order ' || o_orderkey AS text, 2::BIGINT AS bit
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""")
def fk_dangling(t):
    """Orders that nothing links to."""
    orders = t("orders").select(F.col("o_orderkey").alias("node"), F.lit(True).alias("present"))
    used = t("lineitem").select(F.col("l_orderkey").alias("dst"))
    none = orders.select("node").limit(0)
    found = graph.verdicts(orders, none, used).where("verdict = 'dangling'")
    return found.select(
        F.lit(5).cast("long").alias("phase"), F.col("node").alias("oid"), "verdict",
        F.concat(F.lit("dangling order "), F.col("node").cast("string")).alias("text"), F.lit(2).cast("long").alias("bit"),
    )


@query("""
WITH old AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), rich AS (SELECT * FROM customer WHERE c_acctbal > 0)
SELECT 'lineitem->orders' AS edge, l_orderkey AS dst, count(*)::BIGINT AS n_refs, min(l_partkey) AS first_src
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM old) GROUP BY l_orderkey
UNION ALL
SELECT 'orders->customer', o_custkey, count(*)::BIGINT, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM rich) GROUP BY o_custkey
UNION ALL
SELECT 'lineitem->supplier', l_suppkey, count(*)::BIGINT, min(l_orderkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey
""")
def fk_missing_targets(t):
    """Keys that are referred to and not there (parents cut by a filter, so that some are)."""
    old = t("orders").where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"))
    line = t("lineitem")
    return links.missing_by_kind(
        {
            "lineitem->orders": (line.select(F.col("l_partkey").alias("src"), F.col("l_orderkey").alias("dst")), old.select(F.col("o_orderkey").alias("dst"))),
            "orders->customer": (t("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("dst"))),
            "lineitem->supplier": (line.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")), t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))),
        }
    )


def _node(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _edges(t) -> DataFrame:
    """Regions to nations to customers to orders to parts."""
    pairs = [
        (t("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey")),
        (t("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey")),
        (t("orders"), ("customer", "o_custkey"), ("order", "o_orderkey")),
        (t("lineitem").select("l_orderkey", "l_partkey").distinct(), ("order", "l_orderkey"), ("part", "l_partkey")),
    ]
    out = None
    for df, src, dst in pairs:
        one = df.select(_node(*src).alias("src"), _node(*dst).alias("dst"))
        out = one if out is None else out.unionByName(one)
    return written(out, "edges")  # every round of a walk reads them


def _nodes(t) -> DataFrame:
    tables = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey"}
    out = None
    for name, key in tables.items():
        one = t(name).select(_node("order" if name == "orders" else name, key).alias("node"))
        out = one if out is None else out.unionByName(one)
    return out


_EDGES_SQL = """
edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem),
nodes AS (
  SELECT 'region:' || r_regionkey AS node FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'part:' || p_partkey FROM part)
"""
_REACH_SQL = "reach(node) AS (SELECT 'region:1' UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.node)"


def _root(t) -> DataFrame:
    return t("region").where("r_regionkey = 1").select(_node("region", "r_regionkey").alias("node"))


@query(f"WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL} SELECT node FROM reach")
def fk_reachable_from_roots(t):
    """Everything that links lead to from one region."""
    return graph.reach(_root(t), _edges(t)).select("node")


@query(f"WITH RECURSIVE {_EDGES_SQL}, {_REACH_SQL} SELECT node, CASE WHEN node IN (SELECT dst FROM edges) THEN 'unreachable' ELSE 'dangling' END AS verdict FROM nodes WHERE node NOT IN (SELECT node FROM reach)")
def fk_unreachable(t):
    """What no link leads to from that region, and whether anything refers to it."""
    edges = _edges(t)
    return graph.verdicts(_nodes(t).withColumn("present", F.lit(True)), graph.reach(_root(t), edges), edges)


@query(f"""
WITH RECURSIVE {_EDGES_SQL}, steps(node, level) AS (SELECT 'region:1', 0 UNION SELECT e.dst, s.level + 1 FROM steps s JOIN edges e ON e.src = s.node)
SELECT split_part(node, ':', 1) AS kind, level::BIGINT AS level, count(*)::BIGINT AS n
FROM (SELECT node, min(level) AS level FROM steps GROUP BY node) GROUP BY ALL
""")
def fk_reach_levels(t):
    """How many nodes of each kind lie how far from the root."""
    found = graph.reach(_root(t), _edges(t))
    return found.groupBy(F.substring_index("node", ":", 1).alias("kind"), "level").agg(F.count("*").alias("n"))


@query("""
SELECT 'order:' || o_orderkey AS node, 'region:' || n_regionkey AS root,
       'region:' || n_regionkey || '/nation:' || n_nationkey || '/customer:' || c_custkey || '/order:' || o_orderkey AS route
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""")
def route_to_damaged(t):
    """The way from a region to every order without lines, found backwards from the order."""
    orders = t("orders").select(F.col("o_orderkey").alias("k"))
    bad = links.missing(orders, t("lineitem").select(F.col("l_orderkey").alias("k")), "k").select(_node("order", "k").alias("node"))
    return graph.routes(bad, _edges(t), t("region").select(_node("region", "r_regionkey").alias("node")))


@query("""
SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.implied <> d.lang THEN 'type' ELSE 'ok' END AS status
FROM (SELECT doc_id * 2 AS doc_id, CASE WHEN quality = 1 THEN 'en' ELSE 'de' END AS implied FROM labels) l
LEFT JOIN documents d ON d.doc_id = l.doc_id
""")
def wrong_type_links(t):
    """Links that imply a type, against the type their target has."""
    claims = t("labels").select((F.col("doc_id") * 2).alias("doc_id"), F.when(F.col("quality") == 1, "en").otherwise("de").alias("implied"))
    return links.resolve(claims, t("documents").select("doc_id", "lang"), "doc_id", "lang", "implied").select("doc_id", "status")


@query("""
SELECT o_orderkey AS ref, CASE WHEN c_custkey IS NULL THEN 'invalid pointer' WHEN o_orderpriority LIKE '1%' AND c_mktsegment <> 'BUILDING' THEN 'not a commit' ELSE 'ok' END AS status
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey
""")
def pointer_resolution(t):
    """Refs against objects: missing, or of a kind that this sort of ref may not have."""
    refs = t("orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderpriority").startswith("1"), F.lit("BUILDING")).alias("implied"))
    objects = t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("kind"))
    found = links.resolve(refs, objects, "key", "kind", "implied")
    said = F.when(F.col("status") == "missing", "invalid pointer").when(F.col("status") == "type", "not a commit").otherwise("ok")
    return found.select("ref", said.alias("status"))


@query("""
WITH h AS (SELECT user_id, event_id AS new, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events),
u AS (SELECT user_id, new AS oid, 'new' AS side FROM h UNION ALL SELECT user_id, old, 'old' FROM h WHERE old IS NOT NULL)
SELECT user_id, oid, side FROM u WHERE oid NOT IN (SELECT event_id FROM events WHERE value > 1)
""")
def history_pointer_check(t):
    """Both sides of every history line must exist."""
    events = t("events")
    h = events.select("user_id", F.col("event_id").alias("new"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("old"))
    sides = h.unpivot("user_id", ["new", "old"], "side", "oid").where("oid is not null")
    return links.missing(sides, events.where("value > 1").select(F.col("event_id").alias("oid")), "oid").select("user_id", "oid", "side")


@query("""
SELECT key, layer::BIGINT AS layer, name, balance FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY layer DESC) AS r FROM (
    SELECT c_custkey AS key, 0 AS layer, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, 1, s_name, s_acctbal FROM supplier)) WHERE r = 1
""")
def overlay_union(t):
    """Two tables by key; the second's rows win."""
    base = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return sets.overlay(base, t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), key="key")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def except_pending(t):
    """What was found and is not done."""
    return sets.pending(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("""
SELECT user_id, layer::BIGINT AS layer, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY layer) AS r FROM (
  SELECT user_id, 0 AS layer, count(*)::BIGINT AS n FROM events WHERE event_type = 'click' GROUP BY user_id
  UNION ALL SELECT user_id, 1, count(*)::BIGINT FROM events WHERE event_type <> 'click' GROUP BY user_id)) WHERE r = 1
""")
def union_first_wins(t):
    """Two damage lists by key; the first's entries stay."""
    count = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"))
    e = t("events")
    return sets.first_wins(count(e.where("event_type = 'click'")), count(e.where("event_type <> 'click'")), key="user_id")


@query("""
SELECT doc_id, quality::BIGINT AS grade, 'label' AS origin FROM labels
UNION ALL SELECT doc_id, -1::BIGINT, 'reserve' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def salvage_fill(t):
    """Salvaged rows, completed from a reserve."""
    salvaged = t("labels").select("doc_id", long("quality").alias("grade"), F.lit("label").alias("origin"))
    reserve = t("documents").select("doc_id", F.lit(-1).cast("long").alias("grade"), F.lit("reserve").alias("origin"))
    return sets.fill(salvaged, reserve, "doc_id")


@query("""
WITH want AS (SELECT doc_id, sha1(text) AS oid FROM documents WHERE source = 'src0'),
c AS (SELECT w.doc_id, 0 AS rung, d.doc_id AS origin, sha1(d.text) = w.oid AS ok FROM want w JOIN documents d ON d.doc_id = w.doc_id + 1
      UNION ALL SELECT w.doc_id, 1, d.doc_id, true FROM want w JOIN documents d ON sha1(d.text) = w.oid AND d.source <> 'src0'
      UNION ALL SELECT w.doc_id, 2, w.doc_id, true FROM want w)
SELECT doc_id, rung::BIGINT AS rung, origin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rung, origin) AS r FROM c WHERE ok) WHERE r = 1
""")
def recovery_ladder(t):
    """For each damaged record the first source whose content hashes to its name."""
    docs = t("documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("hash"))
    want = docs.where("source = 'src0'").select("doc_id", F.col("hash").alias("oid"))
    other = docs.select(F.col("doc_id").alias("origin"), "hash", "source")
    candidate = lambda df, rung: df.select("doc_id", "oid", F.lit(rung).cast("long").alias("rung"), "origin", "hash")
    neighbour = want.withColumn("origin", F.col("doc_id") + 1).join(other, "origin")
    copy = want.join(other.where("source <> 'src0'"), F.col("oid") == F.col("hash"))
    own = want.withColumns({"origin": F.col("doc_id"), "hash": F.col("oid")})
    all_ = candidate(neighbour, 0).unionByName(candidate(copy, 1)).unionByName(candidate(own, 2))
    return links.ladder(all_, "doc_id", "rung", F.col("hash") == F.col("oid")).select("doc_id", "rung", "origin")


@query("""
SELECT user_id, max_by(event_id, event_id) AS event_id, max(event_id) AS ord FROM events WHERE value > 50 GROUP BY user_id
""")
def asof_newest_valid(t):
    """The newest entry of each history that is still good."""
    e = t("events").select("user_id", "event_id", F.col("event_id").alias("ord"))
    return links.newest_valid(e, t("events").where("value > 50").select("event_id"), "user_id", "event_id", "ord")


@query("""
WITH layers AS (SELECT s_suppkey AS layer, s_suppkey * 37 AS low, s_suppkey * 37 + 20 + s_suppkey % 17 AS high FROM supplier)
SELECT o_orderkey AS pos, layer FROM orders JOIN layers ON o_orderkey >= low AND o_orderkey < high
""")
def range_layer_lookup(t):
    """Positions to the layer whose range holds them, by cells."""
    s = F.col("s_suppkey")
    layers = t("supplier").select(s.alias("layer"), (s * 37).alias("low"), (s * 37 + 20 + s % 17).alias("high"))
    return links.in_layer(t("orders").select(F.col("o_orderkey").alias("pos")), layers, "pos", "low", "high", 64).select("pos", "layer")


@query("""
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS by_price, row_number() OVER (ORDER BY p_partkey) - 1 AS by_key FROM part)
SELECT p_partkey, by_price::BIGINT AS by_price, by_key::BIGINT AS by_key FROM p WHERE by_price = by_key
""")
def positional_match(t):
    """Records whose place in one order is their place in another."""
    part = t("part").select("p_partkey", "p_retailprice")
    both = links.positions(part, ["p_retailprice", "p_partkey"], "by_price").join(links.positions(part, ["p_partkey"], "by_key").select("p_partkey", "by_key"), "p_partkey")
    return both.where("by_price = by_key").select("p_partkey", "by_price", "by_key")


@query("""
WITH a AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_partkey AS v FROM lineitem),
b AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_partkey AS v FROM lineitem WHERE l_quantity > 5)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.pos, b.pos)::BIGINT AS pos, a.v AS left_value, b.v AS right_value,
       CASE WHEN b.v IS NULL THEN 'ends early' WHEN a.v IS NULL THEN 'too long' ELSE 'mismatch' END AS difference
FROM a FULL JOIN b ON a.k = b.k AND a.pos = b.pos WHERE b.v IS NULL OR a.v IS NULL OR a.v <> b.v
""")
def parents_positional_compare(t):
    """Two lists of parents compared by position."""
    by = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    line = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"), "l_quantity", *by)
    place = lambda df: links.ranked(df, by, "pos", ["k"]).select("k", "pos", "v")
    return links.compare_positional(place(line), place(line.where("l_quantity > 5")), "k", "pos", "v")


# --- content -----------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS oid FROM documents")
def content_address(t):
    """Records named by their content."""
    return t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("oid"))


@query("SELECT doc_id, sha1(concat('blob ', octet_length(encode(text)), chr(0), text)) AS oid FROM documents")
def typed_content_address(t):
    """Records named by their type, length and content."""
    return t("documents").select("doc_id", content.object_id("blob", F.col("text")).alias("oid"))


@query("SELECT sha256(text) AS oid, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(t):
    """Content that several records share."""
    oid = F.sha2(F.col("text").cast("binary"), 256).alias("oid")
    return t("documents").groupBy(oid).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query()
def crc_sweep(t):
    """CRC-32 of every record's bytes."""
    return t("documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("""
SELECT b, n::BIGINT AS n, sum(n) OVER (ORDER BY b)::BIGINT AS total FROM (SELECT substr(sha256(text), 1, 2) AS b, count(*) AS n FROM documents GROUP BY 1)
""")
def fanout_histogram(t):
    """The cumulative histogram of the first byte of every name."""
    return ordered.fanout(t("documents").select(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 2).alias("b")), "b")


@query("SELECT doc_id, n_chars, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE octet_length(encode(text)) <> n_chars OR n_chars // 2048 > octet_length(encode(text))")
def size_plausibility(t):
    """Claimed against real sizes."""
    d = t("documents").select("doc_id", "n_chars", F.octet_length("text").cast("long").alias("bytes"))
    return d.where((F.col("bytes") != F.col("n_chars")) | (F.floor(F.col("n_chars") / 2048) > F.col("bytes")))


# --- status and reports ------------------------------------------------------------------

_BITS = "CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END | CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END | CASE WHEN o_orderpriority LIKE '1%' THEN 4 ELSE 0 END"


@query(f"SELECT o_custkey, bit_or({_BITS})::BIGINT AS status FROM orders GROUP BY o_custkey")
def status_bitmask(t):
    """The status of each group: the bit-or of its findings."""
    bit = (
        F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).bitwiseOR(F.when(F.col("o_orderstatus") == "F", 2).otherwise(0))
    ).bitwiseOR(F.when(F.col("o_orderpriority").startswith("1"), 4).otherwise(0))
    return report.status(t("orders"), bit, ["o_custkey"])


@query("""
SELECT l_orderkey, bool_or(l_quantity > 49) AS large, bool_or(l_discount = 0) AS plain, bool_or(l_returnflag = 'R') AS returned,
       bool_or(l_linestatus = 'O') AS open, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey
""")
def any_flags_per_parent(t):
    """Flags of a parent: true if any of its entries has them."""
    return t("lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_quantity") > 49).alias("large"), F.bool_or(F.col("l_discount") == 0).alias("plain"),
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_linestatus") == "O").alias("open"), F.count("*").alias("n"),
    )


_IDS = ["badDate", "nulInHeader", "hasDot", "badFilemode", "extraHeaderEntry"]
_ID_SQL = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_IDS)) + " END"


def _findings(t) -> DataFrame:
    msg = F.element_at(F.array(*[F.lit(x) for x in _IDS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t("orders").select(F.col("o_orderkey").alias("oid"), msg.alias("msg_id"), F.col("o_custkey").alias("pos"), "o_orderstatus")


@query(f"""
SELECT oid, msg_id, severity FROM (SELECT o_orderkey AS oid, {_ID_SQL} AS msg_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))
JOIN (VALUES ('badDate', 'warn'), ('nulInHeader', 'error'), ('hasDot', 'error'), ('badFilemode', 'warn')) s(id, severity) ON id = msg_id
""")
def severity_filter(t):
    """Findings graded: overrides, strict, ignored checks and skipped objects gone, fatal and info shown as they print."""
    found = _findings(t)
    spark = found.sparkSession
    skip = found.join(t("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("pos")), "pos", "left_semi").select("oid")
    return report.graded(found, severity_table(spark, {"baddate": "warn"}, strict=True), skip).select("oid", "msg_id", "severity")


@query(f"""
SELECT (row_number() OVER (ORDER BY phase, grp, pos, oid, seq) - 1)::BIGINT AS line, phase, grp, pos, oid, msg_id FROM (
  SELECT (o_orderkey % 7)::BIGINT AS phase, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS grp, o_custkey AS pos, o_orderkey AS oid, 0 AS seq, {_ID_SQL} AS msg_id FROM orders)
""")
def ordered_report(t):
    """The report in its order, every line numbered."""
    found = _findings(t).select(
        (F.col("oid") % 7).alias("phase"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).cast("long").alias("grp"), "pos", "oid", F.lit(0).alias("seq"), "msg_id"
    )
    return links.positions(found, report.KEY, "line").select("line", "phase", "grp", "pos", "oid", "msg_id")


@query("""
SELECT kind, count(*)::BIGINT AS total, count(*) FILTER (WHERE ok)::BIGINT AS repaired, count(*) FILTER (WHERE NOT ok)::BIGINT AS unrepaired, bool_and(ok) AS all_ok
FROM (SELECT o_orderstatus AS kind, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS ok FROM orders) GROUP BY kind
""")
def result_rollup(t):
    """What would and would not be repaired, by kind."""
    has = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_has", F.lit(True))
    rows = t("orders").join(has, "o_orderkey", "left").select(F.col("o_orderstatus").alias("kind"), F.coalesce("_has", F.lit(False)).alias("ok"))
    return rows.groupBy("kind").agg(F.count("*").alias("total"), F.count_if("ok").alias("repaired"), F.count_if(~F.col("ok")).alias("unrepaired"), F.bool_and("ok").alias("all_ok"))


# --- order -------------------------------------------------------------------------------


@query("""
SELECT * FROM (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT AS placed, lag(epoch(o_orderdate)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE previous > placed
""")
def monotonic_violations(t):
    """Rows below the one before."""
    rows = t("orders").select("o_custkey", "o_orderkey", F.unix_timestamp("o_orderdate").alias("placed"))
    return ordered.out_of_order(rows, ["o_orderkey"], "placed", ["o_custkey"])


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_entries(t):
    """Keys that occur more than once."""
    return ordered.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS "end" FROM events
""")
def entry_spans(t):
    """Where each entry ends: where the next begins."""
    return ordered.spans(t("events").select("user_id", "event_id"), "event_id", ["user_id"], F.lit(-1).cast("long"))


@query("""
SELECT l_orderkey AS node, max(p_size)::BIGINT AS parents, max(p_size)::BIGINT + 1 > any_value(o.g) AS too_low
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT o_orderkey, o_orderkey % 60 AS g FROM orders) o ON o_orderkey = l_orderkey GROUP BY l_orderkey
""")
def max_parent_generation(t):
    """A node's generation must be above its parents'."""
    own = t("orders").select(F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 60).alias("g"))
    parents = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("node")).agg(F.max("p_size").cast("long").alias("parents"))
    return parents.join(own, "node").select("node", "parents", (F.col("parents") + 1 > F.col("g")).alias("too_low"))


@query("""
SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by('order ' || o_orderkey || ' is ' || o_orderstatus, o_orderkey) AS text FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey
""")
def first_violation(t):
    """The first complaint of each group."""
    bad = t("orders").where("o_totalprice > 300000")
    text = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" is "), F.col("o_orderstatus"))
    return ordered.first_violation(bad.select("o_custkey", "o_orderkey", text.alias("text")), "o_custkey", ["o_orderkey"], "text")


@query("""
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 128)::BIGINT AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def batch_assign(t):
    """What is wanted, in batches of 128."""
    return ordered.batched(sets.pending(t("documents").select("doc_id"), t("labels"), "doc_id"), ["doc_id"], 128)


@query("""
SELECT a.o_orderkey FROM orders a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE o_orderstatus <> 'P') b
USING (o_orderkey, o_totalprice, o_orderdate)
""")
def trust_unchanged(t):
    """Records whose name, size and time are those of an earlier snapshot."""
    now = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    price = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    then = t("orders").where("o_orderstatus <> 'P'").select("o_orderkey", price.alias("o_totalprice"), "o_orderdate")
    return now.join(then, ["o_orderkey", "o_totalprice", "o_orderdate"], "left_semi").select("o_orderkey")


# --- names and texts ---------------------------------------------------------------------

_REF_SQL = "replace(url, 'https://', 'refs/')"


@query(f"""
SELECT page_id, CASE WHEN n = '' THEN 'empty' WHEN n = '@' THEN 'at' WHEN regexp_matches(n, '[\\x00-\\x20\\x7F~^:?\\[\\\\*]') THEN 'byte' WHEN contains(n, '..') THEN 'dots'
  WHEN contains(n, '@{{') THEN 'reflog' WHEN list_contains(string_split(n, '/'), '') THEN 'component' WHEN regexp_matches(n, '(^|/)\\.') THEN 'dot'
  WHEN regexp_matches(n, '\\.lock(/|$)') THEN 'lock' WHEN ends_with(n, '.') THEN 'final dot' WHEN NOT contains(n, '/') THEN 'one level' ELSE 'ok' END AS fault
FROM (SELECT page_id, {_REF_SQL} AS n FROM pages)
""")
def name_grammar(t):
    """The first rule that a name breaks."""
    n = F.replace(F.col("url"), F.lit("https://"), F.lit("refs/"))
    return t("pages").select("page_id", F.coalesce(names.refname_fault(n), F.lit("ok")).alias("fault"))


@query("""
SELECT doc_id, w AS name FROM (SELECT doc_id, unnest(list_distinct(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '))) AS w FROM documents)
WHERE w <> '' AND (regexp_matches(lower(substr(w, 1, 2)), '^([.~]|g[i~]|m[a~])') OR regexp_matches(substr(w, 1, 2), '[^\\x00-\\x7F]'))
""")
def alias_prefilter(t):
    """Names that may be aliases of control files."""
    words = t("documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \\t\\n\\r\\f]+"))).alias("name"))
    return words.where((F.col("name") != "") & names.may_be_alias(F.col("name")))


@query("""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
       url LIKE '-%' OR regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) = '' OR contains(lower(url), '%0a') OR regexp_matches(url, '/\\.\\.(/|$)') AS refused
FROM pages
""")
def url_rule(t):
    """Urls that a submodule may not have."""
    url = F.col("url")
    host = F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1)
    refused = url.startswith("-") | (host == "") | F.contains(F.lower(url), F.lit("%0a")) | url.rlike(r"/\.\.(/|$)")
    return t("pages").select("page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), host.alias("host"), refused.alias("refused"))


@query("""
SELECT doc_id, count(*)::BIGINT AS n_long, max(b)::BIGINT AS longest FROM (SELECT doc_id, octet_length(encode(unnest(string_split(text, chr(10))))) AS b FROM documents) WHERE b >= 2048 GROUP BY doc_id
""")
def line_length_rule(t):
    """Lines of 2,048 bytes and more."""
    lengths = F.filter(F.transform(F.split("text", "\n"), lambda x: F.octet_length(x)), lambda n: n >= 2048)
    d = t("documents").select("doc_id", lengths.alias("l")).where(F.size("l") > 0)
    return d.select("doc_id", F.size("l").cast("long").alias("n_long"), F.array_max("l").cast("long").alias("longest"))


@query("""
SELECT doc_id, contains(text, chr(0)) AS has_nul, NOT ends_with(text, chr(10)) AS unterminated, instr(text, chr(10) || chr(10))::BIGINT AS blank_line FROM documents
""")
def nul_and_terminator(t):
    """Header-block rules: a zero byte, no final line feed, where the blank line is."""
    text = F.col("text")
    return t("documents").select("doc_id", F.contains(text, F.lit("\0")).alias("has_nul"), (~text.endswith("\n")).alias("unterminated"), F.instr(text, F.lit("\n\n")).cast("long").alias("blank_line"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def kv_parse(t):
    """Keys and values out of text."""
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id, event_type AS key, max_by(event_id, event_id) AS value, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def last_wins_config(t):
    """Values of a key in several files: the last one wins."""
    return t("events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.max_by("event_id", "event_id").alias("value"), F.count("*").alias("n"))


@query("""
WITH p AS (SELECT c_custkey AS name, c_custkey // 3 AS target FROM customer WHERE c_custkey >= 3)
SELECT c.c_custkey AS name, coalesce(c4.target, c3.target, c2.target, c1.target, c.c_custkey) AS last,
  ((c1.target IS NOT NULL)::INT + (c2.target IS NOT NULL)::INT + (c3.target IS NOT NULL)::INT + (c4.target IS NOT NULL)::INT)::BIGINT AS hops
FROM customer c LEFT JOIN p c1 ON c1.name = c.c_custkey LEFT JOIN p c2 ON c2.name = c1.target LEFT JOIN p c3 ON c3.name = c2.target LEFT JOIN p c4 ON c4.name = c3.target
""")
def bounded_pointer_chase(t):
    """Pointers followed four times at most."""
    k = F.col("c_custkey")
    pointers = t("customer").where(k >= 3).select(k.alias("name"), F.floor(k / 3).cast("long").alias("target"))
    return graph.chase(pointers, t("customer").select(k.alias("name")), 4)


@query("""
WITH RECURSIVE p AS (SELECT c_custkey AS node, c_custkey // 3 AS base FROM customer WHERE c_custkey >= 3 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey < 3),
r AS (SELECT node, node AS root, 0 AS depth FROM p WHERE base IS NULL OR base NOT IN (SELECT node FROM p)
      UNION ALL SELECT p.node, r.root, r.depth + 1 FROM r JOIN p ON p.base = r.node)
SELECT node, root, depth::BIGINT AS depth FROM r
""")
def chain_root_depth(t):
    """The root of every chain of bases, and how deep each link lies."""
    k = F.col("c_custkey")
    return graph.chain_roots(t("customer").select(k.alias("node"), F.when(k >= 3, F.floor(k / 3).cast("long")).alias("base")))


@query("""
SELECT o_orderkey AS node, row_number() OVER (ORDER BY o_orderkey)::BIGINT - 1 AS level FROM orders
""")
def deep_chain_reach(t):
    """All orders, each linked to the next: as deep as there are orders, and reached through contracted chains."""
    at = links.positions(t("orders").select(F.col("o_orderkey").alias("node")), ["node"], "at")
    at = written(at, "chain")
    edges = at.join(at.select((F.col("at") - 1).alias("at"), F.col("node").alias("dst")), "at").select(F.col("node").alias("src"), "dst")
    return graph.reach(at.where("at = 0").select("node"), written(edges, "edges"))  # every level of the walk reads them


@query("""
SELECT 'region:' || r_regionkey AS root, n_name || '/' || c_name AS path, c_custkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
""")
def flatten_hierarchy(t):
    """All paths of a tree of trees."""
    none = F.lit(None).cast("long")
    nations = t("nation").select(_node("region", "n_regionkey").alias("tree"), F.col("n_name").alias("name"), none.alias("k"), _node("nation", "n_nationkey").alias("child"), F.lit(True).alias("is_tree"))
    people = t("customer").select(_node("nation", "c_nationkey").alias("tree"), F.col("c_name").alias("name"), F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("child"), F.lit(False).alias("is_tree"))
    roots = t("region").select(_node("region", "r_regionkey").alias("tree"))
    return graph.flatten(nations.unionByName(people).drop("k"), roots).select("root", "path", F.col("child").cast("long").alias("child"))


@query("""
WITH c AS (SELECT n_regionkey AS region, c_nationkey AS nation, c_custkey AS customer, sha1(c_name) AS value FROM customer JOIN nation ON n_nationkey = c_nationkey),
n AS (SELECT region, nation, sha1(string_agg(customer || ':' || value, ',' ORDER BY customer)) AS value FROM c GROUP BY ALL)
SELECT region, sha1(string_agg(nation || ':' || value, ',' ORDER BY nation)) AS value, count(*)::BIGINT AS n FROM n GROUP BY region
""")
def bottom_up_fold(t):
    """A hash tree: the digest of each node from those of its children."""
    people = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    leaves = people.select(F.col("n_regionkey").alias("region"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.sha1(F.col("c_name").cast("binary")).alias("value"))
    return graph.fold_up(leaves, [("customer", "nation"), ("nation", "region")], lambda x: F.sha1(x.cast("binary")))[-1]


@query("""
SELECT l_orderkey AS oid, s_suppkey AS place, s_acctbal AS balance FROM (
  SELECT l_orderkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY l_orderkey ORDER BY s_nationkey, s_suppkey) AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) WHERE r = 1
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
""")
def location_lookup(t):
    """Of all places of a record the first in order."""
    places = t("lineitem").select(F.col("l_orderkey").alias("oid"), "l_suppkey").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    places = places.select("oid", F.col("s_nationkey"), F.col("s_suppkey").alias("place"), F.col("s_acctbal").alias("balance"))
    return links.first_match(t("orders").select(F.col("o_orderkey").alias("oid")), places, "oid", ["s_nationkey", "place"]).select("oid", "place", "balance")


@query("""
WITH t AS (SELECT conv_id, turn, CASE (conv_id + 3 * turn) % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'assistant' ELSE role END AS role FROM conversations)
SELECT conv_id, turn, role FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM t)
WHERE (role = 'assistant' AND b NOT IN ('user')) OR (role = 'system' AND b <> '') OR (role = 'user' AND b NOT IN ('', 'system', 'assistant'))
""")
def line_context_rule(t):
    """Lines that may not follow the one before; roles are broken so that some do."""
    at = (F.col("conv_id") + 3 * F.col("turn")) % 5
    role = F.when(at == 0, F.lit("system")).when(at == 1, F.lit("assistant")).otherwise(F.col("role"))
    turns = t("conversations").select("conv_id", "turn", role.alias("role"))
    return ordered.line_context(turns, "role", "conv_id", "turn", {"assistant": ("user",), "system": ("",), "user": ("", "system", "assistant")})


@query("""
(SELECT 'a' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) UNION ALL
(SELECT 'b', doc_id FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents))
""")
def both_sided_difference(t):
    """What only one of two tables has."""
    return sets.difference(t("documents").select("doc_id"), t("labels").select("doc_id")).select("side", "doc_id")


@query("""
SELECT page_id, k.section AS section, k.subsection AS subsection, k.name AS name FROM (SELECT page_id,
  CASE WHEN contains(h, '.') THEN {'section': lower(split_part(h, '.', 1)), 'subsection': CASE WHEN len(string_split(h, '.')) > 2 THEN array_to_string(string_split(h, '.')[2:-2], '.') END, 'name': lower(string_split(h, '.')[-1])} END AS k
  FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages))
""")
def key_split(t):
    """Keys cut at their first and last dot."""
    k = names.split_key(F.regexp_extract("url", "://([^/?#]*)", 1))
    return t("pages").select("page_id", k["section"].alias("section"), k["subsection"].alias("subsection"), k["name"].alias("name"))
