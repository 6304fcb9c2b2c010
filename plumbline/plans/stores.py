"""Queries that take tables through the object store's own formats and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import model
from plumbline.functions import checks, content, names
from plumbline.shared import ship
from plumbline.sources import codecs


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema)], names=[n for n, _ in schema])


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [("doc_id", pa.int64()), ("oid", pa.string()), ("typ", pa.string()), ("size", pa.int64()), ("failed", pa.bool_())]
    for batch in batches:
        rows = []
        for doc_id, text, break_it in zip(*(c.to_pylist() for c in batch.columns)):
            body = (text or "").encode()
            got = codecs.decode_loose(codecs.encode_loose("blob", body), codecs.object_id("blob", body + b"x" if break_it else body))
            rows.append((doc_id, got.oid.hex() if got.oid else None, got.kind, got.size, got.failed))
        yield _batch(rows, schema)


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a loose object, written and read; every tenth under a name that is not its own, which must be noticed."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 10 == 0).alias("b"))
    return docs.mapInArrow(_loose, "doc_id long, oid string, typ string, size long, failed boolean")


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = [("doc_id", pa.int64()), ("oid", pa.string()), ("delta_bytes", pa.int64())]
    for batch in batches:
        rows = []
        for doc_id, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            base, target = (a or "").encode(), (b or "").encode()
            same = next((i for i, (x, y) in enumerate(zip(base, target)) if x != y), min(len(base), len(target)))
            ops, k = [], 0
            while k < same:
                n = min(same - k, 0xFFFF)
                off, size = k.to_bytes(4, "little"), n.to_bytes(3, "little")
                ops.append(bytes([0xFF]) + off + size)
                k += n
            ops += [bytes([len(target[i : i + 127])]) + target[i : i + 127] for i in range(same, len(target), 127)]
            delta = codecs.to_varint(len(base)) + codecs.to_varint(len(target)) + b"".join(ops)
            made = codecs.apply_delta(base, delta)
            rows.append((doc_id, codecs.object_id("blob", made).hex() if made is not None else None, len(delta)))
        yield _batch(rows, schema)


def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a delta on its neighbour's, applied again: the names must be those of the texts."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("base"))
    return docs.join(base, "doc_id", "left").select("doc_id", "base", "text").mapInArrow(_deltas, "doc_id long, oid string, delta_bytes long").select("doc_id", "oid")


_TREE = [("o_custkey", pa.int64()), ("ord", pa.int64()), ("mode", pa.int64()), ("name", pa.string()), ("child", pa.string())]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, entries in zip(*(c.to_pylist() for c in batch.columns)):
            made = [("40000" if e["s"] == "O" else "100644", str(e["k"]).encode(), bytes.fromhex(e["h"])) for e in entries]
            got, error = codecs.parse_tree(codecs.encode_tree(made))
            if error:
                raise ValueError(error)
            rows += [(key, i, mode, name.decode(), oid.hex()) for i, (_, mode, name, oid) in enumerate(got)]
        yield _batch(rows, _TREE)


def tree_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a tree object, encoded and decoded: entries in path order."""
    ship(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    entry = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    trees = orders.groupBy("o_custkey").agg(F.collect_list(entry).alias("e"))
    return trees.mapInArrow(_trees, "o_custkey long, ord long, mode long, name string, child string")


def _idents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    severity = model.severities()
    for batch in batches:
        rows = []
        for key, body in zip(*(c.to_pylist() for c in batch.columns)):
            found = checks.check_commit(body.encode(), severity)
            rows.append((key, found[0][0] if found else "ok"))
        yield _batch(rows, [("o_orderkey", pa.int64()), ("finding", pa.string())])


def commit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a commit object, some of them malformed: the first complaint about each."""
    ship(spark)
    key = F.col("o_orderkey")
    fault = key % 8
    name = F.when(fault == 1, F.lit("A<a@x>")).when(fault == 2, F.lit("A a@x")).when(fault == 3, F.lit("<a@x>")).otherwise(F.lit("A <a@x>"))
    date = F.when(fault == 4, F.concat(F.lit("0"), key.cast("string"))).otherwise(F.concat(F.lit("1"), key.cast("string")))
    zone = F.when(fault == 5, F.lit("UTC")).otherwise(F.lit("+0000"))
    tree = F.when(fault == 6, F.lit("xyz")).otherwise(F.sha1(key.cast("string").cast("binary")))
    who = F.concat(name, F.lit(" "), date, F.lit(" "), zone)
    author = F.when(fault == 7, F.lit("")).otherwise(F.concat(F.lit("author "), who, F.lit("\n")))
    body = F.concat(F.lit("tree "), tree, F.lit("\n"), author, F.lit("committer A <a@x> 1 +0000\n\nmessage\n"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", body.alias("body")).mapInArrow(_idents, "o_orderkey long, finding string")


def _configs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for event_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            entries, error = codecs.parse_config(text)
            rows += [(event_id, k, v, line, error is not None) for k, v, line in entries]
        yield _batch(rows, [("event_id", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("line", pa.int64()), ("broken", pa.bool_())])


def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a configuration text: its entries."""
    ship(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit('[user "'), F.col("user_id").cast("string"), F.lit('"]\n\tEvent = "'), F.col("event_type"), F.lit('" ; note\n\tbare\n'))
    return e.select("event_id", text.alias("text")).mapInArrow(_configs, "event_id long, key string, value string, line long, broken boolean")


def _urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [checks.submodule_url_ok(url or "") for url in batch.column("made").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(ok, pa.bool_())], names=["page_id", "url", "url_ok"])


def submodule_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as they are, for the helpers, relative, and escaping upwards, by the rule for submodules; ref names by theirs."""
    ship(spark)
    way, url = F.col("page_id") % 9, F.coalesce("url", F.lit(""))
    made = (
        F.when(way == 1, F.concat(F.lit("..//"), url)).when(way == 2, F.concat(F.lit("../foo/:"), url)).when(way == 3, F.concat(F.lit("http::"), url))
        .when(way == 4, F.lit("ftps::no host")).when(way == 5, F.concat(F.lit("./%0a"), url)).when(way == 6, F.concat(F.lit(".././/"), url))
        .when(way == 7, F.concat(F.lit("../"), url)).when(way == 8, F.concat(F.lit("./:"), url)).otherwise(url)
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", made.alias("made"))
    judged = pages.mapInArrow(_urls, "page_id long, url string, url_ok boolean")
    return judged.select("page_id", "url_ok", names.refname_ok(F.concat(F.lit("refs/"), F.coalesce("url", F.lit("")))).alias("name_ok"))


def trailer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a digest at their end, made of texts; every seventh made wrong."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.col("text").cast("binary")
    trailer = F.unhex(F.when(F.col("doc_id") % 7 == 0, F.sha1(F.reverse("text").cast("binary"))).otherwise(F.sha1(body)))
    return docs.select("doc_id", content.trailer_holds(F.concat(body, trailer)).alias("holds"))


_NAME_SQL = "sha1(concat('blob ', octet_length(encode(text)), chr(0), text))"

_SQL = {
    "store_round_trip": f"""
SELECT doc_id, {_NAME_SQL} AS oid, 'blob' AS typ, octet_length(encode(text))::BIGINT AS size, doc_id % 10 = 0 AS failed FROM documents
""",
    "delta_round_trip": f"SELECT doc_id, {_NAME_SQL} AS oid FROM documents",
    "tree_decode": """
SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY encode(o_orderkey || CASE o_orderstatus WHEN 'O' THEN '/' ELSE '' END)) - 1)::BIGINT AS ord,
       CASE o_orderstatus WHEN 'O' THEN 16384 ELSE 33188 END::BIGINT AS mode, o_orderkey::VARCHAR AS name, sha1(o_orderkey::VARCHAR) AS child FROM orders
""",
    "commit_check": """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'missingSpaceBeforeEmail' WHEN 2 THEN 'missingEmail' WHEN 3 THEN 'missingNameBeforeEmail' WHEN 4 THEN 'zeroPaddedDate'
  WHEN 5 THEN 'badTimezone' WHEN 6 THEN 'badTreeSha1' WHEN 7 THEN 'missingAuthor' ELSE 'ok' END AS finding FROM orders
""",
    "config_parse": """
SELECT event_id, 'user.' || user_id || '.event' AS key, event_type AS value, 2::BIGINT AS line, false AS broken FROM events
UNION ALL SELECT event_id, 'user.' || user_id || '.bare', NULL, 3::BIGINT, false FROM events
""",
    "submodule_rules": r"""
SELECT page_id, CASE page_id % 9 WHEN 0 THEN regexp_matches(url, '^[a-z]+://[^/?#]') WHEN 3 THEN regexp_matches(url, '^[a-z]+://[^/?#]') WHEN 2 THEN true WHEN 7 THEN true WHEN 8 THEN true ELSE false END AS url_ok,
  NOT regexp_matches('refs/' || url, '[\x00-\x20\x7F~^:?\[\\*]') AND NOT contains(url, '..') AND NOT contains(url, '//') AND NOT ends_with(url, '/') AND NOT ends_with(url, '.') AS name_ok FROM pages
""",
    "trailer_check": "SELECT doc_id, doc_id % 7 <> 0 OR text = reverse(text) AS holds FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (store_round_trip, delta_round_trip, tree_decode, commit_check, config_parse, submodule_rules, trailer_check)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
