"""Queries that write rows in the store's binary and text formats, some of them damaged, and decode them again.

Every group that becomes a file is a run of neighbouring keys, so its size has a bound.
The writers here are for these queries; what a store is given is written by sources.codecs.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import model
from plumbline.functions import aliases, checks
from plumbline.shared import ship
from plumbline.sources import codecs

_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_NONE = 0x70000000  # a commit-graph parent that is not there
_AT_ONCE = 64  # input rows, each a whole file, as Python values at once
_OUT = 4096  # decoded rows as Python values at once
_BELOW = 1000  # commits in the layers below; positions go on from there


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, a few of them as Python values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, _AT_ONCE).columns))


def _batches(rows: Iterable[tuple], fields: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of _OUT rows at most, whatever number of them a row of the input makes."""
    rows = iter(rows)
    while some := list(islice(rows, _OUT)):
        yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*some), fields)], names=[n for n, _ in fields])


def _decoded(df: DataFrame, make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """make(*row) -> rows, for each row of df, in Arrow batches; a worker holds one file and one batch of rows."""
    ship(df.sparkSession)
    fields = [tuple(f.split()) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((out for row in _rows(batches) for out in make(*row)), fields)

    return df.mapInArrow(run, schema)


def _runs(spark: SparkSession, sf_dir: str, table: str, key: str, size: int) -> DataFrame:
    """(grp, keys): the keys of a table in runs of at most `size` neighbours."""
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("k"))
    return keys.groupBy(F.expr(f"k div {size}").alias("grp")).agg(F.sort_array(F.collect_list("k")).alias("keys"))


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias(key))


def _oid(what: object) -> bytes:
    return hashlib.sha1(str(what).encode()).digest()


def _hex(oid: bytes | None) -> str | None:
    return oid.hex() if oid is not None else None


def _sealed(data: bytes, sound: bool = True) -> bytes:
    return data + hashlib.sha1(data if sound else data + b"x").digest()


def _fan(oids: list[bytes]) -> list[int]:
    counts = [0] * 256
    for oid in oids:
        counts[oid[0]] += 1
    return [sum(counts[: i + 1]) for i in range(256)]


def _offset(k: int) -> int:
    return k * 97 + (1 << 32 if k % 5 == 0 else 0)


def _offsets(offsets: list[int]) -> tuple[bytes, bytes]:
    """The table of 32-bit offsets, and that of the wide ones it points into."""
    narrow, wide = [], []
    for off in offsets:
        if off >> 31:
            narrow.append(1 << 31 | len(wide))
            wide.append(off)
        else:
            narrow.append(off)
    return struct.pack(f">{len(narrow)}I", *narrow), struct.pack(f">{len(wide)}Q", *wide)


def _chunked(head: bytes, parts: dict[bytes, bytes]) -> bytes:
    at, table = len(head) + 12 * (len(parts) + 1), b""
    for name, body in parts.items():
        table += name + struct.pack(">Q", at)
        at += len(body)
    return _sealed(head + table + bytes(4) + struct.pack(">Q", at) + b"".join(parts.values()))


# --- packs and what is derived from them ---------------------------------------------------


def _pack_index(grp: int, keys: list[int]) -> Iterable[tuple]:
    held = sorted((_oid(k), k) for k in keys)
    fan = _fan([oid for oid, _ in held])
    if grp % 7 == 3:
        fan[10] = fan[255] + 1
    narrow, wide = _offsets([_offset(k) for _, k in held])
    crcs = struct.pack(f">{len(held)}I", *(k * 31 % (1 << 32) for _, k in held))
    data = b"\xfftOc" + struct.pack(">I256I", 2, *fan) + b"".join(oid for oid, _ in held) + crcs + narrow + wide + bytes(20)
    entries, fault = codecs.parse_pack_index(_sealed(data))
    if fault:
        yield grp, None, None, None, None, fault
    for i, (oid, off, crc) in enumerate(entries):
        yield grp, i, oid.hex(), off, crc, None


def pack_index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pack indexes, with offsets beyond 32 bits; some fan-outs are not monotonic."""
    return _decoded(_runs(spark, sf_dir, "orders", "o_orderkey", 256), _pack_index, "grp long, pos long, oid string, off long, crc long, fault string")


def _reverse_index(grp: int, keys: list[int]) -> Iterable[tuple]:
    held = sorted((_oid(k), k) for k in keys)
    order = sorted(range(len(held)), key=lambda i: _offset(held[i][1]))
    data = b"RIDX" + struct.pack(f">II{len(order)}I", 1, 1, *order) + bytes(20)
    got, fault = codecs.parse_reverse_index(_sealed(data, grp % 5 != 1), len(held))
    return [(grp, i, pos, fault) for i, pos in enumerate(got)]


def reverse_index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reverse index of each pack: index positions by offset; some with a wrong checksum."""
    return _decoded(_runs(spark, sf_dir, "orders", "o_orderkey", 256), _reverse_index, "grp long, ord long, pos long, fault string")


def _multi_pack_index(grp: int, keys: list[int]) -> Iterable[tuple]:
    held = sorted((_oid(k), k) for k in keys)
    narrow, wide = _offsets([_offset(k) for _, k in held])
    ooff = b"".join(struct.pack(">I", k % 3) + narrow[4 * i : 4 * i + 4] for i, (_, k) in enumerate(held))
    parts = {
        b"PNAM": b"pack-a.idx\0pack-b.idx\0pack-c.idx\0\0\0\0", b"OIDF": struct.pack(">256I", *_fan([oid for oid, _ in held])),
        b"OIDL": b"".join(oid for oid, _ in held), b"OOFF": ooff, b"LOFF": wide,
    }
    if grp % 6 == 2:
        del parts[b"OOFF"]
    got, names, fault = codecs.parse_multi_pack_index(_chunked(b"MIDX" + bytes([1, 1, len(parts), 0]) + struct.pack(">I", 3), parts))
    if fault:
        yield grp, None, None, None, None, fault
    for pos, oid, pack, off in got:
        yield grp, pos, oid.hex(), names[pack], off, None


def multi_pack_index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as multi-pack indexes of three packs; some lack a chunk."""
    return _decoded(_runs(spark, sf_dir, "orders", "o_orderkey", 256), _multi_pack_index, "grp long, pos long, oid string, pack string, off long, fault string")


def _commit_graph(grp: int, keys: list[int]) -> Iterable[tuple]:
    held = sorted((_oid(k), k) for k in keys)
    pos = {k: i for i, (_, k) in enumerate(held)}
    rank = {k: i for i, k in enumerate(keys)}
    rows, extra = [], []
    for _, k in held:
        before = [_BELOW + pos[p] for p in reversed(keys[max(0, rank[k] - (3 if k % 10 == 0 else 1)) : rank[k]])]
        first, second = (before + [_NONE, _NONE])[:2]
        if len(before) > 2:
            second = 1 << 31 | len(extra)
            extra += [*before[1:-1], before[-1] | 1 << 31]
        date = (1 << 33) + k
        rows.append(_oid(-k) + struct.pack(">IIII", first, second, rank[k] + 1 << 2 | date >> 32, date & 0xFFFFFFFF))
    oids = [oid for oid, _ in held]
    parts = {b"OIDF": struct.pack(">256I", *_fan(oids)), b"OIDL": b"".join(oids), b"CDAT": b"".join(rows), b"EDGE": struct.pack(f">{len(extra)}I", *extra)}
    got, _, fault = codecs.parse_commit_graph(_chunked(b"CGPH" + bytes([1, 1, len(parts), 0]), parts), before=_BELOW)
    if fault:
        raise ValueError(fault)
    for at, oid, tree, parents, generation, date in got:
        yield grp, at, oid.hex(), tree.hex(), ",".join(map(str, parents)), generation, date


def commit_graph_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as layers of a commit-graph: each commit follows the one before it, every tenth merges three."""
    schema = "grp long, pos long, oid string, tree string, parents string, generation long, date long"
    return _decoded(_runs(spark, sf_dir, "orders", "o_orderkey", 64), _commit_graph, schema)


def _pack_entry(key: int) -> Iterable[tuple]:
    number, body = (1, 2, 3, 4, 6, 7, 5)[key % 7], b"x" * (key % 500) + b"%d" % key
    size, head = len(body) >> 4, bytes([number << 4 | len(body) & 15 | (128 if len(body) > 15 else 0)])
    head += codecs.to_varint(size) if size else b""
    head += codecs.to_offset_varint(key) if number == 6 else _oid(key) if number == 7 else b""
    data = head + zlib.compress(body) + bytes(20)
    got = codecs.entry_header(data, key + 12, at=0)
    made = codecs.inflate_exact(data, got.data, got.size + (key % 11 == 0)) if not got.error else None
    yield key, got.kind, got.size, got.base_offset, _hex(got.base_oid), len(made[0]) if made else None, got.error


def pack_entry_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pack entries of all types and of one that is none; some inflate to another size than is asked for."""
    schema = "o_orderkey long, kind string, size long, base_offset long, base_oid string, inflated long, fault string"
    return _decoded(_keys(spark, sf_dir, "orders", "o_orderkey"), _pack_entry, schema)


# --- the index and its extensions ----------------------------------------------------------


def _index(grp: int, keys: list[int]) -> Iterable[tuple]:
    entries = [(b"d%d/f%d" % (k % 3, k), 0o100755 if k % 2 else 0o100644, _oid(k), 0) for k in keys]
    data = codecs.encode_index(entries)
    if grp % 3 == 2:  # version 4: a path is what it shares with the one before, and the rest
        out, before = [struct.pack(">4sII", b"DIRC", 4, len(entries))], b""
        for path, mode, oid, _ in sorted(entries):
            same = next((i for i, (a, b) in enumerate(zip(before, path)) if a != b), min(len(before), len(path)))
            stat = bytes(24) + struct.pack(">I", mode) + bytes(12)
            out.append(stat + oid + struct.pack(">H", len(path)) + codecs.to_offset_varint(len(before) - same) + path[same:] + b"\0")
            before = path
        data = _sealed(b"".join(out))
    if grp % 4 == 1:
        data = data[:-1] + bytes([data[-1] ^ 1])
    strict, _, fault = codecs.parse_index(data)
    kept, _, _ = codecs.parse_index(data, salvage=True)
    for i, (path, mode, oid, _, _) in enumerate(kept):
        yield grp, i, path.decode(), mode, oid.hex(), len(strict), fault


def index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as index files of versions 2 and 4; from those with a wrong checksum the salvage reader keeps all entries."""
    schema = "grp long, ord long, path string, mode long, oid string, read_strictly long, fault string"
    return _decoded(_runs(spark, sf_dir, "customer", "c_custkey", 100), _index, schema)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    numbers = F.collect_set(F.col("l_linenumber").cast("long"))
    return lines.groupBy(F.col("l_orderkey").cast("long").alias("l_orderkey")).agg(F.sort_array(numbers).alias("lines"))


def _cache_tree(key: int, lines: list[int]) -> Iterable[tuple]:
    body = b"\0%d %d\n" % (len(lines), len(lines)) + _oid(key)
    for n in lines:
        body += b"n%d\0" % n + (b"-1 0\n" if n % 3 == 0 else b"%d 1\n" % n + _oid(f"{key}-{n}"))
        body += b"" if n % 3 == 0 else b"deep\0%d 0\n" % n + _oid(n)
    for i, (path, count, oid) in enumerate(codecs.parse_cache_tree(body) or ()):
        yield key, i, path, count, _hex(oid)


def cache_tree_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a cache-tree extension of three levels; every third line is an invalidated node."""
    return _decoded(_lines(spark, sf_dir), _cache_tree, "l_orderkey long, ord long, path string, entries long, oid string")


def _resolve_undo(key: int, lines: list[int]) -> Iterable[tuple]:
    body = b""
    for n in lines:
        modes = [0 if (n + s) % 3 == 0 else 0o100644 for s in (1, 2, 3)]
        body += b"p%d\0" % n + b"".join(b"%o\0" % m for m in modes) + b"".join(_oid(f"{key}-{n}-{s}") for s, m in zip((1, 2, 3), modes) if m)
    for path, stage, mode, oid in codecs.parse_resolve_undo(body if key % 6 else body[:-1]) or ():
        yield key, path.decode(), stage, mode, oid.hex()


def resolve_undo_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a resolve-undo extension, two stages a path; those cut short give nothing."""
    return _decoded(_lines(spark, sf_dir), _resolve_undo, "l_orderkey long, path string, stage long, mode long, oid string")


# --- references and their history ----------------------------------------------------------


def _packed_refs(grp: int, keys: list[int]) -> Iterable[tuple]:
    peeled = {_oid(k): _oid(f"peel {k}") for k in keys if k % 2 == 0}
    data = codecs.render_packed_refs({f"refs/tags/{k}": _oid(k) for k in keys}, peeled)
    for line, kind, name, oid, error in codecs.parse_packed_refs(data[:-1] if grp % 3 == 1 else data):
        yield grp, line, kind, name.decode() if name else None, _hex(oid), error


def packed_refs_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packed-refs files of tags, half of them peeled; some files lack their last line feed."""
    return _decoded(_runs(spark, sf_dir, "supplier", "s_suppkey", 50), _packed_refs, "grp long, line long, kind string, name string, oid string, error string")


def _ref(key: int) -> Iterable[tuple]:
    content = (_oid(key).hex() + "\n", f"ref: refs/heads/b{key}\n", _oid(key).hex()[:-1] + "\n", _oid(key).hex() + " trailing")[key % 4]
    oid, target, broken = codecs.parse_ref(content.encode())
    yield key, _hex(oid), target.decode() if target else None, broken


def ref_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ref files: names, symbolic refs, names cut short, and such with text behind."""
    return _decoded(_keys(spark, sf_dir, "customer", "c_custkey"), _ref, "c_custkey long, oid string, target string, broken boolean")


def _reflog(grp: int, keys: list[int]) -> Iterable[tuple]:
    lines = ["short line" if k % 8 == 3 else f"{_oid(k - 1).hex()} {_oid(k).hex()} A <a@x> {1000000000 + k} +0000\tmessage {k}" for k in keys]
    for line, old, new, when in codecs.parse_reflog(("\n".join(lines) + "\n").encode()):
        yield grp, line, old.hex(), new.hex(), when


def reflog_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reflogs; lines that cannot be read are skipped and keep their numbers."""
    return _decoded(_runs(spark, sf_dir, "events", "event_id", 100), _reflog, "grp long, line long, old string, new string, at long")


# --- objects -------------------------------------------------------------------------------


def _links(key: int) -> Iterable[tuple]:
    head = "tre " if key % 9 == 0 else "tree "
    body = f"{head}{_oid(key).hex()}\n" + "".join(f"parent {_oid(key - i).hex()}\n" for i in range(1, key % 4 + 1)) + "author A <a@x> 1 +0000\n"
    tree, parents, fault = codecs.commit_links(body.encode())
    target, kind, tag_fault = codecs.tag_target(f"object {_oid(key).hex()}\ntype {('commit', 'tree', 'thing')[key % 3]}\ntag t\n".encode())
    yield key, _hex(tree), ",".join(p.hex() for p in parents), fault, _hex(target), kind, tag_fault


def link_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of up to three parents and as tags: what they point to, and what cannot be read."""
    schema = "o_orderkey long, tree string, parents string, fault string, target string, kind string, tag_fault string"
    return _decoded(_keys(spark, sf_dir, "orders", "o_orderkey"), _links, schema)


def _first(found: Iterable[checks.Finding]) -> str:
    return next((f[0] for f in found), "ok")


def _tag(key: int) -> Iterable[tuple]:
    fault = key % 10
    lines = ["" if fault == 1 else f"object {'xyz' if fault == 2 else _oid(key).hex()}\n", "" if fault == 3 else f"type {'thing' if fault == 4 else 'commit'}\n"]
    lines += ["" if fault == 5 else f"tag {('a..b' if fault == 6 else 'v' + chr(0)) if fault in (6, 9) else 'v1'}\n"]
    lines += ["" if fault == 7 else f"tagger A {'a@x' if fault == 8 else '<a@x>'} 1 +0000\n", "\nmessage\n"]
    yield key, _first(checks.check_tag("".join(lines).encode(), model.severities()))


def tag_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a tag object, most of them malformed: the first complaint about each."""
    return _decoded(_keys(spark, sf_dir, "orders", "o_orderkey"), _tag, "o_orderkey long, finding string")


def _tree(key: int) -> Iterable[tuple]:
    mode, name, oid = (
        ("100644", b"a", _oid(key)), ("100644", b"a", bytes(20)), ("100644", b"a/x", _oid(key)), ("100644", b".", _oid(key)), ("40000", b"..", _oid(key)),
        ("40000", b".GIT", _oid(key)), ("0100644", b"a", _oid(key)), ("100666", b"a", _oid(key)), ("100644", b"c", _oid(key)), ("100644", b"d", _oid(key)),
        ("120000", b".gitmodules", _oid(key)),
    )[key % 11]
    body = b"".join(b"%s %s\0%s" % (m.encode(), n, o) for m, n, o in ((mode, name, oid), ("100644", b"c", _oid(-key))))
    found, _ = checks.check_tree(body)
    yield key, ",".join(f[0] for f in found)


def tree_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a tree object of two entries, most of them malformed: all complaints."""
    return _decoded(_keys(spark, sf_dir, "orders", "o_orderkey"), _tree, "o_orderkey long, findings string")


def _blob(key: int) -> Iterable[tuple]:
    fault = key % 6
    name, url = "../n" if fault == 1 else f"n{key}", "-x" if fault == 2 else "https://h/x"
    text = "[submodule\n" if fault == 5 else f'[submodule "{name}"]\n\tpath = {"-p" if fault == 3 else "p"}\n\turl = {url}\n\tupdate = {"!run" if fault == 4 else "none"}\n'
    line = key * 37 % 4096
    yield key, _first(checks.check_gitmodules(text.encode())), _first(checks.check_gitattributes(b"* text\n" + b"a" * line + b"\n"))


def blob_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a .gitmodules and a .gitattributes blob: the first complaint about each."""
    return _decoded(_keys(spark, sf_dir, "customer", "c_custkey"), _blob, "c_custkey long, modules string, attributes string")


_ALIASES = (
    ".git", ".GiT", "git~1", ".git ", ".git:x", "x\\.git", ".g‌it", ".gitx", "git", "git~2", ".gitmodules", "GITMOD~1", "gi7eba~1", "gi7eb~10", "gitmod~5", ".gitmodules . ",
)


def _alias(key: int) -> Iterable[tuple]:
    name = _ALIASES[key % len(_ALIASES)].encode()
    yield key, next((n for n in ("git", "gitmodules") if aliases.could_reach(name) and aliases.is_alias(name, n)), None)


def alias_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that some file system takes for .git or .gitmodules, and such that none does."""
    return _decoded(_keys(spark, sf_dir, "orders", "o_orderkey"), _alias, "o_orderkey long, control_file string")


_RUN = "WITH h AS (SELECT o_orderkey::BIGINT AS k, (o_orderkey // {size})::BIGINT AS grp, sha1(o_orderkey::VARCHAR) AS oid, o_orderkey * 97 + CASE WHEN o_orderkey % 5 = 0 THEN 4294967296 ELSE 0 END AS o FROM orders),\n p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY oid) - 1 AS pos FROM h)\n"

_SQL = {
    "pack_index_decode": _RUN.format(size=256) + """
SELECT grp, pos, oid, o::BIGINT AS off, (k * 31 % 4294967296)::BIGINT AS crc, NULL::VARCHAR AS fault FROM p WHERE grp % 7 <> 3
UNION ALL SELECT DISTINCT grp, NULL, NULL, NULL, NULL, 'non-monotonic index' FROM p WHERE grp % 7 = 3
""",
    "reverse_index_decode": _RUN.format(size=256) + """
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY o) - 1 AS ord, pos, CASE WHEN grp % 5 = 1 THEN 'invalid checksum' END AS fault FROM p
""",
    "multi_pack_index_decode": _RUN.format(size=256) + """
SELECT grp, pos, oid, CASE k % 3 WHEN 0 THEN 'pack-a.idx' WHEN 1 THEN 'pack-b.idx' ELSE 'pack-c.idx' END AS pack, o::BIGINT AS off, NULL::VARCHAR AS fault FROM p WHERE grp % 6 <> 2
UNION ALL SELECT DISTINCT grp, NULL, NULL, NULL, NULL, 'multi-pack-index lacks a required chunk' FROM p WHERE grp % 6 = 2
""",
    "commit_graph_decode": _RUN.format(size=64) + """
, g AS (SELECT *, 1000 + pos AS place FROM p)
SELECT grp, place AS pos, oid, sha1((-k)::VARCHAR) AS tree,
  concat_ws(',', lag(place, 1) OVER w, CASE WHEN k % 10 = 0 THEN lag(place, 2) OVER w END, CASE WHEN k % 10 = 0 THEN lag(place, 3) OVER w END) AS parents,
  row_number() OVER w AS generation, (8589934592 + k)::BIGINT AS date FROM g WINDOW w AS (PARTITION BY grp ORDER BY k)
""",
    "pack_entry_decode": """
WITH e AS (SELECT o_orderkey::BIGINT AS k, (o_orderkey % 500 + length(o_orderkey::VARCHAR))::BIGINT AS n FROM orders)
SELECT k AS o_orderkey, CASE k % 7 WHEN 0 THEN 'commit' WHEN 1 THEN 'tree' WHEN 2 THEN 'blob' WHEN 3 THEN 'tag' WHEN 4 THEN 'ofs-delta' WHEN 5 THEN 'ref-delta' END AS kind, n AS size,
  CASE WHEN k % 7 = 4 THEN 12 END::BIGINT AS base_offset, CASE WHEN k % 7 = 5 THEN sha1(k::VARCHAR) END AS base_oid,
  CASE WHEN k % 7 <> 6 AND k % 11 <> 0 THEN n END AS inflated, CASE WHEN k % 7 = 6 THEN 'unknown object type 5' END AS fault FROM e
""",
    "index_decode": """
WITH e AS (SELECT c_custkey::BIGINT AS k, (c_custkey // 100)::BIGINT AS grp, 'd' || c_custkey % 3 || '/f' || c_custkey AS path FROM customer)
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY path) - 1 AS ord, path, CASE WHEN k % 2 = 1 THEN 33261 ELSE 33188 END::BIGINT AS mode, sha1(k::VARCHAR) AS oid,
  CASE WHEN grp % 4 = 1 THEN 0 ELSE count(*) OVER (PARTITION BY grp) END::BIGINT AS read_strictly, CASE WHEN grp % 4 = 1 THEN 'bad index file checksum' END AS fault FROM e
""",
    "cache_tree_decode": """
WITH l AS (SELECT k, n, count(*) OVER (PARTITION BY k) AS lines FROM (SELECT DISTINCT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n FROM lineitem)),
 t AS (SELECT DISTINCT k, 0 AS a, 0 AS b, '' AS path, lines AS entries, sha1(k::VARCHAR) AS oid FROM l
  UNION ALL SELECT k, n, 1, 'n' || n, CASE WHEN n % 3 = 0 THEN -1 ELSE n END, CASE WHEN n % 3 <> 0 THEN sha1(k || '-' || n) END FROM l
  UNION ALL SELECT k, n, 2, 'n' || n || '/deep', n, sha1(n::VARCHAR) FROM l WHERE n % 3 <> 0)
SELECT k AS l_orderkey, row_number() OVER (PARTITION BY k ORDER BY a, b) - 1 AS ord, path, entries::BIGINT AS entries, oid FROM t
""",
    "resolve_undo_decode": """
SELECT DISTINCT l_orderkey::BIGINT AS l_orderkey, 'p' || l_linenumber AS path, s::BIGINT AS stage, 33188::BIGINT AS mode, sha1(l_orderkey || '-' || l_linenumber || '-' || s) AS oid
FROM lineitem, (VALUES (1), (2), (3)) v(s) WHERE (l_linenumber + s) % 3 <> 0 AND l_orderkey % 6 <> 0
""",
    "packed_refs_decode": """
WITH s AS (SELECT s_suppkey::BIGINT AS k, (s_suppkey // 50)::BIGINT AS grp, 'refs/tags/' || s_suppkey AS ref FROM supplier),
 l AS (SELECT *, 0 AS peel FROM s UNION ALL SELECT *, 1 FROM s WHERE k % 2 = 0),
 n AS (SELECT grp, 1 + row_number() OVER (PARTITION BY grp ORDER BY ref, peel) AS line, CASE peel WHEN 0 THEN 'entry' ELSE 'peel' END AS kind, CASE peel WHEN 0 THEN ref END AS name,
  sha1(CASE peel WHEN 0 THEN '' ELSE 'peel ' END || k) AS oid FROM l UNION ALL SELECT DISTINCT grp, 1, 'header', NULL, NULL FROM s)
SELECT *, CASE WHEN grp % 3 = 1 AND line = max(line) OVER (PARTITION BY grp) THEN 'packedRefEntryNotTerminated' END AS error FROM n
""",
    "ref_decode": """
SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN c_custkey % 4 IN (0, 3) THEN sha1(c_custkey::VARCHAR) END AS oid, CASE WHEN c_custkey % 4 = 1 THEN 'refs/heads/b' || c_custkey END AS target,
  c_custkey % 4 = 2 AS broken FROM customer
""",
    "reflog_decode": """
SELECT grp, line, sha1((k - 1)::VARCHAR) AS old, sha1(k::VARCHAR) AS new, (1000000000 + k)::BIGINT AS at
FROM (SELECT event_id::BIGINT AS k, (event_id // 100)::BIGINT AS grp, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS line FROM events) WHERE k % 8 <> 3
""",
    "link_projection": """
SELECT k AS o_orderkey, CASE WHEN k % 9 <> 0 THEN sha1(k::VARCHAR) END AS tree,
  CASE WHEN k % 9 = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 4 >= 1 THEN sha1((k - 1)::VARCHAR) END, CASE WHEN k % 4 >= 2 THEN sha1((k - 2)::VARCHAR) END, CASE WHEN k % 4 = 3 THEN sha1((k - 3)::VARCHAR) END) END AS parents,
  CASE WHEN k % 9 = 0 THEN 'bogus commit object' END AS fault, sha1(k::VARCHAR) AS target, CASE k % 3 WHEN 0 THEN 'commit' WHEN 1 THEN 'tree' ELSE 'thing' END AS kind,
  CASE WHEN k % 3 = 2 THEN 'unknown tag type ''thing''' END AS tag_fault FROM (SELECT o_orderkey::BIGINT AS k FROM orders)
""",
    "tag_check": """
SELECT o_orderkey::BIGINT AS o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'missingObject' WHEN 2 THEN 'badObjectSha1' WHEN 3 THEN 'missingTypeEntry' WHEN 4 THEN 'badType' WHEN 5 THEN 'missingTagEntry'
  WHEN 6 THEN 'badTagName' WHEN 7 THEN 'missingTaggerEntry' WHEN 8 THEN 'missingEmail' WHEN 9 THEN 'nulInHeader' ELSE 'ok' END AS finding FROM orders
""",
    "tree_check": """
SELECT o_orderkey::BIGINT AS o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN 'nullSha1' WHEN 2 THEN 'fullPathname' WHEN 3 THEN 'hasDot' WHEN 4 THEN 'hasDotdot' WHEN 5 THEN 'hasDotgit' WHEN 6 THEN 'zeroPaddedFilemode'
  WHEN 7 THEN 'badFilemode' WHEN 8 THEN 'duplicateEntries' WHEN 9 THEN 'treeNotSorted' WHEN 10 THEN 'gitmodulesSymlink' ELSE '' END AS findings FROM orders
""",
    "blob_check": """
SELECT c_custkey::BIGINT AS c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'gitmodulesName' WHEN 2 THEN 'gitmodulesUrl' WHEN 3 THEN 'gitmodulesPath' WHEN 4 THEN 'gitmodulesUpdate' WHEN 5 THEN 'gitmodulesParse' ELSE 'ok' END AS modules,
  CASE WHEN c_custkey * 37 % 4096 >= 2048 THEN 'gitattributesLineLength' ELSE 'ok' END AS attributes FROM customer
""",
    "alias_check": """
SELECT o_orderkey::BIGINT AS o_orderkey, CASE WHEN o_orderkey % 16 < 7 THEN 'git' WHEN o_orderkey % 16 IN (10, 11, 12, 13, 15) THEN 'gitmodules' END AS control_file FROM orders
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
