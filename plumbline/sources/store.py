"""An object store on disk as DataFrames: loose objects, packs, refs, reflogs, the index, configuration.

Paths must be readable where the tasks run.  Listing is done on the driver (a store has a
few thousand directories at most), decoding in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.shared import ship, written
from plumbline.sources import codecs

OBJECTS = "oid binary, typ string, size long, body binary, source string, errors array<string>, failed boolean"
_SCHEMA = pa.schema(
    [("oid", pa.binary()), ("typ", pa.string()), ("size", pa.int64()), ("body", pa.binary()), ("source", pa.string())]
    + [("errors", pa.list_(pa.string())), ("failed", pa.bool_())]
)


def discover(start: str) -> str:
    """The store's directory: start or a parent of it that holds .git (a directory, or a file that names one) or is bare."""
    at = Path(start).resolve()
    for p in (at, *at.parents):
        git = p / ".git"
        if git.is_dir():
            return str(git)
        if git.is_file() and (m := re.match(r"gitdir: (.+?)\n?$", git.read_text())):
            return str((p / m[1]).resolve())
        if (p / "objects").is_dir() and (p / "refs").is_dir() and (p / "HEAD").is_file():
            return str(p)
    raise FileNotFoundError(f"no object store at or above {start}")


def object_dirs(git_dir: str, depth: int = 5) -> list[str]:
    """The object directory and its alternates, each once, five levels deep at most."""
    seen: list[str] = []

    def visit(path: str, level: int) -> None:
        path = os.path.realpath(path)
        if path in seen or level > depth or not os.path.isdir(path):
            return
        seen.append(path)
        try:
            lines = Path(path, "info", "alternates").read_text().splitlines()
        except OSError:
            return
        for line in lines:
            if line and not line.startswith("#"):
                visit(os.path.join(path, codecs.unquote_c(line) or line), level + 1)

    visit(os.path.join(git_dir, "objects"), 0)
    return seen


def _decode_loose(batches: Iterator[pa.RecordBatch], hash_size: int, big: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            m = re.search(r"/([0-9a-f]{2})/([0-9a-f]+)$", path)
            name = bytes.fromhex(m[1] + m[2])
            o = codecs.decode_loose(content.as_py(), name, hash_size, big)
            rows.append((name, o.kind, o.size, None if o.failed else o.body, path, o.errors, o.failed))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _SCHEMA)], schema=_SCHEMA)


def loose_files(spark: SparkSession, dirs: list[str], hash_size: int = 20) -> DataFrame:
    """(path, content) of the files whose names are whole object names; contents are read only where they are used."""
    files = [f"{d}/??/*" for d in dirs if any(len(x) == 2 and os.listdir(os.path.join(d, x)) for x in os.listdir(d) if os.path.isdir(os.path.join(d, x)))]
    if not files:
        return spark.createDataFrame([], "path string, content binary")
    found = spark.read.format("binaryFile").load(files).select("path", "content")
    return found.where(F.col("path").rlike(f"/[0-9a-f]{{2}}/[0-9a-f]{{{2 * hash_size - 2}}}$"))


def loose(spark: SparkSession, dirs: list[str], hash_size: int = 20, big: int = 512 << 20) -> DataFrame:
    """Loose objects, decoded and hashed: one row a file."""
    ship(spark)
    return loose_files(spark, dirs, hash_size).mapInArrow(lambda b: _decode_loose(b, hash_size, big), OBJECTS)


def loose_cruft(dirs: list[str], hash_size: int = 20) -> list[str]:
    """Files among loose objects that are none; temporary ones are passed over."""
    out = []
    for d in dirs:
        for fan in sorted(x for x in os.listdir(d) if re.fullmatch("[0-9a-f]{2}", x)):
            out += [f"{d}/{fan}/{n}" for n in sorted(os.listdir(f"{d}/{fan}")) if not re.fullmatch(f"[0-9a-f]{{{2 * hash_size - 2}}}", n) and not n.startswith("tmp_obj_")]
    return out


class PackIndexSource(DataSource):
    """spark.read.format("packidx"): the rows of pack indexes, one partition for each pack and range of entries."""

    @classmethod
    def name(cls) -> str:
        return "packidx"

    def schema(self) -> str:
        return "pack string, pos long, oid binary, off long, crc long, end long, error string"

    def reader(self, schema) -> "PackIndexReader":
        return PackIndexReader(self.options.get("paths", "").split("\n"), int(self.options.get("hashSize", 20)))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PackIndexReader(DataSourceReader):
    def __init__(self, paths: list[str], hash_size: int):
        self.paths, self.hash_size = [p for p in paths if p], hash_size

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["pack", "pos", "oid", "off", "crc", "end", "error"]
        if not partition.path:
            return
        pack = partition.path.removesuffix(".idx") + ".pack"
        with open(partition.path, "rb") as f:
            rows, error = codecs.parse_pack_index(f.read(), self.hash_size)
        if error or not os.path.exists(pack):
            row = [pack, None, None, None, None, None, error or "packfile is missing"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)
            return
        trailer = os.path.getsize(pack) - self.hash_size
        order = sorted(range(len(rows)), key=lambda i: rows[i][1])
        end = {i: (rows[j][1] if j is not None else trailer) for i, j in zip(order, [*order[1:], None])}
        for k in range(0, len(rows), 50_000):
            part = range(k, min(k + 50_000, len(rows)))
            columns = [[pack] * len(part), list(part), [rows[i][0] for i in part], [rows[i][1] for i in part], [rows[i][2] for i in part], [end[i] for i in part], [None] * len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def pack_index(spark: SparkSession, dirs: list[str], hash_size: int = 20) -> DataFrame:
    """pack, pos, oid, off, crc, end (the next entry's offset): every pack's index rows; one row with an error for a pack that cannot be opened."""
    ship(spark)
    spark.dataSource.register(PackIndexSource)
    paths = sorted(str(p) for d in dirs for p in Path(d, "pack").glob("*.idx"))
    return spark.read.format("packidx").option("paths", "\n".join(paths)).option("hashSize", hash_size).load()


ENTRIES = "pack string, pos long, oid binary, off long, kind string, size long, base_off long, base_oid binary, data binary, crc_ok boolean, error string"


def _decode_entries(batches: Iterator[pa.RecordBatch], hash_size: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    handles: dict[str, object] = {}
    for batch in batches:
        rows, held = [], 0
        for pack, pos, oid, off, crc, end in zip(*(batch.column(i).to_pylist() for i in range(6))):
            f = handles.get(pack) or handles.setdefault(pack, open(pack, "rb"))
            f.seek(max(off, 0))
            raw = f.read(max(0, end - off)) if off >= 12 else b""
            head = codecs.entry_header(raw, off, hash_size, at=0)
            error, data = head.error, None
            if not error:
                got = codecs.inflate_exact(raw, head.data, head.size)
                error, data = (None, got[0]) if got and got[1] == len(raw) else ("inflate failed", None)
            rows.append((pack, pos, oid, off, head.kind, head.size, head.base_offset, head.base_oid, data, crc is None or zlib.crc32(raw) == crc, error))
            held += len(data or b"")
            if held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def pack_entries(index: DataFrame, hash_size: int = 20) -> DataFrame:
    """The entries of packs, inflated; deltas as they stand.  Rows are dealt anew, so one large pack occupies all tasks."""
    rows = index.where("error is null").select("pack", "pos", "oid", "off", "crc", "end").repartition("pack", F.floor(F.col("off") / (1 << 20)))
    return rows.mapInArrow(lambda b: _decode_entries(b, hash_size), ENTRIES)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [codecs.apply_delta(b.as_py(), d.as_py()) for b, d in zip(batch.column("base_body"), batch.column("data"))]
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("base_body", "data")]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(out, pa.binary())], names=[batch.schema.names[i] for i in keep] + ["body"])


def packed(index: DataFrame, hash_size: int = 20) -> DataFrame:
    """Packed objects with their deltas applied, level by level from the full entries; each hashed against its name.

    A base is an entry of the same pack, by offset or by name.  What never meets a base,
    or does not apply, is a failed row.
    """
    entries = written(pack_entries(index, hash_size), "entries")
    bases = entries.select("pack", F.col("off").alias("_o"), F.col("oid").alias("_n"))
    delta = entries.where("error is null and kind in ('ofs-delta', 'ref-delta')").select("pack", "off", "oid", "data", "base_off", "base_oid")
    by_name = delta.where("base_off is null").join(bases.select("pack", F.col("_n").alias("base_oid"), F.col("_o")), ["pack", "base_oid"], "left")
    by_name = by_name.select("pack", "off", "oid", "data", F.col("_o").alias("base_off"))
    delta = written(delta.where("base_off is not null").select("pack", "off", "oid", "data", "base_off").unionByName(by_name), "deltas")
    done = entries.where(F.col("error").isNull() & F.col("kind").isin(*codecs.REAL_TYPES)).select("pack", "off", "oid", F.col("kind").alias("typ"), F.col("data").alias("body"))
    level, all_ = done, done
    while True:  # a level is of entries not met before, so this ends
        ready = delta.join(level.select("pack", F.col("off").alias("base_off"), "typ", F.col("body").alias("base_body")), ["pack", "base_off"])
        ready = ready.where("base_body is not null").select("pack", "off", "oid", "typ", "base_body", "data")
        level = written(ready.mapInArrow(_apply, "pack string, off long, oid binary, typ string, body binary"), "level")
        if level.isEmpty():
            break
        all_ = all_.unionByName(level)
    framed = F.concat(F.concat(F.col("typ"), F.lit(" "), F.octet_length("body").cast("string")).cast("binary"), F.unhex(F.lit("00")), F.col("body"))
    digest = F.sha1(framed) if hash_size == 20 else F.sha2(framed, 256)
    whole = entries.select("pack", "off", "oid", "crc_ok", "error").join(all_.drop("oid"), ["pack", "off"], "left")
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("body").isNull(), F.lit("delta cannot be resolved"))
        .when(digest != F.lower(F.hex("oid")), F.lit("hash mismatch"))
        .when(~F.col("crc_ok"), F.lit("index CRC mismatch"))
    )
    return whole.select(
        "oid", "typ", F.octet_length("body").cast("long").alias("size"), "body", F.col("pack").alias("source"),
        F.array_compact(F.array(fault)).alias("errors"), fault.isNotNull().alias("failed"),
    )


def file_checksum(path: str, hash_size: int = 20) -> bool:
    """Whether a file's last bytes are the digest of the rest; read in pieces of 1 MiB."""
    h, left = codecs.new_hash(hash_size), os.path.getsize(path) - hash_size
    if left < 0:
        return False
    with open(path, "rb") as f:
        while left:
            part = f.read(min(1 << 20, left))
            h.update(part)
            left -= len(part)
        return f.read() == h.digest()


def pack_faults(dirs: list[str], hash_size: int = 20) -> list[tuple[str, str]]:
    """Faults of whole pack files: header, count, checksums of pack and index, and the pack's checksum in the index."""
    out = []
    for idx in sorted(str(p) for d in dirs for p in Path(d, "pack").glob("*.idx")):
        pack = idx.removesuffix(".idx") + ".pack"
        data = Path(idx).read_bytes()
        rows, error = codecs.parse_pack_index(data, hash_size)
        if error:
            out.append((idx, error))
            continue
        if not file_checksum(idx, hash_size):
            out.append((idx, "index checksum mismatch"))
        try:
            with open(pack, "rb") as f:
                head = f.read(12)
                f.seek(-hash_size, os.SEEK_END)
                trailer = f.read()
        except OSError as e:
            out.append((pack, f"cannot be opened: {type(e).__name__}"))
            continue
        if head[:4] != b"PACK" or int.from_bytes(head[4:8], "big") not in (2, 3):
            out.append((pack, "bad pack header"))
        elif int.from_bytes(head[8:12], "big") != len(rows):
            out.append((pack, "pack and index count objects differently"))
        if trailer != data[-2 * hash_size : -hash_size]:
            out.append((pack, "pack checksum differs from the index's copy"))
        elif not file_checksum(pack, hash_size):
            out.append((pack, "pack checksum mismatch"))
    return out


def refs(git_dir: str, hash_size: int = 20) -> list[tuple[str, bytes | None, str | None, bool]]:
    """(name, oid, symref, broken): packed refs overlaid by loose ones, sorted; lock files and dot files are passed over."""
    table: dict[str, tuple] = {}
    packed_refs = Path(git_dir, "packed-refs")
    if packed_refs.is_file():
        for _, kind, name, oid, error in codecs.parse_packed_refs(packed_refs.read_bytes(), hash_size):
            if kind == "entry":
                table[name.decode("latin-1")] = (oid, None, False)
    root = Path(git_dir, "refs")
    for p in sorted(root.rglob("*")) if root.is_dir() else []:
        if p.is_file() and not p.name.startswith(".") and not p.name.endswith(".lock"):
            oid, sym, broken = codecs.parse_ref(p.read_bytes(), hash_size)
            table["refs/" + str(p.relative_to(root))] = (oid, sym.decode("latin-1") if sym else None, broken)
    return [(k, *v) for k, v in sorted(table.items())]


def worktrees(git_dir: str) -> list[tuple[str, str]]:
    """(name, directory) of the linked worktrees: those that say where they are."""
    root = Path(git_dir, "worktrees")
    return [(p.name, str(p)) for p in sorted(root.iterdir()) if (p / "gitdir").is_file()] if root.is_dir() else []


def private_refs(worktree_dir: str, hash_size: int = 20) -> list[tuple[str, bytes | None, str | None, bool]]:
    """Refs that each worktree has for itself."""
    out = []
    for part in ("bisect", "rewritten", "worktree"):
        root = Path(worktree_dir, "refs", part)
        for p in sorted(root.rglob("*")) if root.is_dir() else []:
            if p.is_file() and not p.name.startswith(".") and not p.name.endswith(".lock"):
                oid, sym, broken = codecs.parse_ref(p.read_bytes(), hash_size)
                out.append((f"refs/{part}/{p.relative_to(root)}", oid, sym.decode("latin-1") if sym else None, broken))
    return out


def pack_list_stale(objects_dir: str) -> bool:
    """Whether info/packs names a pack that is not there."""
    p = Path(objects_dir, "info", "packs")
    names = [x[2:] for x in p.read_text().splitlines() if x.startswith("P ")] if p.is_file() else []
    return any(not Path(objects_dir, "pack", n).is_file() for n in names)


def resolve_ref(git_dir: str, name: str, hash_size: int = 20, hops: int = 6) -> bytes | None:
    """What a ref stands for after six symbolic hops at most; None if nothing."""
    table = {n: (o, s) for n, o, s, _ in refs(git_dir, hash_size)}
    for _ in range(hops):
        if name not in table:
            path = Path(git_dir, name)
            if not path.is_file():
                return None
            oid, sym, _ = codecs.parse_ref(path.read_bytes(), hash_size)
            table[name] = (oid, sym.decode("latin-1") if sym else None)
        oid, sym = table[name]
        if oid is not None or sym is None:
            return oid
        name = sym
    return None


def reflogs(git_dir: str, hash_size: int = 20) -> list[tuple[str, int, bytes, bytes, int]]:
    """(ref, line, old, new, timestamp) of every readable history line."""
    root = Path(git_dir, "logs")
    out = []
    for p in sorted(root.rglob("*")) if root.is_dir() else []:
        if p.is_file():
            out += [(str(p.relative_to(root)), *row) for row in codecs.parse_reflog(p.read_bytes(), hash_size)]
    return out


def index_entries(git_dir: str, hash_size: int = 20, salvage: bool = False):
    """The index of the main worktree: (path, mode, oid, stage, stat) entries, the claimed count, the fault; none without an index."""
    p = Path(git_dir, "index")
    return codecs.parse_index(p.read_bytes(), hash_size, salvage) if p.is_file() else ([], 0, None)


def config(paths: list[str]) -> list[tuple[int, str, str | None]]:
    """(order, key, value) of configuration files, in order; for a key the last one wins."""
    out = []
    for p in paths:
        if os.path.isfile(p):
            entries, error = codecs.parse_config(Path(p).read_text("utf-8", "surrogateescape"))
            if error:
                raise ValueError(f"{p}: {error}")
            out += [(len(out) + i, k, v) for i, (k, v, _) in enumerate(entries)]
    return out


def hash_size_of(git_dir: str) -> int:
    """20, or 32 where the configuration asks for SHA-256 names."""
    values = {k: v for _, k, v in config([os.path.join(git_dir, "config")])}
    return 32 if (values.get("extensions.objectformat") or "").lower() == "sha256" else 20


def write_loose(objects_dir: str, kind: str, body: bytes, want: bytes) -> bytes:
    """Writes a loose object whose hash is `want`; read-only, by rename, and not at all if it is there."""
    name = codecs.object_id(kind, body, len(want))
    if name != want:
        raise ValueError("content does not hash to its name")
    path = Path(objects_dir, name.hex()[:2], name.hex()[2:])
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        temp = path.with_name("tmp_obj_" + hashlib.sha1(os.urandom(16)).hexdigest()[:12])
        temp.write_bytes(codecs.encode_loose(kind, body))
        os.chmod(temp, 0o444)
        os.rename(temp, path)
    return name


def remote_url(git_dir: str) -> str | None:
    """The url of the remote called origin, else the least url of any; None without one."""
    keyed = [(key, value) for _, key, value in config([os.path.join(git_dir, "config")]) if value and key.startswith("remote.") and key.endswith(".url")]
    return dict(keyed).get("remote.origin.url") or min((value for _, value in keyed), default=None)
