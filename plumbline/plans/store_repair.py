"""Repair of an object store: a plan as a table, and its execution on the driver.

The plan is pure: for every damaged or missing object the copies that could replace it,
ranked, and only those that hash to its name.  Execution writes in the plan's order, one
writer, and deletes nothing: what stands in the way moves to a quarantine with a
manifest, from which undo() brings it back.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import model
from plumbline.functions import checks
from plumbline.operators import graph, links
from plumbline.plans import store_check
from plumbline.shared import written
from plumbline.sources import codecs, store

# The order in which sources of a lost object are tried.
RUNGS = {"other copy": 0, "worktree": 1, "rebuilt tree": 2, "remote": 3}
COMPANIONS = (".pack", ".idx", ".rev", ".bitmap", ".mtimes", ".keep", ".promisor")
CANDIDATES = "oid binary, rung long, typ string, content binary, source string"


def worktree_candidates(git_dir: str, entries, wanted: set[bytes], hash_size: int = 20) -> list[tuple]:
    """Files that the index names for a wanted object."""
    out, top = [], Path(git_dir).parent
    for path, _, oid, _, _ in entries:
        p = top / os.fsdecode(path)
        if oid in wanted and p.is_file() and not p.is_symlink():
            out.append((bytearray(oid), RUNGS["worktree"], "blob", bytearray(p.read_bytes()), str(p)))
    return out


def rebuilt_trees(entries, hash_size: int = 20) -> dict[bytes, bytes]:
    """The tree objects of an index's entries, folded from the deepest directory up: name to body."""
    out: dict[bytes, bytes] = {}
    level: dict[bytes, list[tuple[str, bytes, bytes]]] = {b"": []}
    for path, mode, oid, stage, _ in entries:
        if stage == 0:
            parts = path.split(b"/")
            for i in range(len(parts)):
                level.setdefault(b"/".join(parts[:i]), [])
            level[b"/".join(parts[:-1])].append((f"{mode:o}", parts[-1], oid))
    for directory in sorted(level, key=lambda d: -len(d.split(b"/")) if d else 1):
        body = codecs.encode_tree(level[directory])
        name = codecs.object_id("tree", body, hash_size)
        out[name] = body
        if directory:
            up, _, last = directory.rpartition(b"/")
            level[up].append(("40000", last, name))
    return out


def damaged(spark: SparkSession, path: str, options: model.Options | None = None) -> DataFrame:
    """oid, typ, corrupt, files: objects that are reached or stored and have no good copy."""
    options = options or model.Options()
    git_dir = store.discover(path)
    n = store.hash_size_of(git_dir)
    copies = store_check.objects(spark, git_dir, options)
    best = store_check.best_copies(copies)
    bad = copies.where("failed").groupBy("oid").agg(F.array_sort(F.collect_set("source")).alias("files"), F.first("typ", ignorenulls=True).alias("_typ"))
    edges = store_check.links(best, n).where("dst is not null").groupBy(F.col("dst").alias("oid")).agg(F.min("implied").alias("typ"))
    roots = [(bytearray(o), t) for _, o, t in store_check.roots(git_dir, options, n)]
    wanted = edges.unionByName(spark.createDataFrame(roots, "oid binary, typ string")).groupBy("oid").agg(F.min("typ").alias("typ"))
    lost = wanted.join(bad, "oid", "full_outer").join(best.select("oid"), "oid", "left_anti")
    return lost.select("oid", F.coalesce("typ", "_typ").alias("typ"), F.col("files").isNotNull().alias("corrupt"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def needs(spark: SparkSession, path: str, options: model.Options | None = None) -> DataFrame:
    """oid, wanted_by, name: who asks for each object without a good copy, each route's last step once.

    wanted_by is a root (a ref, HEAD, a reflog, an index entry; name is null) or the name of an
    object that links to it (name is the entry's, if it is a tree).
    """
    options = options or model.Options()
    git_dir = store.discover(path)
    n = store.hash_size_of(git_dir)
    best = store_check.best_copies(store_check.objects(spark, git_dir, options))
    asked = store_check.links(best, n).where("dst is not null").select(F.col("dst").alias("oid"), F.lower(F.hex("src")).alias("wanted_by"), F.col("name").cast("string").alias("name"))
    roots = [(bytearray(o), name, None) for name, o, _ in store_check.roots(git_dir, options, n)]
    asked = asked.unionByName(spark.createDataFrame(roots, "oid binary, wanted_by string, name string"))
    return asked.join(best.select("oid"), "oid", "left_anti").distinct()


def plan(spark: SparkSession, path: str, remote: str | None = None) -> DataFrame:
    """oid, typ, corrupt, files, and the chosen source (null where nothing proves itself): content hashes to the name, lowest rung first.

    remote: another store on this machine whose objects may be used.
    """
    git_dir = store.discover(path)
    n = store.hash_size_of(git_dir)
    lost = damaged(spark, path)
    wanted = {bytes(r["oid"]) for r in lost.select("oid").collect()}
    entries = store.index_entries(git_dir, n, salvage=True)[0]
    rows = worktree_candidates(git_dir, entries, wanted, n)
    rows += [(bytearray(k), RUNGS["rebuilt tree"], "tree", bytearray(v), "index") for k, v in rebuilt_trees(entries, n).items() if k in wanted]
    found = spark.createDataFrame(rows, CANDIDATES)
    if remote:
        far = store_check.best_copies(store_check.objects(spark, store.discover(remote), model.Options())).join(lost.select("oid"), "oid", "left_semi")
        found = found.unionByName(far.select("oid", F.lit(RUNGS["remote"]).cast("long").alias("rung"), "typ", F.col("body").alias("content"), F.lit(remote).alias("source")))
    framed = F.concat(F.concat(F.col("typ"), F.lit(" "), F.octet_length("content").cast("string")).cast("binary"), F.unhex(F.lit("00")), F.col("content"))
    digest = F.sha1(framed) if n == 20 else F.sha2(framed, 256)
    chosen = links.ladder(found, "oid", "rung", digest == F.lower(F.hex("oid")))
    return lost.drop("typ").join(chosen, "oid", "left")


@dataclass
class Quarantine:
    """A run's folder of displaced files, and its manifest."""

    git_dir: str
    run: str = field(default_factory=lambda: time.strftime("%Y%m%d-%H%M%S", time.gmtime()))
    moved: list[dict] = field(default_factory=list)

    @property
    def root(self) -> Path:
        return Path(self.git_dir, "quarantine", self.run)

    def move(self, path: str, why: str) -> None:
        """Sets a file aside; one that is not there is no error.  The manifest is rewritten before the next move."""
        source = Path(path)
        if not source.exists():
            return
        inside = source.is_relative_to(self.git_dir)
        target = self.root / (source.relative_to(self.git_dir) if inside else Path("abs", *source.parts[1:]))
        while target.exists():
            target = target.with_name(target.name + "~")
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.move(str(source), str(target))
        self.moved.append({"from": str(source), "to": str(target), "why": why})
        temp = self.root / "manifest.tmp"
        temp.write_text(json.dumps(self.moved, indent=1))
        os.replace(temp, self.root / "manifest.json")


def runs(git_dir: str) -> list[str]:
    root = Path(git_dir, "quarantine")
    return sorted(p.name for p in root.iterdir() if p.is_dir()) if root.is_dir() else []


def undo(git_dir: str, run: str) -> list[str]:
    """Moves a run's files back, the last first; what has taken a place since moves to replaced/.  What is back already is passed over."""
    root = Path(git_dir, "quarantine", run)
    done = []
    for step in reversed(json.loads((root / "manifest.json").read_text())):
        source, target = Path(step["to"]), Path(step["from"])
        if not source.exists():
            continue
        if target.exists():
            aside = root / "replaced" / source.relative_to(root)
            while aside.exists():
                aside = aside.with_name(aside.name + "~")
            aside.parent.mkdir(parents=True, exist_ok=True)
            shutil.move(str(target), str(aside))
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.move(str(source), str(target))
        done.append(str(target))
    return done


@dataclass
class Result:
    recovered: list[str] = field(default_factory=list)
    unrecovered: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    run: str | None = None
    clean: bool = False

    @property
    def ok(self) -> bool:
        return not self.unrecovered and self.clean


def described(plan_rows: DataFrame) -> DataFrame:
    """A plan as lines: what is wrong with each object, and where it would come from; `would` for the totals."""
    name = F.lower(F.hex("oid"))
    state = F.when(F.col("corrupt"), F.lit("corrupt")).otherwise(F.lit("missing"))
    would = F.col("source").isNotNull()
    how = F.when(would, F.concat(F.lit("would be recovered from "), F.col("source"))).otherwise(F.lit("cannot be recovered"))
    return plan_rows.select(name.alias("oid"), F.concat_ws(" ", state, name, how).alias("line"), would.alias("would"))


def totals(plan_rows: DataFrame) -> DataFrame:
    """How many objects would and would not be recovered."""
    return plan_rows.agg(F.count_if(F.col("source").isNotNull()).alias("would"), F.count_if(F.col("source").isNull()).alias("would_not"))


def newest_good(git_dir: str, name: str, readable: set[bytes], hash_size: int = 20) -> bytes | None:
    """The newest value in a ref's history that can be read."""
    for ref, _, _, new, _ in reversed(store.reflogs(git_dir, hash_size)):
        if ref == name and new in readable:
            return new
    return None


def names_in(line: str) -> list[str]:
    """The ref names that a line which cannot be read may have meant."""
    return [w for w in line.split() if w.startswith("refs/") and checks.refname_ok(w)]


def repair_packed_refs(git_dir: str, q: Quarantine, readable: set[bytes], peeled: dict[bytes, bytes], hash_size: int = 20) -> tuple[list[str], list[str]]:
    """Rewrites packed-refs without its bad lines; the names in those come back from loose refs or history: (restored, lost)."""
    path = Path(git_dir, "packed-refs")
    if not path.is_file():
        return [], []
    data = path.read_bytes()
    rows = codecs.parse_packed_refs(data, hash_size)
    if not any(error == "badPackedRefEntry" for *_, error in rows):
        return [], []
    lines = data.split(b"\n")
    kept = {name.decode("latin-1"): oid for _, kind, name, oid, _ in rows if kind == "entry"}
    restored, lost = [], []
    for line, kind, *_ in rows:
        for name in names_in(lines[line - 1].decode("latin-1")) if kind == "bad" else []:
            loose = Path(git_dir, name)
            value = codecs.parse_ref(loose.read_bytes(), hash_size)[0] if loose.is_file() else None
            value = value or newest_good(git_dir, name, readable, hash_size)
            if name not in kept and value:
                kept[name] = value
                restored.append(name)
            elif name not in kept:
                lost.append(name)
    q.move(str(path), "packed-refs has unreadable lines")
    temp = path.with_name("packed-refs.new")
    temp.write_bytes(codecs.render_packed_refs(kept, peeled))
    os.replace(temp, path)
    return restored, lost


def write_lost_found(spark: SparkSession, path: str) -> list[str]:
    """Writes what nothing links to under lost-found: commits by name, blobs with their content."""
    git_dir = store.discover(path)
    options = model.Options(lost_found=True).normal()
    copies = store_check.best_copies(store_check.objects(spark, git_dir, options))
    loose = store_check.check(spark, path, options).where("msg_id = 'dangling'").select(F.unhex("oid").alias("oid"))
    out = []
    for r in copies.join(loose, "oid", "left_semi").select("oid", "typ", "body").toLocalIterator():
        name = bytes(r["oid"]).hex()
        target = Path(git_dir, "lost-found", "commit" if r["typ"] == "commit" else "other", name)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(bytes(r["body"]) if r["typ"] == "blob" else (name + "\n").encode())
        out.append(str(target))
    return sorted(out)


def peeled_tags(best: DataFrame, hops: int = 10) -> dict[bytes, bytes]:
    """What every tag stands for after ten hops at most."""
    text = F.decode("body", "ISO-8859-1")
    tags = best.where("typ = 'tag'").select(F.col("oid").alias("name"), F.unhex(F.regexp_extract(text, "^object ([0-9a-f]+)", 1)).alias("target"))
    return {bytes(r["name"]): bytes(r["last"]) for r in graph.chase(tags, tags.select("name"), hops).toLocalIterator()}


_ENTRIES = [("tree", pa.binary()), ("name", pa.string()), ("child", pa.binary()), ("mode", pa.int64()), ("is_tree", pa.bool_())]


def _entries(batches: Iterator[pa.RecordBatch], hash_size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for oid, body in zip(*(c.to_pylist() for c in batch.columns)):
            for _, mode, name, child in codecs.parse_tree(body, hash_size)[0]:
                rows.append((oid, name.decode("latin-1"), child, mode, mode & 0o170000 == 0o040000))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 5, _ENTRIES)], names=[n for n, _ in _ENTRIES])


def head_entries(spark: SparkSession, git_dir: str, best: DataFrame, hash_size: int = 20) -> list[tuple[bytes, int, bytes, int]]:
    """(path, mode, oid, stage 0) of every file in the commit that HEAD names; none without a readable one."""
    head = store.resolve_ref(git_dir, "HEAD", hash_size)
    row = best.where((F.col("oid") == F.lit(bytearray(head))) & (F.col("typ") == "commit")).select("body").first() if head else None
    tree = codecs.commit_links(bytes(row[0]), hash_size)[0] if row and row[0] is not None else None
    if tree is None:
        return []
    trees = best.where("typ = 'tree' and body is not null").select("oid", "body")
    entries = trees.mapInArrow(lambda b: _entries(b, hash_size), "tree binary, name string, child binary, mode long, is_tree boolean")
    root = spark.createDataFrame([(bytearray(tree),)], "tree binary")
    found = graph.flatten(written(entries, "treeentries"), root)
    return [(r["path"].encode("latin-1"), r["mode"], bytes(r["child"]), 0) for r in found.toLocalIterator()]


def repair(spark: SparkSession, path: str, remote: str | None = None, passes: int = 50) -> Result:
    """Rebuilds what can be proven, until a pass recovers nothing; then checks the store again."""
    git_dir = store.discover(path)
    n = store.hash_size_of(git_dir)
    q, result = Quarantine(git_dir), Result()
    dirs = store.object_dirs(git_dir)
    for d in dirs:  # derived files that are wrong are thrown aside; they can be made again
        for p in [*Path(d, "pack").glob("*.rev"), *Path(d, "pack").glob("*.bitmap"), Path(d, "pack", "multi-pack-index"), Path(d, "info", "commit-graph")]:
            if p.is_file() and not store.file_checksum(str(p), n):
                q.move(str(p), "derived file is corrupt")
        if store.pack_list_stale(d):
            q.move(str(Path(d, "info", "packs")), "the list of packs is stale")
    bad_packs = sorted({os.path.splitext(p)[0] for p, _ in store.pack_faults(dirs, n)})
    for base in bad_packs:  # what can be read of a bad pack becomes loose objects first
        copies = store.packed(store.pack_index(spark, dirs, n), n).where((F.col("source") == base + ".pack") & ~F.col("failed"))
        saved = 0
        for r in copies.select("oid", "typ", "body").toLocalIterator():
            store.write_loose(dirs[0], r["typ"], bytes(r["body"]), bytes(r["oid"]))
            saved += 1
        if saved:
            for suffix in COMPANIONS:
                q.move(base + suffix, "pack is corrupt")
        else:
            result.unrecovered.append(base)
    for _ in range(passes):
        rows = plan(spark, path, remote).orderBy("oid").collect()
        got = [r for r in rows if r["source"] is not None]
        for r in got:
            for f in r["files"]:
                if not f.endswith(".pack"):
                    q.move(f.removeprefix("file:"), "object is corrupt")
            store.write_loose(dirs[0], r["typ"], bytes(r["content"]), bytes(r["oid"]))
            result.recovered.append(bytes(r["oid"]).hex())
        if not got:
            result.unrecovered += [bytes(r["oid"]).hex() for r in rows]
            break
    best = store_check.best_copies(store_check.objects(spark, git_dir, model.Options()))
    readable = {bytes(r[0]) for r in best.select("oid").toLocalIterator()}
    restored, lost = repair_packed_refs(git_dir, q, readable, peeled_tags(best), n)
    result.refs += restored
    result.unrecovered += lost
    for name, _, sym, broken in store.refs(git_dir, n):
        if broken and sym is None:
            value = newest_good(git_dir, name, readable, n)
            if value:
                q.move(os.path.join(git_dir, name), "ref is malformed")
                Path(git_dir, name).write_text(value.hex() + "\n")
                result.refs.append(name)
            else:
                result.unrecovered.append(name)
    entries, _, fault = store.index_entries(git_dir, n)
    if fault:
        salvaged = store.index_entries(git_dir, n, salvage=True)[0]
        entries = [e[:4] for e in salvaged]
        have = {e[0] for e in entries}
        entries += [e for e in head_entries(spark, git_dir, best, n) if e[0] not in have]
        q.move(os.path.join(git_dir, "index"), fault)
        temp = Path(git_dir, "index.new")
        temp.write_bytes(codecs.encode_index(entries, n))
        os.replace(temp, Path(git_dir, "index"))
    result.run = q.run if q.moved else None
    result.clean = store_check.status(store_check.check(spark, path)) == 0
    return result
