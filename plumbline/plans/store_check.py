"""The check of an object store: objects, refs, the index, derived files, connectivity; one table of findings."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import model
from plumbline.functions import checks
from plumbline.operators import graph, report
from plumbline.shared import written
from plumbline.sources import codecs, store

FINDINGS = "phase long, grp long, pos long, oid string, seq long, msg_id string, severity string, text string, bit long"
_EDGE = pa.schema([("src", pa.binary()), ("ord", pa.int64()), ("dst", pa.binary()), ("implied", pa.string()), ("name", pa.binary()), ("fault", pa.string())])


def objects(spark: SparkSession, git_dir: str, options: model.Options) -> DataFrame:
    """Every copy of every object, with `prio`: packed copies before loose ones, as reads prefer them."""
    dirs, n = store.object_dirs(git_dir), store.hash_size_of(git_dir)
    found = store.loose(spark, dirs, n, options.big_file).withColumn("prio", F.lit(1))
    if options.full:
        found = found.unionByName(store.packed(store.pack_index(spark, dirs, n), n).withColumn("prio", F.lit(0)))
    return written(found, "objects")


def best_copies(copies: DataFrame) -> DataFrame:
    """One good copy of each object: packed first, then by source."""
    good = copies.where("not failed")
    return good.groupBy("oid").agg(F.min_by(F.struct("typ", "size", "body", "source"), F.struct("prio", "source")).alias("_o")).select("oid", "_o.*")


def _links(batches: Iterator[pa.RecordBatch], hash_size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for oid, kind, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kind == "tree":
                entries, fault = codecs.parse_tree(body, hash_size)
                rows += [(oid, i, o, codecs.follow(m), name, None) for i, (_, m, name, o) in enumerate(entries) if codecs.follow(m)]
            elif kind == "commit":
                tree, parents, fault = codecs.commit_links(body, hash_size)
                rows += [(oid, 0, tree, "tree", None, None)] * (tree is not None)
                rows += [(oid, i, p, "commit", None, None) for i, p in enumerate(parents, 1)]
            else:
                target, typ, fault = codecs.tag_target(body, hash_size)
                rows += [(oid, 0, target, typ, None, None)] * (target is not None and fault is None)
            if fault:
                rows.append((oid, -1, None, None, None, fault))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _EDGE)], schema=_EDGE)


def links(best: DataFrame, hash_size: int = 20) -> DataFrame:
    """src, ord, dst, implied, name, fault: what trees, commits and tags refer to; a fault row for one that cannot be read."""
    rows = best.where("typ in ('tree', 'commit', 'tag') and body is not null").select("oid", "typ", "body")
    return rows.mapInArrow(lambda b: _links(b, hash_size), "src binary, ord long, dst binary, implied string, name binary, fault string")


def _object_findings(batches: Iterator[pa.RecordBatch], severity: dict[str, str], strict: bool, hash_size: int) -> Iterator[pa.RecordBatch]:
    names = ["oid", "typ", "seq", "msg_id", "text"]
    for batch in batches:
        rows = []
        for oid, kind, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for i, (msg, text) in enumerate(checks.check_object(kind, body, severity, strict, hash_size)):
                rows.append((oid.hex(), kind, i, msg, text))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)


def _special(batches: Iterator[pa.RecordBatch], hash_size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body in batch.column(0).to_pylist():
            for what, oids in checks.check_tree(body, hash_size=hash_size)[1].items():
                rows += [(o, what) for o in oids]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["oid", "what"])


def _blob_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for oid, what, typ, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if typ is None:
                found = [(f"{what}Missing", f"unable to read .{what} blob")]
            elif typ != "blob":
                found = [(f"{what}Blob", f"non-blob found at .{what}")]
            else:
                found = list((checks.check_gitmodules if what == "gitmodules" else checks.check_gitattributes)(body))
            rows += [(oid.hex(), "blob", 1000 + i, m, t) for i, (m, t) in enumerate(found)]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["oid", "typ", "seq", "msg_id", "text"])


_FOUND = "oid string, typ string, seq long, msg_id string, text string"


def object_findings(best: DataFrame, options: model.Options, hash_size: int = 20) -> DataFrame:
    """The named checks over all objects, graded; blobs only where a tree names them as control files."""
    severity = model.severities(options.severities, options.strict)
    strict = options.strict
    own = best.where("typ <> 'blob'").select("oid", "typ", "body").mapInArrow(lambda b: _object_findings(b, severity, strict, hash_size), _FOUND)
    special = best.where("typ = 'tree'").select("body").mapInArrow(lambda b: _special(b, hash_size), "oid binary, what string").distinct()
    blobs = special.join(best.select("oid", "typ", "body"), "oid", "left").select("oid", "what", "typ", "body").mapInArrow(_blob_findings, _FOUND)
    found = own.unionByName(blobs)
    if options.skip:
        found = found.where(~F.col("oid").isin(sorted(options.skip)))
    graded = report.graded(found, model.severity_table(best.sparkSession, options.severities, options.strict))
    text = F.concat(F.col("severity"), F.lit(" in "), F.col("typ"), F.lit(" "), F.col("oid"), F.lit(": "), F.col("msg_id"), F.lit(": "), F.col("text"))
    return _finding(graded, 1, text, F.when(F.col("severity") == model.ERROR, model.BIT_OBJECT).otherwise(0), grp=F.lit(0), severity=F.col("severity"), msg=F.col("msg_id"), seq=F.col("seq"))


def _finding(df: DataFrame, phase: int, text, bit, grp=None, severity=None, msg=None, seq=None) -> DataFrame:
    lit = lambda v: F.lit(v).cast("long")
    return df.select(
        lit(phase).alias("phase"), (grp if grp is not None else F.lit(0)).cast("long").alias("grp"), lit(0).alias("pos"), F.col("oid").cast("string").alias("oid"),
        (seq if seq is not None else F.lit(0)).cast("long").alias("seq"), (msg if msg is not None else F.lit(None)).cast("string").alias("msg_id"),
        (severity if severity is not None else F.lit(model.ERROR)).alias("severity"), text.alias("text"), bit.cast("long").alias("bit"),
    )


def copy_findings(copies: DataFrame) -> DataFrame:
    """What is wrong with each stored copy."""
    bad = copies.where("failed").select(F.lower(F.hex("oid")).alias("oid"), "source", F.posexplode("errors").alias("k", "error"))
    bit = F.when(F.col("source").endswith(".pack"), model.BIT_PACK).otherwise(model.BIT_OBJECT)
    return _finding(bad, 1, F.concat(F.lit("error: "), F.col("oid"), F.lit(": "), F.col("error"), F.lit(": "), F.col("source")), bit, grp=F.lit(1), seq=F.col("k"))


def roots(git_dir: str, options: model.Options, hash_size: int = 20) -> list[tuple[str, bytes, str | None]]:
    """(where from, object, implied type) of every root: refs, HEAD, reflogs, the index."""
    out: list[tuple[str, bytes, str | None]] = []
    for name, oid, _, _ in store.refs(git_dir, hash_size):
        if oid is not None:
            out.append((name, oid, "commit" if name.startswith("refs/heads/") else None))
    head = store.resolve_ref(git_dir, "HEAD", hash_size)
    if head:
        out.append(("HEAD", head, "commit"))
    if options.reflogs:
        for name, _, old, new, _ in store.reflogs(git_dir, hash_size):
            out += [(f"{name}@reflog", o, None) for o in (old, new) if any(o)]
    out += _index_roots(git_dir, "", hash_size)
    for name, directory in store.worktrees(git_dir):
        at = f"worktrees/{name}/"
        file = Path(directory, "HEAD")
        oid, sym, _ = codecs.parse_ref(file.read_bytes(), hash_size) if file.is_file() else (None, None, True)
        head = oid or (store.resolve_ref(git_dir, sym.decode("latin-1"), hash_size) if sym else None)
        if head:
            out.append((at + "HEAD", head, "commit"))
        out += [(at + ref, o, None) for ref, o, _, _ in store.private_refs(directory, hash_size) if o is not None]
        if options.reflogs:
            out += [(f"{at}{ref}@reflog", o, None) for ref, _, old, new, _ in store.reflogs(directory, hash_size) for o in (old, new) if any(o)]
        out += _index_roots(directory, at, hash_size)
    return out


def _index_roots(directory: str, at: str, hash_size: int) -> list[tuple[str, bytes, str | None]]:
    """What the index of a worktree names: its entries but links to other stores, cached trees, stages once resolved."""
    out: list[tuple[str, bytes, str | None]] = []
    for path, mode, oid, _, _ in store.index_entries(directory, hash_size)[0]:
        if mode & 0o170000 != 0o160000:
            out.append((f"{at}:" + path.decode("utf-8", "replace"), oid, "blob"))
    index = Path(directory, "index")
    extra = codecs.index_extensions(index.read_bytes(), hash_size) if index.is_file() else {}
    for path, count, oid in codecs.parse_cache_tree(extra[b"TREE"], hash_size) or [] if b"TREE" in extra else []:
        if count >= 0:
            out.append((f"{at}:" + path, oid, "tree"))
    for path, stage, _, oid in codecs.parse_resolve_undo(extra[b"REUC"], hash_size) or [] if b"REUC" in extra else []:
        out.append((f"{at}:{stage}:" + path.decode("utf-8", "replace"), oid, "blob"))
    return out


def ref_findings(git_dir: str, hash_size: int = 20) -> list[tuple[str, str, str]]:
    """(name, check, text) of malformed refs and packed refs, and of a HEAD that points elsewhere than to a branch."""
    out = []
    head = Path(git_dir, "HEAD").read_bytes()
    oid, sym, broken = codecs.parse_ref(head, hash_size)
    if sym is not None and not sym.startswith(b"refs/heads/"):
        out.append(("HEAD", "badHeadTarget", f"HEAD points to something strange ({sym.decode('latin-1')})"))
    if broken:
        out.append(("HEAD", "badRefContent", "HEAD is malformed"))
    root = Path(git_dir, "refs")
    for p in sorted(root.rglob("*")) if root.is_dir() else []:
        if p.is_dir() or p.name.endswith(".lock"):
            continue
        name = "refs/" + str(p.relative_to(root))
        if p.is_symlink():
            out.append((name, "symlinkRef", "use deprecated symbolic link for symref"))
        elif not p.is_file():
            out.append((name, "badRefFiletype", "unexpected file type"))
            continue
        if not checks.refname_ok(name):
            out.append((name, "badRefName", "invalid refname format"))
            continue
        content = p.read_bytes()
        oid, sym, broken = codecs.parse_ref(content, hash_size)
        if sym is not None:
            target = sym.decode("latin-1")
            if not content.endswith(b"\n"):
                out.append((name, "refMissingNewline", "misses LF at the end"))
            elif content[4:].strip(b" ")[:-1] != sym:
                out.append((name, "trailingRefContent", "has trailing whitespaces or newlines"))
            if not target.startswith(("refs/", "worktrees/")):
                out.append((name, "symrefTargetIsNotARef", f"points to non-ref target '{target}'"))
            elif not checks.refname_ok(target):
                out.append((name, "badReferentName", f"points to invalid refname '{target}'"))
        elif broken:
            out.append((name, "badRefContent", content[:80].decode("latin-1").rstrip("\n")))
        else:
            rest = content[2 * hash_size :]
            if not any(oid):
                out.append((name, "badRefOid", f"points to invalid object ID '{oid.hex()}'"))
            if not rest:
                out.append((name, "refMissingNewline", "misses LF at the end"))
            elif rest != b"\n":
                out.append((name, "trailingRefContent", f"has trailing garbage: '{rest[:40].decode('latin-1')}'"))
    packed = Path(git_dir, "packed-refs")
    if packed.is_file():
        data = packed.read_bytes()
        if not data:
            out.append(("packed-refs", "emptyPackedRefsFile", "file is empty"))
        before = b""
        claims = data.startswith(b"# pack-refs with:") and b" sorted " in data.split(b"\n", 1)[0] + b" "
        for line, kind, name, _, error in codecs.parse_packed_refs(data, hash_size):
            if error:
                out.append((f"packed-refs line {line}", error, "malformed line"))
            elif kind == "entry":
                if not checks.refname_ok(name.decode("latin-1")):
                    out.append((f"packed-refs line {line}", "badRefName", "has bad refname"))
                if claims and name <= before:
                    out.append((f"packed-refs line {line}", "packedRefUnsorted", "reference is not sorted"))
                    claims = False
                before = name
    return out


def _rows(spark: SparkSession, rows: list[tuple], phase: int, options: model.Options) -> DataFrame:
    severity = model.severities(options.severities, options.strict)
    made = []
    for i, (oid, msg, text, bit) in enumerate(rows):
        s = severity.get(msg, model.ERROR)
        if s != model.IGNORE:
            shown = {model.FATAL: model.ERROR, model.INFO: model.WARN}.get(s, s)
            made.append((phase, 0, i, oid, 0, msg, shown, f"{shown}: {oid}: {msg}: {text}", bit if shown == model.ERROR else 0))
    return spark.createDataFrame(made, FINDINGS)


def derived_findings(spark: SparkSession, git_dir: str, copies: DataFrame, options: model.Options, hash_size: int = 20) -> DataFrame:
    """Reverse indexes, bitmaps, the commit-graph and the multi-pack index against what they are derived from."""
    rows, dirs = [], store.object_dirs(git_dir)
    for d in dirs:
        for idx in sorted(Path(d, "pack").glob("*.idx")):
            entries, error = codecs.parse_pack_index(idx.read_bytes(), hash_size)
            rev = idx.with_suffix(".rev")
            if rev.is_file() and not error:
                got, fault = codecs.parse_reverse_index(rev.read_bytes(), len(entries), hash_size)
                order = sorted(range(len(entries)), key=lambda i: entries[i][1])
                wrong = sum(a != b for a, b in zip(got, order)) if got else 0
                if fault:
                    rows.append((str(rev), "revIndex", fault, model.BIT_REV_INDEX))
                if wrong:
                    rows.append((str(rev), "revIndex", f"{wrong} positions differ from the order of offsets", model.BIT_REV_INDEX))
        for bitmap in sorted(Path(d, "pack").glob("*.bitmap")):
            if not store.file_checksum(str(bitmap), hash_size):
                rows.append((str(bitmap), "bitmap", "bitmap file has an invalid checksum", model.BIT_BITMAP))
        midx = Path(d, "pack", "multi-pack-index")
        if midx.is_file():
            got, names, fault = codecs.parse_multi_pack_index(midx.read_bytes(), hash_size)
            if fault:
                rows.append((str(midx), "multiPackIndex", fault, model.BIT_MULTI_PACK))
            elif names != sorted(set(names)):
                rows.append((str(midx), "multiPackIndex", "pack names out of order", model.BIT_MULTI_PACK))
            offsets = {}
            for name in names if not fault else ():
                idx = midx.with_name(name).with_suffix(".idx")
                offsets[name] = {o: off for o, off, _ in codecs.parse_pack_index(idx.read_bytes(), hash_size)[0]} if idx.is_file() else {}
            bad = [o for _, o, p, off in got if p >= len(names) or offsets[names[p]].get(o) != off]
            if bad:
                rows.append((str(midx), "multiPackIndex", f"incorrect object offset for {len(bad)} objects, first {bad[0].hex()}", model.BIT_MULTI_PACK))
        graphs = [Path(d, "info", "commit-graph")] if Path(d, "info", "commit-graph").is_file() else []
        chain = Path(d, "info", "commit-graphs", "commit-graph-chain")
        if chain.is_file():
            graphs += [chain.with_name(f"graph-{x}.graph") for x in chain.read_text().split()]
        rows += _graph_rows(graphs, copies, hash_size)
    return _rows(spark, rows, 6, options)


def _graph_rows(files: list[Path], copies: DataFrame, hash_size: int) -> list[tuple]:
    rows, layers, base = [], [], 0
    for f in files:
        if not f.is_file():
            rows.append((str(f), "commitGraph", "commit-graph file is missing", model.BIT_COMMIT_GRAPH))
            continue
        got, fan, fault = codecs.parse_commit_graph(f.read_bytes(), hash_size, base)
        if fault:
            rows.append((str(f), "commitGraph", fault, model.BIT_COMMIT_GRAPH))
            continue
        if [g[1] for g in got] != sorted({g[1] for g in got}):
            rows.append((str(f), "commitGraph", "commit-graph has incorrect OID order", model.BIT_COMMIT_GRAPH))
        counts = [0] * 256
        for g in got:
            counts[g[1][0]] += 1
        if [sum(counts[: i + 1]) for i in range(256)] != fan:
            rows.append((str(f), "commitGraph", "commit-graph has incorrect fanout value", model.BIT_COMMIT_GRAPH))
        layers += got
        base += len(got)
    if not layers:
        return rows
    spark = copies.sparkSession
    name_of = {g[0]: g[1] for g in layers}
    generation = {g[0]: g[4] for g in layers}
    table = spark.createDataFrame(
        [(bytearray(o), bytearray(t), [bytearray(name_of.get(p, b"")) for p in ps], gen, date, max([generation.get(p, 0) for p in ps], default=0)) for _, o, t, ps, gen, date in layers],
        "oid binary, tree binary, parents array<binary>, generation long, date long, above long",
    )
    commits = best_copies(copies).where("typ = 'commit'").select("oid", F.decode("body", "ISO-8859-1").alias("text"))
    head = F.substring_index("text", "\n\n", 1)
    real = commits.select(
        "oid", F.lower(F.regexp_extract(head, "^tree ([0-9a-f]+)", 1)).alias("_tree"),
        F.regexp_extract_all(head, F.lit("(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("_parents"),
        F.try_to_number(F.regexp_extract(head, r"(?m)^committer .*> (\d+) ", 1), F.lit("9" * 18)).cast("long").alias("_date"),
    )
    hexed = F.transform("parents", lambda p: F.lower(F.hex(p)))
    fault = (
        F.when(F.col("_tree").isNull(), F.lit("failed to parse commit from object database"))
        .when(F.lower(F.hex("tree")) != F.col("_tree"), F.lit("root tree differs"))
        .when(hexed != F.col("_parents"), F.lit("parents differ"))
        .when((F.col("generation") > 0) & (F.col("generation") <= F.col("above")), F.lit("generation is not above its parents'"))
        .when(F.col("date") != F.col("_date"), F.lit("commit date differs"))
    )
    bad = table.join(real, "oid", "left").select(F.lower(F.hex("oid")).alias("oid"), fault.alias("fault")).where("fault is not null")
    return rows + [(r["oid"], "commitGraph", r["fault"], model.BIT_COMMIT_GRAPH) for r in bad.orderBy("oid").collect()]


def steps(resolved: DataFrame, best: DataFrame, edges: DataFrame) -> DataFrame:
    """Links with what they add to a name: ^ and ^n for parents, : and / for paths, ^{} for a tag's target."""
    own = edges.where("dst is not null").select("src", "dst", "ord", F.decode("name", "UTF-8").alias("path"), "implied")
    typed = own.join(best.select(F.col("oid").alias("src"), F.col("typ").alias("_s")), "src").join(resolved.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    step = (
        F.when(F.col("_s") == "tag", F.lit("^{}"))
        .when((F.col("_s") == "commit") & (F.col("ord") == 0), F.lit(":"))
        .when((F.col("_s") == "commit") & (F.col("ord") == 1), F.lit("^"))
        .when(F.col("_s") == "commit", F.concat(F.lit("^"), F.col("ord").cast("string")))
        .when(F.col("implied") == "tree", F.concat(F.col("path"), F.lit("/")))
        .otherwise(F.col("path"))
    )
    return typed.select("src", "dst", "ord", step.alias("step"))


def connectivity(best: DataFrame, edges: DataFrame, root_rows: DataFrame, options: model.Options) -> DataFrame:
    """missing, dangling and unreachable objects, and links to objects of another type."""
    good = edges.where("dst is not null").join(best.select(F.col("oid").alias("dst"), F.col("typ").alias("_t")), "dst", "left")
    wrong = good.where("implied is not null and _t is not null and implied <> _t").select(F.lower(F.hex("src")).alias("oid"), F.lower(F.hex("dst")).alias("dst"), "implied")
    resolved = written(good.where("_t is null or implied is null or implied = _t").select("src", "dst", "implied"), "resolved")
    reached = graph.reach(root_rows.select(F.col("oid").alias("node")), resolved, resolved.where("implied = 'commit'"))
    known = best.select(F.col("oid").alias("node"), "typ", F.lit(True).alias("present"))
    absent = resolved.select(F.col("dst").alias("node"), F.col("implied").alias("typ")).unionByName(root_rows.select(F.col("oid").alias("node"), "typ"))
    absent = absent.groupBy("node").agg(F.min("typ").alias("typ")).join(known.select("node"), "node", "left_anti").withColumn("present", F.lit(False))
    nodes = known.unionByName(absent)
    said = graph.verdicts(nodes, reached, resolved).join(nodes.select("node", "typ"), "node")
    shown = {"missing"}
    if options.dangling or options.unreachable:
        shown |= {"dangling"}
    if options.unreachable:
        shown |= {"unreachable"}
    rows = said.where(F.col("verdict").isin(sorted(shown))).withColumn("label", F.lit(""))
    if options.name_objects:
        called = graph.named(root_rows.select(F.col("oid").alias("node"), "name"), steps(resolved, best, edges)).select("node", F.concat(F.lit(" ("), F.col("name"), F.lit(")")).alias("_n"))
        rows = rows.drop("label").join(called, "node", "left").withColumn("label", F.coalesce("_n", F.lit("")))
    rows = rows.select(F.lower(F.hex("node")).alias("oid"), "verdict", F.coalesce("typ", F.lit("unknown")).alias("typ"), "label")
    missing = F.col("verdict") == "missing"
    verdict = _finding(
        rows, 5, F.concat(F.col("verdict"), F.lit(" "), F.col("typ"), F.lit(" "), F.col("oid"), F.col("label")), F.when(missing, model.BIT_REACHABLE).otherwise(0),
        severity=F.when(missing, model.ERROR).otherwise(model.INFO), msg=F.col("verdict"),
    )
    broken = _finding(wrong, 5, F.concat(F.lit("broken link from "), F.col("oid"), F.lit(" to "), F.col("dst"), F.lit(": not a "), F.col("implied")), F.lit(model.BIT_REACHABLE), grp=F.lit(1), msg=F.lit("brokenLink"))
    return verdict.unionByName(broken)


def selected(best: DataFrame, edges: DataFrame, options: model.Options) -> DataFrame:
    """What the options ask to be listed, sound or not: commits without a parent, and what tags point to."""
    kinds = best.select("oid", "typ")
    parents = edges.where("implied = 'commit' and ord > 0").select(F.col("src").alias("oid"))
    first = kinds.where("typ = 'commit'").join(parents, "oid", "left_anti").select(F.lower(F.hex("oid")).alias("oid")).where(F.lit(options.root))
    out = _finding(first, 1, F.concat(F.lit("root "), F.col("oid")), F.lit(0), grp=F.lit(3), msg=F.lit("root"), severity=F.lit(model.INFO))
    name = F.regexp_extract(F.col("body").cast("string"), "(?:^|\n)tag ([^\n]*)", 1)
    tags = best.where("typ = 'tag'").where(F.lit(options.tags)).select(F.col("oid").alias("src"), name.alias("name"))
    tags = tags.join(edges.where("dst is not null").select("src", "dst", "implied"), "src")
    tags = tags.select(F.lower(F.hex("src")).alias("oid"), F.format_string("tagged %s %s (%s) in %s", "implied", F.lower(F.hex("dst")), "name", F.lower(F.hex("src"))).alias("text"))
    return out.unionByName(_finding(tags, 1, F.col("text"), F.lit(0), grp=F.lit(3), msg=F.lit("tagged"), severity=F.lit(model.INFO)))


def object_counts(spark: SparkSession, path: str) -> DataFrame:
    """(place, n): how many objects the packs index and how many loose files there are; no body is read."""
    git_dir = store.discover(path)
    dirs, n = store.object_dirs(git_dir), store.hash_size_of(git_dir)
    packed = store.pack_index(spark, dirs, n).where("oid is not null").agg(F.count("*").alias("n")).select(F.lit("packed").alias("place"), "n")
    return packed.unionByName(store.loose_files(spark, dirs, n).agg(F.count("*").alias("n")).select(F.lit("loose").alias("place"), "n"))


def configured(git_dir: str, options: model.Options, hash_size: int = 20) -> model.Options:
    """Options with what the store's configuration says: severities of checks, a list of objects to skip, the size of big files.

    Options given win over the configuration.  An unknown check or severity, and a list that
    cannot be read, are errors.
    """
    severity, skip, big = {}, set(), options.big_file
    for _, key, value in store.config([os.path.join(git_dir, "config")]):
        if key == "core.bigfilethreshold":
            big = options.big_file if options.big_file != model.Options.big_file else size_in_bytes(value or "")
        elif key == "fsck.skiplist":
            skip |= {x.strip() for x in Path(git_dir, value or "").read_text().splitlines() if x.strip() and not x.startswith("#")}
        elif key.startswith("fsck."):
            severity[key.removeprefix("fsck.")] = value or ""
    if bad := [x for x in skip if len(x) != 2 * hash_size or set(x.lower()) - set("0123456789abcdef")]:
        raise ValueError(f"invalid object name in the skip list: {bad[0]}")
    merged = {**severity, **options.severities}
    model.severities(merged, options.strict)
    return replace(options, severities=merged, skip=options.skip | {x.lower() for x in skip}, big_file=big)


def size_in_bytes(text: str) -> int:
    """Digits, and k, m or g for powers of 1024."""
    m = re.fullmatch(r"([0-9]+)([kKmMgG]?)", text)
    if not m:
        raise ValueError(f"bad size: {text}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


def check(spark: SparkSession, path: str, options: model.Options | None = None) -> DataFrame:
    """All findings about the store at path, unordered: FINDINGS.  report.ordered() sorts them, status() folds them."""
    options = (options or model.Options()).normal()
    git_dir = store.discover(path)
    n = store.hash_size_of(git_dir)
    options = configured(git_dir, options, n)
    copies = objects(spark, git_dir, options)
    best = written(best_copies(copies), "best")
    edges = written(links(best, n), "edges")
    found = copy_findings(copies)
    if not options.connectivity_only:
        found = found.unionByName(object_findings(best, options, n))
        unread = edges.where("fault is not null").select(F.lower(F.hex("src")).alias("oid"), "fault")
        found = found.unionByName(_finding(unread, 1, F.concat(F.lit("error: "), F.col("oid"), F.lit(": object could not be parsed: "), F.col("fault")), F.lit(model.BIT_OBJECT), grp=F.lit(2)))
    if options.root or options.tags:
        found = found.unionByName(selected(best, edges, options))
    rows = [(p, "badPack", text, model.BIT_PACK) for p, text in store.pack_faults(store.object_dirs(git_dir), n)] if options.full else []
    rows += [(p, "looseCruft", "bad sha1 file", 0) for p in store.loose_cruft(store.object_dirs(git_dir), n)]
    found = found.unionByName(_rows(spark, rows, 1, options))
    if options.references:
        found = found.unionByName(_rows(spark, [(name, msg, text, model.BIT_REF_CONTENT) for name, msg, text in ref_findings(git_dir, n)], 0, options))
    index_fault = store.index_entries(git_dir, n)[2]
    if index_fault:
        found = found.unionByName(_rows(spark, [(os.path.join(git_dir, "index"), "badIndex", index_fault, model.BIT_OBJECT)], 3, options))
    starts = [(name, bytearray(oid), typ) for name, oid, typ in roots(git_dir, options, n)]
    root_rows = spark.createDataFrame(starts, "name string, oid binary, typ string")
    pointers = root_rows.join(best.select("oid", F.col("typ").alias("_t")), "oid", "left").where("_t is null or (typ is not null and typ <> _t)")
    pointers = pointers.select(F.col("name").alias("oid"), F.concat(F.lit("error: "), F.col("name"), F.lit(": invalid pointer "), F.lower(F.hex("oid"))).alias("text"))
    found = found.unionByName(_finding(pointers, 2, F.col("text"), F.lit(model.BIT_REFS), msg=F.lit("invalidPointer")))
    found = found.unionByName(connectivity(best, edges, root_rows, options))
    return found.unionByName(derived_findings(spark, git_dir, copies, options, n))


def status(findings: DataFrame) -> int:
    """The bit-or of all findings."""
    return findings.agg(F.coalesce(F.bit_or("bit"), F.lit(0))).first()[0]
