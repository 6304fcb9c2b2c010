import os
import subprocess
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.plans import store_check, store_repair
from plumbline.sources import codecs, store

ENV = {**os.environ, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x", "GIT_AUTHOR_DATE": "1700000000 +0000", "GIT_COMMITTER_DATE": "1700000000 +0000", "GIT_CONFIG_GLOBAL": "/dev/null"}


def git(at, *args, data=None):
    return subprocess.run(["git", "-C", str(at), *args], input=data, capture_output=True, check=True, env=ENV).stdout


@pytest.fixture
def repo(tmp_path):
    git(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "src/deep").mkdir(parents=True)
    for k in range(3):
        (tmp_path / "a.txt").write_text(f"a{k}\n" * 50)
        (tmp_path / "src/deep/c.txt").write_text("".join(f"line {i}\n" for i in range(200 + k)))
        git(tmp_path, "add", "-A")
        git(tmp_path, "commit", "-qm", f"c{k}")
    git(tmp_path, "tag", "-a", "v1", "-m", "tag")
    return tmp_path


def messages(df):
    return sorted((r["msg_id"], r["severity"], r["bit"]) for r in df.collect() if r["bit"] or r["severity"] != "info")


def test_sound_store_loose_and_packed(spark, repo):
    assert messages(store_check.check(spark, str(repo))) == []
    git(repo, "gc", "-q", "--aggressive")
    git(repo, "commit-graph", "write", "--reachable")
    git(repo, "multi-pack-index", "write")
    found = store_check.check(spark, str(repo / "src"))
    assert messages(found) == []
    names = set(git(repo, "rev-list", "--objects", "--all", "--no-object-names").decode().split())
    copies = store_check.objects(spark, str(repo / ".git"), store_check.model.Options())
    assert {r[0].hex() for r in copies.where("not failed").select("oid").collect()} >= names


def test_tags_roots_counts_and_needs(spark, repo):
    git(repo, "tag", "-a", "-m", "x", "v9.1", "HEAD")
    tag, head, tree, blob = (git(repo, "rev-parse", what).decode().strip() for what in ("v9.1", "HEAD", "HEAD^{tree}", "HEAD:a.txt"))
    first = git(repo, "rev-list", "--max-parents=0", "--all").decode().split()
    found = store_check.check(spark, str(repo), store_check.model.Options(tags=True, root=True)).where("msg_id in ('tagged', 'root')").collect()
    assert {r["text"] for r in found if r["msg_id"] == "root"} == {f"root {c}" for c in first}
    assert f"tagged commit {head} (v9.1) in {tag}" in {r["text"] for r in found}
    loose = sum(1 for p in (repo / ".git/objects").glob("??/*") if p.is_file())
    assert {r["place"]: r["n"] for r in store_check.object_counts(spark, str(repo)).collect()} == {"packed": 0, "loose": loose}
    os.remove(repo / ".git/objects" / blob[:2] / blob[2:])
    wanted = {(bytes(r["oid"]).hex(), r["wanted_by"], r["name"]) for r in store_repair.needs(spark, str(repo)).collect()}
    assert (blob, tree, "a.txt") in wanted and {w[0] for w in wanted} == {blob}


def test_choice_of_a_remote(repo):
    assert store.remote_url(str(repo / ".git")) is None
    git(repo, "remote", "add", "z", "https://z/x")
    git(repo, "remote", "add", "b", "https://b/x")
    assert store.remote_url(str(repo / ".git")) == "https://b/x"
    git(repo, "remote", "add", "origin", "https://o/x")
    assert store.remote_url(str(repo / ".git")) == "https://o/x"


def test_missing_and_dangling(spark, repo):
    blob = git(repo, "rev-parse", "HEAD:a.txt").decode().strip()
    os.remove(repo / ".git/objects" / blob[:2] / blob[2:])
    loose = git(repo, "hash-object", "-w", "--stdin", data=b"nobody links here").decode().strip()
    found = {(r["msg_id"], r["oid"]) for r in store_check.check(spark, str(repo)).collect()}
    assert {("missing", blob), ("dangling", loose)} <= found


def test_corrupt_blob_is_recovered_and_undone(spark, repo):
    blob = git(repo, "rev-parse", "HEAD:a.txt").decode().strip()
    path = repo / ".git/objects" / blob[:2] / blob[2:]
    os.chmod(path, 0o644)
    bad = path.read_bytes()[:-3] + b"xyz"
    path.write_bytes(bad)
    assert store_check.status(store_check.check(spark, str(repo))) & 1
    result = store_repair.repair(spark, str(repo))
    assert result.ok and result.recovered == [blob]
    assert zlib.decompress(path.read_bytes()).startswith(b"blob ")
    assert store_repair.runs(str(repo / ".git")) == [result.run]
    store_repair.undo(str(repo / ".git"), result.run)
    assert path.read_bytes() == bad
    assert store_repair.undo(str(repo / ".git"), result.run) == []


def test_a_torn_index_loses_no_path(spark, repo):
    path = repo / ".git/index"
    (repo / "b.txt").write_text("staged only")
    git(repo, "add", "b.txt")
    whole = codecs.parse_index(path.read_bytes())[0]
    data = path.read_bytes()
    cut = data.index(b"src/deep/c.txt") - 62
    path.write_bytes(data[:cut] + b"\xff" * 40)
    store_repair.repair(spark, str(repo))
    entries, _, fault = codecs.parse_index(path.read_bytes())
    assert not fault and [e[0] for e in entries] == [b"a.txt", b"b.txt", b"src/deep/c.txt"] and [e[1:3] for e in entries] == [e[1:3] for e in whole]


def test_lost_trees_are_rebuilt_from_the_index(spark, repo):
    for oid in git(repo, "rev-parse", "HEAD^{tree}", "HEAD:src", "HEAD:src/deep").decode().split():
        os.remove(repo / ".git/objects" / oid[:2] / oid[2:])
    result = store_repair.repair(spark, str(repo))
    assert result.ok and len(result.recovered) == 3


def test_remote_and_hopeless(spark, repo, tmp_path_factory):
    copy = tmp_path_factory.mktemp("copy") / "r"
    subprocess.run(["git", "clone", "-q", "--no-hardlinks", str(repo), str(copy)], check=True, env=ENV)
    old = git(repo, "rev-parse", "HEAD~2:a.txt").decode().strip()
    os.remove(repo / ".git/objects" / old[:2] / old[2:])
    rows = store_repair.plan(spark, str(repo)).collect()
    assert [(bytes(r["oid"]).hex(), r["source"]) for r in rows] == [(old, None)]
    assert store_repair.repair(spark, str(repo), remote=str(copy)).ok


def test_bad_refs(spark, repo):
    heads = repo / ".git/refs/heads"
    (heads / "garbage").write_text("not an id\n")
    (heads / "null").write_text("0" * 40 + "\n")
    (heads / "short").write_text(git(repo, "rev-parse", "HEAD").decode().strip())
    (heads / "trail").write_text(git(repo, "rev-parse", "HEAD").decode().strip() + " x\n")
    (repo / ".git/refs/heads/x.lock").write_text("ignored")
    got = {(n, m) for n, m, _ in store_check.ref_findings(str(repo / ".git"))}
    assert got == {("refs/heads/garbage", "badRefContent"), ("refs/heads/null", "badRefOid"), ("refs/heads/short", "refMissingNewline"), ("refs/heads/trail", "trailingRefContent")}


def test_derived_files(spark, repo):
    git(repo, "gc", "-q")
    git(repo, "commit-graph", "write", "--reachable")
    path = repo / ".git/objects/info/commit-graph"
    os.chmod(path, 0o644)
    data = path.read_bytes()
    path.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert store_check.status(store_check.check(spark, str(repo))) & store_check.model.BIT_COMMIT_GRAPH
    assert store_repair.repair(spark, str(repo)).ok


def test_index_round_trip_and_versions(repo):
    for version in ("2", "3", "4"):
        git(repo, "update-index", "--index-version", version)
        entries, claimed, fault = codecs.parse_index((repo / ".git/index").read_bytes())
        assert fault is None and claimed == 2 and [e[0] for e in entries] == [b"a.txt", b"src/deep/c.txt"]
    data = codecs.encode_index([e[:4] for e in entries])
    (repo / ".git/index").write_bytes(data)
    assert git(repo, "ls-files").decode().split() == ["a.txt", "src/deep/c.txt"]
    assert codecs.parse_index(data[:30])[2]
    assert codecs.parse_index(data[:-1] + b"x")[2] == "bad index file checksum"
    assert len(codecs.parse_index(data[:-1] + b"x", salvage=True)[0]) == 2


def test_bad_packed_refs_line_is_rewritten(spark, repo):
    git(repo, "branch", "side")
    git(repo, "pack-refs", "--all")
    path = repo / ".git/packed-refs"
    lines = path.read_text().splitlines()
    at = next(i for i, x in enumerate(lines) if x.endswith("refs/heads/side"))
    lines[at] = "zz" + lines[at][2:]
    path.write_text("\n".join(lines) + "\n")
    result = store_repair.repair(spark, str(repo))
    assert result.ok and result.refs == ["refs/heads/side"]
    assert git(repo, "rev-parse", "side") == git(repo, "rev-parse", "HEAD")
    assert git(repo, "rev-parse", "v1^{}") == git(repo, "rev-parse", "HEAD")


def test_lost_and_found_and_names(spark, repo):
    loose = git(repo, "hash-object", "-w", "--stdin", data=b"nobody links here").decode().strip()
    assert [Path(p).name for p in store_repair.write_lost_found(spark, str(repo))] == [loose]
    assert (repo / ".git/lost-found/other" / loose).read_bytes() == b"nobody links here"
    old = git(repo, "rev-parse", "HEAD~2:src/deep/c.txt").decode().strip()
    os.remove(repo / ".git/objects" / old[:2] / old[2:])
    found = store_check.check(spark, str(repo), store_check.model.Options(name_objects=True, reflogs=False)).where("msg_id = 'missing'").collect()
    assert [r["text"] for r in found] == [f"missing blob {old} (HEAD~2:src/deep/c.txt)"]


def test_cache_tree_and_resolve_undo(repo):
    git(repo, "write-tree")
    extra = codecs.index_extensions((repo / ".git/index").read_bytes())
    nodes = codecs.parse_cache_tree(extra[b"TREE"])
    want = {"": "HEAD^{tree}", "src": "HEAD:src", "src/deep": "HEAD:src/deep"}
    assert {p: o.hex() for p, _, o in nodes} == {k: git(repo, "rev-parse", v).decode().strip() for k, v in want.items()}
    assert codecs.parse_cache_tree(extra[b"TREE"][:-5]) is None
    one = b"\1" * 20
    assert codecs.parse_resolve_undo(b"p\x00100644\x000\x00120000\x00" + one * 2) == [(b"p", 1, 0o100644, one), (b"p", 3, 0o120000, one)]
    assert codecs.parse_resolve_undo(b"p\x00100644\x000\x00120000\x00" + one) is None


def test_configuration_of_the_check(repo, tmp_path_factory):
    git(repo, "config", "fsck.hasDot", "error")
    git(repo, "config", "core.bigFileThreshold", "2k")
    skip = tmp_path_factory.mktemp("s") / "skip"
    skip.write_text("# none\n" + "AB" * 20 + "\n")
    git(repo, "config", "fsck.skipList", str(skip))
    o = store_check.configured(str(repo / ".git"), store_check.model.Options(severities={"hasDot": "ignore"}))
    assert (o.severities["hasDot"], o.skip, o.big_file) == ("ignore", {"ab" * 20}, 2048)
    git(repo, "config", "fsck.noSuchCheck", "warn")
    with pytest.raises(ValueError):
        store_check.configured(str(repo / ".git"), store_check.model.Options())


def test_command_line(spark, repo, capsys):
    from plumbline.__main__ import main

    assert main(["--nonsense"]) == 129
    assert main([str(repo.parent / "nowhere")]) == 128
    blob = git(repo, "rev-parse", "HEAD:a.txt").decode().strip()
    os.remove(repo / ".git/objects" / blob[:2] / blob[2:])
    assert main(["--dry-run", "--no-dangling", str(repo)]) & 2
    assert f"missing {blob} would be recovered from {repo / 'a.txt'}" in capsys.readouterr().out
    assert main([str(repo)]) == 0
    assert f"recovered {blob}" in capsys.readouterr().out
    assert main(["--list-runs", str(repo)]) == 0


def test_linked_worktrees_have_roots_of_their_own(spark, repo, tmp_path_factory):
    other = tmp_path_factory.mktemp("wt") / "w"
    git(repo, "worktree", "add", "-q", "--detach", str(other))
    (other / "only.txt").write_text("staged in the worktree alone")
    git(other, "add", "only.txt")
    blob = git(other, "rev-parse", ":only.txt").decode().strip()
    found = {(r["msg_id"], r["oid"]) for r in store_check.check(spark, str(repo)).collect()}
    assert not {m for m, _ in found}
    os.remove(repo / ".git/objects" / blob[:2] / blob[2:])
    found = {(r["msg_id"], r["oid"]) for r in store_check.check(spark, str(repo)).collect()}
    assert ("missing", blob) in found and ("invalidPointer", "worktrees/w/:only.txt") in found


def test_stale_pack_list(repo):
    objects = str(repo / ".git/objects")
    assert not store.pack_list_stale(objects)
    (repo / ".git/objects/info/packs").write_text("P pack-1.pack\n\n")
    assert store.pack_list_stale(objects)
