import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from plumbline import model
from plumbline.functions import aliases, checks
from plumbline.sources import codecs

SEV = model.severities()
GOOD = b"tree " + b"1" * 40 + b"\nauthor A <a@x> 1 +0000\ncommitter A <a@x> 1 +0000\n\nm\n"


@given(st.integers(0, (1 << 56) - 1))
def test_varints(n):
    assert codecs.varint(codecs.to_varint(n), 0) == (n, len(codecs.to_varint(n)))
    if n < 1 << 55:
        assert codecs.offset_varint(codecs.to_offset_varint(n), 0) == (n, len(codecs.to_offset_varint(n)))


def test_deltas():
    base = b"hello world"
    make = lambda *ops, size: codecs.to_varint(len(base)) + codecs.to_varint(size) + b"".join(ops)
    assert codecs.apply_delta(base, make(bytes([0x90, 5]), size=5)) == b"hello"
    assert codecs.apply_delta(base, make(bytes([0x91, 6, 5]), b"\x01!", size=6)) == b"world!"
    for bad in (make(b"\0", size=1), make(bytes([0x90, 99]), size=99), make(b"\x05ab", size=5), make(b"\x01a", size=2), make(b"\x02ab", size=1), b"", b"\x80"):
        assert codecs.apply_delta(base, bad) is None
    assert codecs.apply_delta(b"x", make(size=0)) is None


@given(st.binary(max_size=300), st.integers(0, 60), st.integers(0, 255))
def test_a_changed_loose_object_never_passes(body, at, value):
    raw = bytearray(codecs.encode_loose("blob", body))
    name = codecs.object_id("blob", body)
    assert not codecs.decode_loose(bytes(raw), name).failed
    at %= len(raw)
    changed = raw[at] != value
    raw[at] = value
    got = codecs.decode_loose(bytes(raw), name)
    assert got.failed or not changed or got.body == body


def test_loose_faults():
    enc = lambda data: zlib.compress(data)
    for raw in (b"", b"abc", enc(b"blob 03\0abc"), enc(b"blub 3\0abc"), enc(b"blob 4\0abc"), enc(b"blob 2\0abc"), enc(b"blob 3\0abc") + b"x", enc(b"blob 3\0abc")[:-2], enc(b"blob " + b"9" * 15 + b"\0x"), enc(b"x" * 40)):
        assert codecs.decode_loose(raw).failed
    big = codecs.decode_loose(codecs.encode_loose("blob", b"x" * 5000), big=100)
    assert big.body is None and big.oid == codecs.object_id("blob", b"x" * 5000)


@pytest.mark.parametrize(
    "line,want",
    [
        (b"A <a@x> 1 +0000", None), (b"A <> 0 -1234", None), (b"<a@x> 1 +0000", "missingNameBeforeEmail"), (b"A a@x 1 +0000", "missingEmail"), (b"A > <a> 1 +0000", "badName"),
        (b"A<a@x> 1 +0000", "missingSpaceBeforeEmail"), (b"A <a@x 1 +0000", "badEmail"), (b"A <a@x>1 +0000", "missingSpaceBeforeDate"), (b"A <a@x> x +0000", "badDate"),
        (b"A <a@x> 01 +0000", "zeroPaddedDate"), (b"A <a@x> 99999999999999999999 +0000", "badDateOverflow"), (b"A <a@x> 1 +000", "badTimezone"), (b"A <a@x> 1 0000", "badTimezone"),
    ],
)
def test_identities(line, want):
    ladder = checks.Ladder(SEV)
    checks.ident(ladder, line)
    assert [m for m, _ in ladder.found] == [want] * (want is not None)


def test_commit_ladder_goes_on_past_warnings():
    ids = lambda body, sev=SEV: [m for m, _ in checks.check_commit(body, sev)]
    assert ids(GOOD) == []
    assert ids(GOOD.replace(b"author", b"autor", 1)) == ["missingAuthor"]
    assert ids(GOOD.replace(b"author A <a@x> 1 +0000\n", b"author A <a@x> 1 +0000\n" * 2)) == ["multipleAuthors"]
    both = GOOD.replace(b"tree 1", b"tree x").replace(b"<a@x> 1", b"<a@x 1", 1)
    assert ids(both) == ["badTreeSha1"]
    assert ids(both, model.severities({"badTreeSha1": "warn"})) == ["badTreeSha1", "badEmail"]
    assert ids(GOOD + b"\0") == ["nulInCommit"]
    assert ids(b"tree \0") == ["nulInHeader"] and ids(b"tree 1") == ["unterminatedHeader"]


def test_tags():
    tag = b"object " + b"1" * 40 + b"\ntype commit\ntag v1\ntagger A <a@x> 1 +0000\n\nm\n"
    ids = lambda body: [m for m, _ in checks.check_tag(body, SEV)]
    assert ids(tag) == []
    assert ids(tag.replace(b"tag v1", b"tag v..1")) == ["badTagName"]
    assert ids(tag.replace(b"tagger A <a@x> 1 +0000\n", b"")) == ["missingTaggerEntry"]
    assert ids(tag.replace(b"type commit", b"type thing")) == ["badType"]
    assert ids(tag.replace(b"type commit\n", b"")) == ["missingTypeEntry"]


def tree(*entries):
    return b"".join(b"%s %s\0%s" % (m, n, o) for m, n, o in entries)


ONE = b"\1" * 20


@pytest.mark.parametrize(
    "body,want",
    [
        (tree((b"100644", b"a", ONE)), []), (tree((b"100640", b"a", ONE)), ["badFilemode"]), (tree((b"0100644", b"a", ONE)), ["zeroPaddedFilemode"]),
        (tree((b"100644", b"a", bytes(20))), ["nullSha1"]), (tree((b"100644", b".", ONE)), ["hasDot"]), (tree((b"40000", b"..", ONE)), ["hasDotdot"]),
        (tree((b"40000", b".Git", ONE)), ["hasDotgit"]), (tree((b"100644", b"a/b", ONE)), ["fullPathname"]), (tree((b"100644", b"b", ONE), (b"100644", b"a", ONE)), ["treeNotSorted"]),
        (tree((b"100644", b"a", ONE), (b"40000", b"a", ONE)), ["duplicateEntries"]), (tree((b"100644", b"a", ONE), (b"100644", b"a.b", ONE), (b"40000", b"a", ONE)), ["duplicateEntries"]),
        (tree((b"100644", b"a" * 5000, ONE)), ["largePathname"]), (b"100644 a\0short", ["badTree"]), (tree((b"40000", b"a", ONE), (b"100644", b"a.b", ONE)), ["treeNotSorted"]),
        (tree((b"120000", b".gitmodules", ONE)), ["gitmodulesSymlink"]), (tree((b"100664", b"a", ONE)), []),
    ],
)
def test_trees(body, want):
    assert [m for m, _ in checks.check_tree(body)[0]] == want


def test_aliases_and_their_prefilter():
    for name, needle in ((".git", "git"), (".GIT", "git"), ("git~1", "git"), (".git . .", "git"), (".git::$INDEX", "git"), (".g\u200cit", "git"), ("a\\.git", "git"), (".gitmodule\u017f", "gitmodules"), ("GITMOD~2", "gitmodules"), ("gi7eba~1", "gitmodules"), ("maba30~1", "mailmap")):
        assert aliases.is_alias(name.encode(), needle), name
        assert aliases.could_reach(name.encode()), name
    for name, needle in (("git", "git"), ("git~2", "git"), (".gitx", "git"), ("gitmod~5", "gitmodules"), ("gi7eb~1", "gitmodules")):
        assert not aliases.is_alias(name.encode(), needle), name


def test_config_and_gitmodules():
    text = '# c\n[core]\n\tBare\n name = "a b" ; x\n v = x\\\n y\n[Sub "A\\"b"]\n\tk=\\t1\n'
    assert codecs.parse_config(text) == ([("core.bare", None, 3), ("core.name", "a b", 4), ("core.v", "x y", 5), ('sub.A"b.k', "\t1", 8)], None)
    for bad in ("[x", "k=1", '[a]\nk="x', "[a]\nk=\\q"):
        assert codecs.parse_config(bad)[1]
    ids = lambda s: [m for m, _ in checks.check_gitmodules(s.encode())]
    assert ids('[submodule "a"]\n path = p\n url = https://x/y\n') == []
    assert ids('[submodule "../a"]\n path = p\n') == ["gitmodulesName"]
    assert ids('[submodule "a"]\n url = -x\n path = -p\n update = !x\n') == ["gitmodulesUrl", "gitmodulesPath", "gitmodulesUpdate"]
    assert ids('[submodule "a"]\n url = https://\n') == ["gitmodulesUrl"]
    assert ids("[submodule") == ["gitmodulesParse"]
    assert list(checks.check_gitattributes(b"x" * 2048))[0][0] == "gitattributesLineLength" and not list(checks.check_gitattributes(b"x" * 2047 + b"\0" + b"y" * 3000))


def test_severities():
    assert len(model.DEFAULT_SEVERITY) == 73
    assert model.severities(strict=True)["hasDot"] == "error" and model.severities({"HASDOT": "warn"}, True)["hasDot"] == "warn"
    for bad in ({"nope": "warn"}, {"hasDot": "loud"}, {"nulInHeader": "warn"}):
        with pytest.raises(ValueError):
            model.severities(bad)


def test_c_quotes():
    cases = {'"a b"': "a b", r'"a\tb\"\\"': 'a\tb"\\', r'"\303\251"': "é", "plain": None, '"open': None, r'"\9"': None, '""': ""}
    assert {k: codecs.unquote_c(k) for k in cases} == cases
