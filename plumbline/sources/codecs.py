"""Byte codecs of the object store's records: pure functions on bytes, used inside Arrow batches.

Every decoder is total: it returns what could be read and says what could not.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from dataclasses import dataclass, field

# Object types by their number in packs.
TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs-delta", 7: "ref-delta"}
REAL_TYPES = ("commit", "tree", "blob", "tag")
MAX_HEADER = 32
#: A deflate stream cannot expand further than this.
MAX_EXPANSION = 2048


def new_hash(raw: int):
    return hashlib.sha1() if raw == 20 else hashlib.sha256()


def object_id(kind: str, body: bytes, raw: int = 20) -> bytes:
    h = new_hash(raw)
    h.update(b"%s %d\0" % (kind.encode(), len(body)))
    h.update(body)
    return h.digest()


# --- loose objects -----------------------------------------------------------------------


@dataclass
class Loose:
    kind: str | None = None
    size: int | None = None
    body: bytes | None = None
    oid: bytes | None = None
    errors: list[str] = field(default_factory=list)
    mismatch: bool = False

    @property
    def failed(self) -> bool:
        return bool(self.errors)


def loose_header(data: bytes) -> tuple[str, int, int] | None:
    """kind, size, length with the zero byte; None if it is not canonical."""
    end = data.find(b"\0", 0, MAX_HEADER)
    if end < 0:
        return None
    m = re.fullmatch(rb"([^ ]+) (0|[1-9][0-9]*)", data[:end])
    return (m[1].decode("latin-1"), int(m[2]), end + 1) if m else None


def decode_loose(raw: bytes, expected: bytes | None = None, hash_size: int = 20, big: int = 512 << 20) -> Loose:
    """A loose object: inflated, framed, hashed.  A body over `big` bytes is hashed in pieces and not kept."""
    out = Loose()
    if not raw:
        out.errors.append("object file is empty")
        return out
    stream = zlib.decompressobj()
    try:
        data = stream.decompress(raw, MAX_HEADER)
    except zlib.error as e:
        out.errors.append(f"unable to unpack header: {e}")
        return out
    head = loose_header(data)
    if head is None:
        out.errors.append("unable to parse header")
        return out
    out.kind, out.size, skip = head
    if out.kind not in REAL_TYPES:
        out.errors.append(f"invalid object type '{out.kind}'")
        return out
    if not size_plausible(out.size, len(raw)):
        out.errors.append("claimed size is out of proportion")
        return out
    h, keep, length = new_hash(hash_size), out.size <= big, len(data) - skip
    h.update(data)
    parts = [data[skip:]]
    try:
        while not stream.eof and length <= out.size:
            more = stream.decompress(stream.unconsumed_tail, 1 << 16)
            if not more and not stream.unconsumed_tail:
                break
            h.update(more)
            length += len(more)
            if keep:
                parts.append(more)
    except zlib.error as e:
        out.errors.append(f"corrupt loose object: {e}")
        return out
    if length < out.size or (not stream.eof and length == out.size):
        out.errors.append("object is truncated")
    elif length > out.size:
        out.errors.append("object is longer than its header says")
    elif stream.unused_data:
        out.errors.append("garbage at end of loose object")
    else:
        out.oid = h.digest()
        out.body = b"".join(parts) if keep else None
        if expected is not None and out.oid != expected:
            out.mismatch = True
            out.errors.append("hash mismatch")
    return out


def encode_loose(kind: str, body: bytes) -> bytes:
    return zlib.compress(b"%s %d\0" % (kind.encode(), len(body)) + body)


def size_plausible(size: int, compressed: int) -> bool:
    return 0 <= size // MAX_EXPANSION <= compressed


# --- packs -------------------------------------------------------------------------------


def varint(data: bytes, at: int) -> tuple[int, int] | None:
    """Base-128, low part first: value and where it ends; None if it does not end or is over 63 bits."""
    value = shift = 0
    while at < len(data) and shift < 63:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at
    return None


def to_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def offset_varint(data: bytes, at: int) -> tuple[int, int] | None:
    """The biased base-128 of delta offsets, high part first."""
    value, first = 0, True
    while at < len(data):
        b = data[at]
        value = (value if first else value + 1 << 7) | b & 127
        at, first = at + 1, False
        if value >= 1 << 56:
            return None
        if b < 128:
            return value, at
    return None


def to_offset_varint(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        n -= 1
        out.append(n & 127 | 128)
    return bytes(reversed(out))


@dataclass
class EntryHeader:
    kind: str | None
    size: int
    data: int  # where the compressed bytes begin
    base_offset: int | None = None
    base_oid: bytes | None = None
    error: str | None = None


def entry_header(data: bytes, offset: int, hash_size: int = 20, at: int | None = None) -> EntryHeader:
    """The header of the pack entry at `offset`; data may be a cut of the pack in which it stands at `at`."""
    at = start = offset if at is None else at
    if at >= len(data):
        return EntryHeader(None, 0, at, error="entry is beyond the pack")
    b = data[at]
    number, size, shift = b >> 4 & 7, b & 15, 4
    at += 1
    while b > 127:
        if at >= len(data) or shift > 57:
            return EntryHeader(None, 0, at, error="bad object header")
        b = data[at]
        size |= (b & 127) << shift
        at, shift = at + 1, shift + 7
    kind = TYPES.get(number)
    if kind is None:
        return EntryHeader(None, size, at, error=f"unknown object type {number}")
    if kind == "ofs-delta":
        got = offset_varint(data, at)
        if got is None or got[0] <= 0 or got[0] > offset:
            return EntryHeader(kind, size, at, error="delta base offset out of bounds")
        return EntryHeader(kind, size, got[1], base_offset=offset - got[0])
    if kind == "ref-delta":
        if at + hash_size > len(data):
            return EntryHeader(kind, size, at, error="truncated delta base")
        return EntryHeader(kind, size, at + hash_size, base_oid=bytes(data[at : at + hash_size]))
    return EntryHeader(kind, size, at, error=None if at > start else "bad object header")


def inflate_exact(data: bytes, at: int, size: int) -> tuple[bytes, int] | None:
    """size inflated bytes and where the stream ends; None if it is anything else."""
    if not size_plausible(size, len(data) - at):
        return None
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data[at:], size + 1)
        if len(out) == size and not stream.eof:
            out += stream.decompress(stream.unconsumed_tail, 1)
    except zlib.error:
        return None
    return (out, len(data) - len(stream.unused_data)) if stream.eof and len(out) == size else None


def apply_delta(base: bytes, delta: bytes) -> bytes | None:
    """The target of a delta; None if the delta is malformed or for another base."""
    a = varint(delta, 0)
    b = varint(delta, a[1]) if a else None
    if not a or not b or a[0] != len(base):
        return None
    want, at, out, made = b[0], b[1], [], 0
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            fields = []
            for bit in range(7):
                if op >> bit & 1:
                    if at >= len(delta):
                        return None
                    fields.append(delta[at])
                    at += 1
                else:
                    fields.append(0)
            start = int.from_bytes(bytes(fields[:4]), "little")
            n = int.from_bytes(bytes(fields[4:]), "little") or 1 << 16
            if start + n > len(base):
                return None
            out.append(base[start : start + n])
        elif op:
            n = op
            if at + n > len(delta):
                return None
            out.append(delta[at : at + n])
            at += n
        else:
            return None
        made += n
        if made > want:
            return None
    return b"".join(out) if made == want else None


def parse_pack_index(data: bytes, hash_size: int = 20) -> tuple[list[tuple[bytes, int, int | None]], str | None]:
    """(oid, offset, crc) in index order, and what is wrong with the file if anything."""
    v2 = data[:4] == b"\xfftOc"
    at = 8 if v2 else 0
    if v2 and int.from_bytes(data[4:8], "big") != 2:
        return [], "unknown index version"
    if len(data) < at + 1024 + 2 * hash_size:
        return [], "index file is too small"
    fan = struct.unpack_from(">256I", data, at)
    if any(x > y for x, y in zip(fan, fan[1:])):
        return [], "non-monotonic index"
    n, at = fan[255], at + 1024
    if not v2:
        if len(data) != at + n * (4 + hash_size) + 2 * hash_size:
            return [], "wrong index size"
        step = 4 + hash_size
        return [(data[k + 4 : k + step], int.from_bytes(data[k : k + 4], "big"), None) for k in range(at, at + n * step, step)], None
    if len(data) < at + n * (8 + hash_size) + 2 * hash_size:
        return [], "wrong index size"
    oids = [data[at + i * hash_size : at + (i + 1) * hash_size] for i in range(n)]
    at += n * hash_size
    crcs, offsets = struct.unpack_from(f">{n}I", data, at), struct.unpack_from(f">{n}I", data, at + 4 * n)
    at += 8 * n
    large = (len(data) - at - 2 * hash_size) // 8
    wide = struct.unpack_from(f">{large}Q", data, at)
    out = []
    for oid, crc, off in zip(oids, crcs, offsets):
        if off >> 31:
            k = off & 0x7FFFFFFF
            off = wide[k] if k < large else -1
        out.append((oid, off, crc))
    return out, None


# --- trees, commits, tags ----------------------------------------------------------------


def parse_tree(body: bytes, hash_size: int = 20) -> tuple[list[tuple[bytes, int, bytes, bytes]], str | None]:
    """(mode text, mode, name, oid) of the entries before the first that cannot be decoded, and why it cannot."""
    out, at = [], 0
    while at < len(body):
        space = body.find(b" ", at)
        mode = body[at:space] if space > at else b""
        if not re.fullmatch(rb"[0-7]{1,10}", mode):
            return out, "malformed mode in tree entry"
        end = body.find(b"\0", space + 1)
        if end < 0:
            return out, "truncated tree entry"
        if end == space + 1:
            return out, "empty filename in tree entry"
        if end + 1 + hash_size > len(body):
            return out, "truncated tree entry"
        out.append((mode, int(mode, 8), body[space + 1 : end], body[end + 1 : end + 1 + hash_size]))
        at = end + 1 + hash_size
    return out, None


def encode_tree(entries: list[tuple[str, bytes, bytes]]) -> bytes:
    """(mode, name, oid) in the order of paths: a directory sorts as if its name ended in a slash."""
    key = lambda e: e[1] + (b"/" if e[0].lstrip("0") == "40000" else b"")
    return b"".join(b"%s %s\0%s" % (m.encode(), n, o) for m, n, o in sorted(entries, key=key))


def follow(mode: int) -> str | None:
    """The type that a tree entry's mode implies, if the entry is followed."""
    return {0o100000: "blob", 0o120000: "blob", 0o040000: "tree"}.get(mode & 0o170000)


def commit_links(body: bytes, hash_size: int = 20) -> tuple[bytes | None, list[bytes], str | None]:
    """tree, parents, and what cannot be read of them."""
    n = 2 * hash_size
    m = re.match(rb"tree ([0-9a-fA-F]{%d})\n" % n, body)
    if not m:
        return None, [], "bogus commit object" if not body.startswith(b"tree ") else "bad tree pointer"
    parents, at = [], m.end()
    while body.startswith(b"parent ", at):
        p = re.compile(rb"parent ([0-9a-fA-F]{%d})\n" % n).match(body, at)
        if not p:
            return bytes.fromhex(m[1].decode()), parents, "bad parents in commit"
        parents.append(bytes.fromhex(p[1].decode()))
        at = p.end()
    return bytes.fromhex(m[1].decode()), parents, None


def tag_target(body: bytes, hash_size: int = 20) -> tuple[bytes | None, str | None, str | None]:
    """target, its type, and what cannot be read."""
    m = re.match(rb"object ([0-9a-fA-F]{%d})\ntype ([^\n]{1,19})\n" % (2 * hash_size), body)
    if not m:
        return None, None, "bad tag object"
    kind = m[2].decode("latin-1")
    return bytes.fromhex(m[1].decode()), kind, None if kind in REAL_TYPES else f"unknown tag type '{kind}'"


# --- references --------------------------------------------------------------------------


def parse_ref(content: bytes, hash_size: int = 20) -> tuple[bytes | None, bytes | None, bool]:
    """oid, symref target, broken."""
    if content.startswith(b"ref:"):
        return None, content[4:].strip(), False
    m = re.match(rb"([0-9a-fA-F]{%d})(\s|$)" % (2 * hash_size), content)
    return (bytes.fromhex(m[1].decode()), None, False) if m else (None, None, True)


def parse_packed_refs(data: bytes, hash_size: int = 20) -> list[tuple[int, str, bytes | None, bytes | None, str | None]]:
    """(line number, kind, name, oid, error) of every line; kind is header, entry, peel or bad."""
    out, before = [], ""
    lines = data.split(b"\n")
    unterminated = lines[-1] != b""
    lines = lines if unterminated else lines[:-1]
    for i, line in enumerate(lines, 1):
        error = "packedRefEntryNotTerminated" if unterminated and i == len(lines) else None
        m = re.fullmatch(rb"([0-9a-fA-F]{%d}) (\S.*)" % (2 * hash_size), line)
        p = re.fullmatch(rb"\^([0-9a-fA-F]{%d})" % (2 * hash_size), line)
        if line.startswith(b"#"):
            kind = "header"
            if i > 1 or not line.startswith(b"# pack-refs with:"):
                error = error or "badPackedRefHeader"
            out.append((i, kind, None, None, error))
        elif m:
            kind = "entry"
            out.append((i, kind, m[2], bytes.fromhex(m[1].decode()), error))
        elif p and before == "entry":
            kind = "peel"
            out.append((i, kind, None, bytes.fromhex(p[1].decode()), error))
        else:
            kind = "bad"
            out.append((i, kind, None, None, error or "badPackedRefEntry"))
        before = kind
    return out


def parse_reflog(data: bytes, hash_size: int = 20) -> list[tuple[int, bytes, bytes, int]]:
    """(line, old, new, timestamp); short and unreadable lines are skipped."""
    out, n = [], 2 * hash_size
    pattern = re.compile(rb"([0-9a-fA-F]{%d}) ([0-9a-fA-F]{%d}) [^\t]*> (\d+) [+-]\d{4}(\t|$)" % (n, n))
    for i, line in enumerate(data.split(b"\n")):
        if m := pattern.match(line):
            out.append((i, bytes.fromhex(m[1].decode()), bytes.fromhex(m[2].decode()), int(m[3])))
    return out


_C_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}


def unquote_c(text: str) -> str | None:
    """The text within C-style quotes: letter escapes and three octal digits a byte; None if it is not quoted so."""
    m = re.fullmatch(r'"((?:[^"\\]|\\(?:[abtnvfr"\\]|[0-3][0-7]{2}))*)"', text, re.S)
    if not m:
        return None
    byte = lambda e: bytes([_C_ESCAPES[e[1].decode()] if e[1].decode() in _C_ESCAPES else int(e[1], 8)])
    return os.fsdecode(re.sub(rb"\\([0-7]{3}|.)", byte, os.fsencode(m[1])))


# --- configuration -----------------------------------------------------------------------

_ESCAPES = {"n": "\n", "t": "\t", "b": "\b", '"': '"', "\\": "\\"}


def parse_config(text: str) -> tuple[list[tuple[str, str | None, int]], str | None]:
    """(key, value, line) of all entries before the first fault, and the fault.  A bare key has no value."""
    out: list[tuple[str, str | None, int]] = []
    section, line, at = "", 1, 0
    text = text.removeprefix("﻿")
    fault = lambda: f"bad config line {line}"
    while at < len(text):
        c = text[at]
        if c == "\n":
            line, at = line + 1, at + 1
        elif c in " \t\r":
            at += 1
        elif c in "#;":
            at = text.find("\n", at) if "\n" in text[at:] else len(text)
        elif c == "[":
            m = re.compile(r'\[([A-Za-z0-9.-]+)(?:[ \t]+"((?:[^"\\\n]|\\[^\n])*)")?\]').match(text, at)
            if not m:
                return out, fault()
            section = m[1].lower() + ("." + re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else "")
            at = m.end()
        elif c.isalpha() and c.isascii() and section:
            m = re.compile(r"([A-Za-z0-9-]+)[ \t]*").match(text, at)
            key, began, at = f"{section}.{m[1].lower()}", line, m.end()
            if at >= len(text) or text[at] in "\r\n":
                out.append((key, None, began))
                continue
            if text[at] != "=":
                return out, fault()
            value, quoted, at, solid = "", False, at + 1, 0
            while at < len(text) and (text[at] in " \t"):
                at += 1
            while at < len(text):
                c = text[at]
                if c == "\n":
                    if quoted:
                        return out, fault()
                    break
                if c == "\\":
                    if text[at + 1 : at + 2] == "\n":
                        line, at = line + 1, at + 2
                        continue
                    if text[at + 1 : at + 2] not in _ESCAPES or at + 1 >= len(text):
                        return out, fault()
                    value += _ESCAPES[text[at + 1]]
                    solid, at = len(value), at + 2
                    continue
                if c == '"':
                    quoted, solid = not quoted, len(value)
                elif c in "#;" and not quoted:
                    at = text.find("\n", at) if "\n" in text[at:] else len(text)
                    break
                else:
                    value += c
                    if quoted or not c.isspace():
                        solid = len(value)
                at += 1
            if quoted:
                return out, fault()
            out.append((key, value[:solid], began))
        else:
            return out, fault()
    return out, None


# --- the index ---------------------------------------------------------------------------


def parse_index(data: bytes, hash_size: int = 20, salvage: bool = False) -> tuple[list[tuple[bytes, int, bytes, int, bytes]], int, str | None]:
    """(path, mode, oid, stage, stat) of the entries, how many the header claims, and the fault.

    salvage: keep what parses, whatever the checksum says.
    """
    if len(data) < 12 + hash_size or data[:4] != b"DIRC":
        return [], 0, "bad signature or too small"
    version, claimed = struct.unpack_from(">II", data, 4)
    if version not in (2, 3, 4):
        return [], claimed, f"bad index version {version}"
    end = len(data) - hash_size
    h = new_hash(hash_size)
    h.update(data[:end])
    bad = any(data[end:]) and h.digest() != data[end:]
    if bad and not salvage:
        return [], claimed, "bad index file checksum"
    out, at, name = [], 12, b""
    for _ in range(claimed):
        fixed = at + 40 + hash_size + 2
        if fixed > end:
            return out, claimed, "truncated entry"
        stat, oid = data[at : at + 40], data[at + 40 : at + 40 + hash_size]
        (flags,) = struct.unpack_from(">H", data, fixed - 2)
        pos = fixed
        if flags & 0x4000:
            if version < 3:
                return out, claimed, "extended flag in a version 2 index"
            pos += 2
        if version == 4:
            got = offset_varint(data, pos)
            if not got or got[0] > len(name):
                return out, claimed, "malformed name field"
            strip, pos = got
            stop = data.find(b"\0", pos, end)
            if stop < 0:
                return out, claimed, "malformed name field"
            name = name[: len(name) - strip] + data[pos:stop]
            at = stop + 1
        else:
            stop = data.find(b"\0", pos, end)
            if stop < 0:
                return out, claimed, "malformed name field"
            name = data[pos:stop]
            at += (pos - at + len(name) + 8) // 8 * 8
        out.append((name, struct.unpack_from(">I", stat, 24)[0], oid, flags >> 12 & 3, stat))
    while not salvage and at + 8 <= end:
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        if at + 8 + size > end:
            return out, claimed, "truncated extension"
        if not 65 <= kind[0] <= 90 and kind not in (b"link", b"sdir"):
            return out, claimed, f"unknown required extension {kind!r}"
        at += 8 + size
    return out, claimed, "bad index file checksum" if bad else None


def index_extensions(data: bytes, hash_size: int = 20) -> dict[bytes, bytes]:
    """The extensions of a sound index, by their four-byte names."""
    entries, claimed, fault = parse_index(data, hash_size)
    if fault or len(entries) != claimed:
        return {}
    version, at, end, out = int.from_bytes(data[4:8], "big"), 12, len(data) - hash_size, {}
    for path, *_ in entries:
        flags = int.from_bytes(data[at + 40 + hash_size : at + 42 + hash_size], "big")
        fixed = 42 + hash_size + (2 if flags & 0x4000 else 0)
        if version == 4:
            at = data.index(b"\0", offset_varint(data, at + fixed)[1]) + 1
        else:
            at += (fixed + len(path) + 8) // 8 * 8
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "big")
        out[data[at : at + 4]] = data[at + 8 : at + 8 + size]
        at += 8 + size
    return out


def parse_cache_tree(body: bytes, hash_size: int = 20) -> list[tuple[str, int, bytes | None]] | None:
    """(path, entry count, oid) of every node, parents first; a count of -1 has no oid.  None if malformed."""
    out: list[tuple[str, int, bytes | None]] = []
    at = 0

    def node(prefix: str) -> bool:
        nonlocal at
        stop = body.find(b"\0", at)
        m = re.compile(rb"(-?\d+) (\d+)\n").match(body, stop + 1) if stop >= 0 else None
        if not m:
            return False
        name, count = body[at:stop].decode("utf-8", "replace"), int(m[1])
        path, at, oid = (f"{prefix}/{name}" if prefix else name), m.end(), None
        if count >= 0:
            oid, at = body[at : at + hash_size], at + hash_size
            if len(oid) != hash_size:
                return False
        out.append((path, count, oid))
        return all(node(path) for _ in range(int(m[2])))

    return out if node("") else None


def parse_resolve_undo(body: bytes, hash_size: int = 20) -> list[tuple[bytes, int, int, bytes]] | None:
    """(path, stage, mode, oid) of every recorded stage; None if malformed."""
    out, at = [], 0
    while at < len(body):
        m = re.compile(rb"([^\0]+)\0([0-7]+)\0([0-7]+)\0([0-7]+)\0").match(body, at)
        if not m:
            return None
        at = m.end()
        for stage in (1, 2, 3):
            mode = int(m[stage + 1], 8)
            if mode:
                if at + hash_size > len(body):
                    return None
                out.append((m[1], stage, mode, body[at : at + hash_size]))
                at += hash_size
    return out


def render_packed_refs(refs: dict[str, bytes], peeled: dict[bytes, bytes]) -> bytes:
    """A packed-refs file: header, sorted entries, and what each tag peels to."""
    lines = ["# pack-refs with: peeled fully-peeled sorted "]
    for name, oid in sorted(refs.items()):
        lines.append(f"{oid.hex()} {name}")
        if oid in peeled:
            lines.append(f"^{peeled[oid].hex()}")
    return ("\n".join(lines) + "\n").encode()


def encode_index(entries: list[tuple[bytes, int, bytes, int]], hash_size: int = 20) -> bytes:
    """A version 2 index of (path, mode, oid, stage), sorted, without extensions."""
    out = [struct.pack(">4sII", b"DIRC", 2, len(entries))]
    for path, mode, oid, stage in sorted(entries, key=lambda e: (e[0], e[3])):
        stat = bytes(24) + struct.pack(">I", mode) + bytes(12)
        body = stat + oid + struct.pack(">H", stage << 12 | min(len(path), 0xFFF)) + path
        out.append(body + bytes(8 - len(body) % 8))
    data = b"".join(out)
    h = new_hash(hash_size)
    h.update(data)
    return data + h.digest()


# --- derived files -----------------------------------------------------------------------


def chunks(data: bytes, count: int, at: int) -> dict[bytes, bytes]:
    """The chunks of a chunked file: the table has count + 1 rows of (id, offset)."""
    rows = [(data[at + 12 * i : at + 12 * i + 4], int.from_bytes(data[at + 12 * i + 4 : at + 12 * i + 12], "big")) for i in range(count + 1)]
    return {k: data[a:b] for (k, a), (_, b) in zip(rows, rows[1:])}


def parse_commit_graph(data: bytes, hash_size: int = 20, before: int = 0) -> tuple[list[tuple[int, bytes, bytes, list[int], int, int]], list[int], str | None]:
    """(position, oid, tree, parent positions, generation, date), the fan-out, and the fault of one commit-graph file.

    before: commits in the layers below, the position of this file's first commit.
    """
    if len(data) < 8 + hash_size or data[:4] != b"CGPH":
        return [], [], "bad commit-graph signature"
    version, hash_version, n_chunks = data[4], data[5], data[6]
    if version != 1 or hash_version != (1 if hash_size == 20 else 2):
        return [], [], "unknown commit-graph version"
    h = new_hash(hash_size)
    h.update(data[:-hash_size])
    if h.digest() != data[-hash_size:]:
        return [], [], "commit-graph checksum does not match"
    part = chunks(data, n_chunks, 8)
    if any(k not in part for k in (b"OIDF", b"OIDL", b"CDAT")):
        return [], [], "commit-graph lacks a required chunk"
    fan = list(struct.unpack(">256I", part[b"OIDF"][:1024]))
    n, step = fan[255], hash_size + 16
    extra = struct.unpack(f">{len(part.get(b'EDGE', b'')) // 4}I", part.get(b"EDGE", b""))
    out = []
    for i in range(n):
        row = part[b"CDAT"][i * step : (i + 1) * step]
        p1, p2, high, low = struct.unpack_from(">IIII", row, hash_size)
        parents = [p for p in (p1,) if p != 0x70000000]
        if p2 & 0x80000000:
            k = p2 & 0x7FFFFFFF
            while k < len(extra):
                parents.append(extra[k] & 0x7FFFFFFF)
                if extra[k] & 0x80000000:
                    break
                k += 1
        elif p2 != 0x70000000:
            parents.append(p2)
        out.append((before + i, part[b"OIDL"][i * hash_size : (i + 1) * hash_size], row[:hash_size], parents, high >> 2, (high & 3) << 32 | low))
    return out, fan, None


def parse_multi_pack_index(data: bytes, hash_size: int = 20) -> tuple[list[tuple[int, bytes, int, int]], list[str], str | None]:
    """(position, oid, pack number, offset), pack names, and the fault."""
    if len(data) < 12 + hash_size or data[:4] != b"MIDX" or data[4] != 1:
        return [], [], "bad multi-pack-index"
    h = new_hash(hash_size)
    h.update(data[:-hash_size])
    if h.digest() != data[-hash_size:]:
        return [], [], "incorrect checksum"
    part = chunks(data, data[6], 12)
    if any(k not in part for k in (b"PNAM", b"OIDF", b"OIDL", b"OOFF")):
        return [], [], "multi-pack-index lacks a required chunk"
    names = [x.decode("utf-8", "replace") for x in part[b"PNAM"].split(b"\0") if x]
    (n,) = struct.unpack_from(">I", part[b"OIDF"], 1020)
    wide = part.get(b"LOFF", b"")
    out = []
    for i in range(n):
        pack, off = struct.unpack_from(">II", part[b"OOFF"], 8 * i)
        if off >> 31 and wide:
            k = 8 * (off & 0x7FFFFFFF)
            off = int.from_bytes(wide[k : k + 8], "big") if k + 8 <= len(wide) else -1
        out.append((i, part[b"OIDL"][i * hash_size : (i + 1) * hash_size], pack, off))
    return out, names, None


def parse_reverse_index(data: bytes, n: int, hash_size: int = 20) -> tuple[list[int], str | None]:
    """Index positions in the order of offsets, and the fault."""
    if data[:4] != b"RIDX" or data[4:8] != struct.pack(">I", 1) or len(data) != 12 + 4 * n + 2 * hash_size:
        return [], "reverse-index file is malformed"
    h = new_hash(hash_size)
    h.update(data[:-hash_size])
    return list(struct.unpack_from(f">{n}I", data, 12)), None if h.digest() == data[-hash_size:] else "invalid checksum"
