"""Names that some file system takes for a control file: .git, .gitmodules and the like."""

from __future__ import annotations

import re
import unicodedata

# Code points that HFS+ ignores in names.
HFS_IGNORED = frozenset([*range(0x200C, 0x2010), *range(0x202A, 0x202F), *range(0x206A, 0x2070), 0xFEFF])

# The control files and the fallback of their NTFS short names.
NEEDLES = {"git": None, "gitmodules": "gi7eba", "gitignore": "gi250a", "gitattributes": "gi7d29", "mailmap": "maba30"}


def _hfs(name: str, needle: str) -> bool:
    return "".join(c for c in name if ord(c) not in HFS_IGNORED).lower() == "." + needle


def _ntfs(name: str, needle: str) -> bool:
    """Short names, and names with trailing spaces and dots or a stream behind a colon."""
    low = re.split(":", name, maxsplit=1)[0].rstrip(" .").lower()
    if low == "." + needle:
        return True
    if needle == "git":
        return low == "git~1"
    if re.fullmatch(re.escape(needle[:6]) + "~[1-4]", low):
        return True
    m = re.fullmatch(r"([a-z0-9]{1,6})~([1-9][0-9]*)", low)
    return bool(m) and len(low) <= 8 and NEEDLES[needle].startswith(m[1]) and len(m[1]) + len(m[2]) + 1 == 8


def _folded(name: str, needle: str) -> bool:
    """ext4 and ZFS: case folding, before and after compatibility decomposition."""
    want = "." + needle
    return name.casefold() == want or unicodedata.normalize("NFKD", name).casefold() == want


def is_alias(name: bytes, needle: str) -> bool:
    """Whether a name reaches the control file on any of the file systems; after each backslash it is tried anew."""
    text = name.decode("utf-8", "surrogateescape")
    if _hfs(text, needle) or _folded(text, needle):
        return True
    return any(_ntfs(part, needle) for part in [text, *(text[i + 1 :] for i, c in enumerate(text) if c == "\\")])


def could_reach(name: bytes) -> bool:
    """A two-byte test that passes every true alias, and few others."""
    low = name[:2].lower()
    return low[:1] in (b".", b"~") or low in (b"gi", b"g~", b"ma", b"m~") or any(b >= 128 for b in name[:3]) or b"\\" in name
