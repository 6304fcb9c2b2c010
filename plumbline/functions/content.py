"""Content addresses: digests that name a record by what it holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed(kind: str | Column, body: Column) -> Column:
    """kind, a space, the body's length in bytes, a zero byte, the body; all as bytes."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    body = body.cast("binary")
    head = F.concat(kind, F.lit(" "), F.octet_length(body).cast("string")).cast("binary")
    return F.concat(head, F.unhex(F.lit("00")), body)


def object_id(kind: str | Column, body: Column, algorithm: str = "sha1") -> Column:
    """The hexadecimal name of a typed record; sha1 or sha256."""
    data = framed(kind, body)
    return F.sha1(data) if algorithm == "sha1" else F.sha2(data, 256)


def latin1(body: Column) -> Column:
    """Bytes as a string with one character a byte: lossless, for regular expressions."""
    return F.decode(body, "ISO-8859-1")


def trailer_holds(content: Column, raw: int = 20) -> Column:
    """Whether the last `raw` bytes are the digest of all before them."""
    body = F.substring(content, F.lit(1), F.octet_length(content) - raw)
    digest = F.sha1(body) if raw == 20 else F.sha2(body, 256)
    return F.lower(F.hex(F.substring(content, -raw, raw))) == digest


def parse_id(text: Column, raw: int = 20) -> Column:
    """Full hexadecimal of raw bytes, in either case, as binary; null for anything else."""
    return F.when(text.rlike(f"^[0-9a-fA-F]{{{2 * raw}}}$"), F.unhex(text))


def is_null_id(oid: Column) -> Column:
    """All bytes zero: distinct from no id at all."""
    return F.hex(oid).rlike("^0+$")
