"""Vectorised scanning of UTF-8 text: words, lines and 64-bit span hashes with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; those bytes never occur
inside a multi-byte character, so words can be found on bytes.  Memory is bounded by
the slice (SLICE bytes, or one document if that is longer), and goes back to the system
after each column: workers are reused, and one that waits would keep its largest slice's.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 20
U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three xor-shifts, two multiplications)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
_CHAINED = 256  # longer spans are hashed one by one


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one little-endian number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end).

    Eight bytes at a time are xored in and mixed (no polynomial, so texts of repetitive
    structure do not meet); spans over 256 bytes get their XXH3.
    """
    length = np.asarray(ends - starts, dtype=np.int64)
    out = mix(length.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(1))
    live = np.flatnonzero((length > 0) & (length <= _CHAINED))
    if len(live):
        numbers = eights(buf)
        at, left, h = starts[live], length[live], out[live]
        while len(live):
            h = mix((h ^ (numbers[at] & _KEEP[np.minimum(left, 8)])) * U64(0xD1342543DE82EF95))
            more = left > 8
            out[live[~more]] = h[~more]
            live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(length > _CHAINED).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[int(starts[i]) : int(ends[i])])
    return out


def same_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of a from at[i] on and those of b from bt[i] on are equal, over length[i] bytes."""
    out = np.ones(len(at), dtype=bool)
    live = np.flatnonzero(length > 0)
    x, y = eights(a), eights(b)
    at, bt, left = at[live], bt[live], length[live]
    while len(live):
        equal = ((x[at] ^ y[bt]) & _KEEP[np.minimum(left, 8)]) == 0
        out[live[~equal]] = False
        more = equal & (left > 8)
        live, at, bt, left = live[more], at[more] + 8, bt[more] + 8, left[more] - 8
    return out


def windows(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of the runs of `width` consecutive values of h; element i starts at i."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, salt, dtype=U64)
    for k in range(width):
        out = mix(out * U64(0xD1342543DE82EF95) + h[k : k + n] + U64(k + 1))
    return out


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another allocator than glibc's
    _trim = None


def give_back() -> None:
    """Return what numpy and Arrow have freed to the system; both keep it for what comes next."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Slice:
    """Some whole documents: bytes, byte offsets, words by document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first, self.n_docs = buf, offs, first, len(offs) - 1
        self._words = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends, and for each document the index of its first word (n_docs + 1)."""
        if self._words is None:
            w = ~SPACE[self.buf]
            st, en = w.copy(), w.copy()
            if len(w):
                st[1:] &= ~w[:-1]
                en[:-1] &= ~w[1:]
                edge = self.offs[:-1][np.diff(self.offs) > 0]
                st[edge] = w[edge]
                edge = edge[edge > 0] - 1
                en[edge] = w[edge]
            starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
            self._words = starts, ends, np.searchsorted(starts, self.offs)
        return self._words

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends (without the LF), and each document's first line; every document has one."""
        lf = np.flatnonzero(self.buf == 10)
        starts = np.sort(np.concatenate([self.offs[:-1], lf + 1]), kind="stable")
        doc_of_lf = np.searchsorted(self.offs, lf, "right") - 1
        count = 1 + np.bincount(doc_of_lf, minlength=self.n_docs)
        first = np.concatenate([[0], np.cumsum(count)])
        # within a document the k-th line ends at its k-th LF, the last at the document's end
        doc = np.repeat(np.arange(self.n_docs), count)
        starts = np.empty(len(doc), dtype=np.int64)
        ends = np.empty(len(doc), dtype=np.int64)
        is_first = np.zeros(len(doc), dtype=bool)
        is_first[first[:-1]] = True
        is_last = np.zeros(len(doc), dtype=bool)
        is_last[first[1:] - 1] = True
        starts[is_first], starts[~is_first] = self.offs[:-1], lf + 1
        ends[is_last], ends[~is_last] = self.offs[1:], lf
        return starts, ends, first


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 byte offsets; null reads as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """The documents of a column in runs of at most SLICE bytes, or one longer document."""
    raw, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        buf = raw[offs[i] : offs[j]]
        yield Slice(LOWER[buf] if lower else buf, offs[i : j + 1] - offs[i], i)
        i = j
    give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, dtype=np.int64) - before, lengths) + np.arange(total)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the runs [first[i], first[i + 1]); an empty run sums to 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros(len(first) - 1, dtype=kind)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values[: first[-1]], first[full], dtype=kind)
    return out
