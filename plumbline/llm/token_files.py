"""Token ids in binary shards: one zstandard frame a document, a shared dictionary, an offset index.

A shard is a sequence of records, each ended by LF:

    header   MAGIC, the dictionary's hash (8 bytes), the shard's number (u32), the id width (u8)
    frames   one for each document, in ascending doc_id order: its ids, little-endian
    index    a zstandard frame of the columns known (u8), doc_id, offset, length, n_tokens (i64)
    trailer  MAGIC_END, the index's offset (u64), its length (u64), documents (u64), the dictionary's hash

A document is read without its neighbours: trailer, index, one frame.  The shards are written by
Spark's own text sink, whose commit protocol keeps a lost or repeated task from leaving pieces, and
which writes to whatever store Spark can; the records are bytes and no text.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import textscan as ts
from plumbline.llm.session import ship

MAGIC, MAGIC_END = b"PLTOKEN1", b"PLINDEX1"
HEADER = struct.Struct("<8s8sIB")
TRAILER = struct.Struct("<8sQQQ8s")
NO_DICTIONARY = b"\0" * 8

_graphic = np.zeros(256, dtype=bool)
_graphic[0x21:0x7F] = True
_lead = np.zeros(256, dtype=bool)
_lead[0xC3:0xE0] = True
_after = _graphic | _lead


class Encoder:
    """Encodes texts as the library does without settings; pieces met before are looked up.

    A byte-level BPE with the usual splitting pattern always parts a text before a single
    space between two visible characters, and encodes the parts independently.  Texts are cut
    there, and each distinct part is encoded once.  Cuts are made only where both neighbours
    are ASCII or from U+00C0 to U+07FF, which hold no white space but the ASCII ones, and none
    inside or next to a string of the tokenizer's added tokens, which the library finds first.
    A part is taken for one met before only if its bytes are equal; parts over LONGEST bytes
    are encoded each time.  The memory of parts is bounded; it is emptied when full, which
    changes no result.
    """

    MOST, LONGEST = 1_000_000, 48

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = sorted({t.content.encode() for t in self.tok.get_added_tokens_decoder().values()} - {b""})
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at, self.text_at = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.size, self.text_size = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8)
        self.ids = _Growing(self.kind)
        self.text = _Growing(np.uint8)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a few at a time, as the tokenizer's own results are large."""
        out = []
        for k in range(0, len(texts), 2048):
            out += [np.array(e.ids, dtype=self.kind) for e in self.tok.encode_batch_fast(texts[k : k + 2048], add_special_tokens=False)]
        return out

    def _pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """starts and ends of the parts of all documents."""
        cut = np.flatnonzero(buf[2:-1] == 32) + 2 if len(buf) > 3 else np.zeros(0, dtype=np.int64)
        before = _graphic[buf[cut - 1]] | ((buf[cut - 1] & 0xC0) == 0x80) & _lead[buf[cut - 2]]
        cut = cut[before & _after[buf[cut + 1]]]
        data = buf.tobytes()
        for content in self.added:
            found = data.find(content)
            while found >= 0:
                cut = cut[(cut < found - 1) | (cut > found + len(content) + 1)]
                found = data.find(content, found + 1)
        first = np.zeros(len(buf), dtype=bool)
        first[cut] = first[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(first)
        return starts, np.concatenate([starts[1:], [len(buf)]])

    def encode(self, part: ts.Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice, and the index of each one's first id (n_docs + 1)."""
        buf, offs = part.buf, part.offs
        if not len(buf):
            return np.zeros(0, dtype=self.kind), np.zeros(part.n_docs + 1, dtype=np.int64)
        if len(self.keys) > self.MOST or self.ids.used > 8 * self.MOST:
            self._forget()
        starts, ends = self._pieces(buf, offs)
        length = ends - starts
        distinct, which, back = np.unique(ts.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        twin = which[back]  # the first piece of the same hash; equal, or not shared at all
        other = np.flatnonzero(twin != np.arange(len(twin)))
        same = (length[other] <= self.LONGEST) & (length[other] == length[twin[other]])
        same[same] = ts.same_spans(buf, starts[other[same]], buf, starts[twin[other[same]]], length[other[same]])
        alone = other[~same]
        slot = np.searchsorted(self.keys, distinct)
        known = slot < len(self.keys)
        known[known] = self.keys[slot[known]] == distinct[known]
        taken = np.flatnonzero(known)
        old = slot[taken]
        equal = self.text_size[old] == length[which[taken]]
        equal[equal] = ts.same_spans(buf, starts[which[taken[equal]]], self.text.all(), self.text_at[old[equal]], length[which[taken[equal]]])
        met = taken[equal]
        at, size = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        at[which[met]], size[which[met]] = self.at[slot[met]], self.size[slot[met]]
        fresh = np.ones(len(distinct), dtype=bool)
        fresh[met] = False
        new = np.flatnonzero(fresh)
        encoded = np.concatenate([which[new], alone])
        if len(encoded):
            data = buf.tobytes()
            got = self._ids([data[x:y].decode("utf-8", "replace") for x, y in zip(starts[encoded].tolist(), ends[encoded].tolist())])
            size[encoded] = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            at[encoded] = self.ids.add(np.concatenate(got)) + np.cumsum(size[encoded]) - size[encoded]
            short = new[(length[which[new]] <= self.LONGEST) & ~known[new]]  # a hash that another text holds stays with it
            first = which[short]
            where = np.searchsorted(self.keys, distinct[short])
            text_at = self.text.add(buf[ts.ragged(starts[first], length[first])]) + np.cumsum(length[first]) - length[first]
            self.keys = np.insert(self.keys, where, distinct[short])
            for name, values in (("at", at[first]), ("size", size[first]), ("text_at", text_at), ("text_size", length[first])):
                setattr(self, name, np.insert(getattr(self, name), where, values))
        source = twin
        source[alone] = alone
        lengths = size[source]
        ids = self.ids.all()[ts.ragged(at[source], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, offs)]


class _Growing:
    """An array that is added to at its end."""

    def __init__(self, kind):
        self.held, self.used = np.zeros(1 << 16, dtype=kind), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        if self.used + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held), len(values)), dtype=self.held.dtype)])
        self.held[self.used : self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)

    def all(self) -> np.ndarray:
        return self.held[: self.used]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process: Python workers are reused, and so is what they remember."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8] if dictionary else NO_DICTIONARY


def _shared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = 1 << 16, sample: int = 1000, most_bytes: int = 1 << 23) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample.

    The sample: the `sample` rows whose doc_id hashes lowest, up to most_bytes of ids.  With
    too little to train on, the sample itself is a raw dictionary; with none, there is none.
    """
    ids = [r[0] for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isin(ids)).orderBy("doc_id", "text").limit(sample).toArrow() if ids else None
    if rows is None or not rows.num_rows:
        return b""
    enc, samples, total = encoder(tokenizer), [], 0
    for part in ts.slices(rows.column("text")):
        flat, first = enc.encode(part)
        for i in range(part.n_docs):
            data = flat[first[i] : first[i + 1]].tobytes()
            for k in range(0, len(data), 1 << 14):
                if total < most_bytes:
                    samples.append(data[k : k + (1 << 14)])
                    total += len(samples[-1])
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _shards(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, dictionary: bytes, level: int) -> Iterator[pa.RecordBatch]:
    enc, shared = encoder(tokenizer), _shared(dictionary)
    zip_ = zstandard.ZstdCompressor(level=level, dict_data=shared)
    records = lambda values: pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["record"])
    at, index = 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        if not at:
            head = HEADER.pack(MAGIC, _hash(dictionary), TaskContext.get().partitionId(), enc.width)
            at = len(head) + 1
            yield records([head])
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids_of = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        for part in ts.slices(batch.column(1)):
            flat, first = enc.encode(part)
            ends = np.array([end_id], dtype=enc.kind).tobytes()
            out = [zip_.compress(flat[first[i] : first[i + 1]].tobytes() + ends) for i in range(part.n_docs)]
            lengths = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
            offsets = at + np.cumsum(lengths + 1) - lengths - 1
            at = int(offsets[-1] + lengths[-1] + 1)
            mine = slice(part.first, part.first + part.n_docs)
            index.append((known[mine], ids_of[mine], offsets, lengths, np.diff(first) + 1))
            yield records(out)
    if at:
        columns = [np.concatenate(c) for c in zip(*index)]
        body = zip_.compress(columns[0].astype(np.uint8).tobytes() + b"".join(c.astype("<i8").tobytes() for c in columns[1:]))
        yield records([body, TRAILER.pack(MAGIC_END, at, len(body), len(columns[0]), _hash(dictionary))])


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, level: int = 3, dictionary: bytes | None = None, shard_bytes: int = 128 << 20
) -> None:
    """(doc_id, text, ...) -> path/shards, the dictionary in path/dictionary, and path/manifest.

    tokenizer: path of a tokenizers file (on every machine).  Ids of the whole text, then
    end_id; a null or empty text has end_id alone.  Shards ascend in doc_id (null first), and
    so do documents in a shard; rows with an equal doc_id are ordered by the text's hash and
    the text.  Repeated rows are kept; other columns are not looked at.  An empty table
    writes no records.  There are as many shards as keep the text of one near shard_bytes
    (equal rows share one), and at least as many as the session's shuffle partitions.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer)
    spark.createDataFrame([(bytearray(dictionary), end_id)], "dictionary binary, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    ordered = docs.withColumn("_h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    records = ordered.mapInArrow(lambda b: _shards(b, tokenizer, end_id, dictionary, level), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/shards")
    files = spark.read.format("binaryFile").load(f"{path}/shards").where("length > 0").select("path", "content")
    files.mapInArrow(lambda b: _manifest(b, dictionary), _MANIFEST).write.parquet(f"{path}/manifest")


class Shard:
    """One shard's bytes: its number, its index, and any document's ids."""

    def __init__(self, data: bytes | memoryview, dictionary: bytes):
        magic, hash_, self.number, width = HEADER.unpack_from(data)
        end, at, length, n, again = TRAILER.unpack_from(data, len(data) - 1 - TRAILER.size)
        if magic != MAGIC or end != MAGIC_END or hash_ != again:
            raise ValueError("not a token shard, or a torn one")
        if hash_ != _hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.data, self.kind = data, np.dtype("<u2" if width == 2 else "<u4")
        self.unzip = zstandard.ZstdDecompressor(dict_data=_shared(dictionary))
        body = self.unzip.decompress(data[at : at + length])
        self.known = np.frombuffer(body, dtype=np.uint8, count=n).astype(bool)
        self.doc_id, self.offset, self.length, self.n_tokens = np.frombuffer(body, dtype="<i8", offset=n).reshape(4, n)

    def ids(self, i: int) -> np.ndarray:
        a = int(self.offset[i])
        return np.frombuffer(self.unzip.decompress(self.data[a : a + int(self.length[i])]), dtype=self.kind).astype("<u4")


_MANIFEST = "shard long, file string, first_id long, last_id long, without_id long, documents long, tokens long"


def _manifest(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """One row a shard: its file, the ids it holds, and how much."""
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard = Shard(memoryview(raw.as_buffer()), dictionary)
            ids = shard.doc_id[shard.known]
            row = (shard.number, name.rpartition("/")[2], *((int(ids[0]), int(ids[-1])) if len(ids) else (None, None)), int((~shard.known).sum()), len(shard.doc_id), int(shard.n_tokens.sum()))
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in _MANIFEST.split(", ")])


def _read(batches: Iterator[pa.RecordBatch], dictionary: bytes, only: list[int] | None, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            shard = Shard(memoryview(raw.as_buffer()), dictionary)
            n = len(shard.doc_id)
            take = np.arange(n) if only is None else np.flatnonzero(shard.known & np.isin(shard.doc_id, only))
            starts = np.cumsum(shard.n_tokens) - shard.n_tokens
            for k in range(0, len(take), 1024):
                some = take[k : k + 1024]
                ids = [shard.ids(i) for i in some.tolist()]
                values = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()) if digest else pa.array(ids, pa.list_(pa.int64()))
                counted = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                if not np.array_equal(counted, shard.n_tokens[some]):
                    raise ValueError("a frame does not hold what the index says")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), shard.number, dtype=np.int64)),
                        pa.array(shard.doc_id[some], mask=~shard.known[some]),
                        pa.array(starts[some]),
                        pa.array(counted),
                        values,
                    ],
                    names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32" if digest else "ids"],
                )


def read_token_files(spark: SparkSession, path: str, only: list[int] | None = None, digest: bool = False) -> DataFrame:
    """(shard, doc_id, start_in_shard, n_tokens, ids), or ids_crc32 in place of ids with digest.

    only: doc_ids to fetch.  The manifest tells the shards that may hold them; no other file is
    read, and in those no other document's frame is touched.
    """
    ship(spark)
    kept = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(kept["dictionary"])
    last = "ids_crc32 long" if digest else "ids array<long>"
    schema = f"shard long, doc_id long, start_in_shard long, n_tokens long, {last}"
    where = f"{path}/shards"
    if only is not None:
        wanted = spark.createDataFrame([(x,) for x in sorted(set(only))], "id long")
        manifest = spark.read.parquet(f"{path}/manifest")
        files = manifest.join(F.broadcast(wanted), (F.col("id") >= F.col("first_id")) & (F.col("id") <= F.col("last_id"))).select("file").distinct()
        where = [f"{path}/shards/{r[0]}" for r in files.collect()]
        if not where:
            return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(where).where("length > 0").select("content")
    return files.mapInArrow(lambda b: _read(b, dictionary, only, digest), schema)


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Rows of read_token_files with `start`: the ids of all documents before, over all shards (one row each in the manifest)."""
    manifest = rows.sparkSession.read.parquet(f"{path}/manifest")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    before = manifest.select("shard", before.alias("_before"))
    return rows.join(before, "shard").withColumn("start", F.col("start_in_shard") + F.col("_before")).drop("_before")
