"""Benchmark decontamination: containment of short test items in long documents.

Items are partitioned by their number of distinct shingles.  Each partition has its own
sketch length k: an item's sketch is its k shingles of least hash (a bottom-k MinHash).
A document that holds a share t of an item's n shingles misses at most n - ceil(t * n)
of them, so with k one more than that for the largest n of a partition, at least one
sketch shingle is in the document: the search finds every item, and is no estimate.
Only shingles found in some sketch make a candidate; candidates are verified by the
exact number of the item's shingles in the document.

Shingles: A-Z lower-cased, words, five in a row; a text of fewer words is one shingle
of all its words, and one without words has none.  So an item of one to four words is
found in a document equal to it alone, and is not searched for inside longer ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textscan as ts
from plumbline.llm.session import ship

WIDTH = 5


def shingles(part: ts.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles, and each document's first (n_docs + 1)."""
    starts, ends, first = part.words()
    h = ts.span_hashes(part.buf, starts, ends)
    words = np.diff(first)
    count = np.where(words >= WIDTH, words - WIDTH + 1, np.minimum(words, 1))
    out_first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(out_first[-1], dtype=np.uint64)
    long_docs = words >= WIDTH
    w = ts.windows(h, WIDTH, salt=WIDTH)
    at = ts.ragged(first[:-1][long_docs], count[long_docs])
    to = ts.ragged(out_first[:-1][long_docs], count[long_docs])
    out[to] = w[at]
    for i in np.flatnonzero((words > 0) & ~long_docs):
        out[out_first[i]] = ts.windows(h[first[i] : first[i + 1]], int(words[i]), salt=int(words[i]))[0]
    return out, out_first


@dataclass
class Block:
    """Some items' shingles, flattened, and their sketches; bounded in size."""

    item: np.ndarray  # item numbers
    size: np.ndarray  # distinct shingles of each
    shingle: np.ndarray  # sorted by hash, once for each item that has it
    owner: np.ndarray  # position in item
    sketched: np.ndarray  # whether the shingle is in its owner's sketch


def _class_tops(sizes: np.ndarray) -> np.ndarray:
    """The largest size of each item's partition: powers of two, but exact below 16."""
    return np.where(sizes < 16, sizes, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def index(items: list[tuple[int, str | None]], share: float) -> Block:
    texts = pa.array([t for _, t in items], pa.string())
    shingle, owner, size = [], [], []
    for part in ts.slices(texts, lower=True):
        h, first = shingles(part)
        for i in range(part.n_docs):
            own = np.unique(h[first[i] : first[i + 1]])
            shingle.append(own)
            owner.append(np.full(len(own), part.first + i))
            size.append(len(own))
    size = np.array(size, dtype=np.int64)
    tops = _class_tops(size)
    sketched = []
    for own, top in zip(shingle, tops.tolist()):
        k = top - math.ceil(share * top - 1e-9) + 1
        mark = np.zeros(len(own), dtype=bool)
        mark[np.argsort(ts.mix(own))[:k]] = True
        sketched.append(mark)
    flat = np.concatenate(shingle) if shingle else np.zeros(0, dtype=np.uint64)
    order = np.argsort(flat, kind="stable")
    join = lambda parts, kind: (np.concatenate(parts) if parts else np.zeros(0, dtype=kind))[order]
    return Block(np.array([i for i, _ in items], dtype=np.int64), size, flat[order], join(owner, np.int64), join(sketched, bool))


def _pairs(texts: pa.Array, block: Block, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, item ids and containments of all pairs that hold in one batch: found by sketches, then counted in full."""
    sketch, sketch_owner = block.shingle[block.sketched], block.owner[block.sketched]
    distinct, begin, count = np.unique(sketch, return_index=True, return_counts=True)
    by_item = np.argsort(block.owner, kind="stable")
    item_begin = np.cumsum(block.size) - block.size
    rows, items, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for part in ts.slices(texts, lower=True) if len(distinct) else ():
        h, first = shingles(part)
        at = np.minimum(np.searchsorted(distinct, h), len(distinct) - 1)
        hit = np.flatnonzero(distinct[at] == h)
        if not len(hit):
            continue
        doc = np.searchsorted(first, hit, "right") - 1
        n = count[at[hit]]
        entry = ts.ragged(begin[at[hit]], n)
        pair = np.unique(np.stack([np.repeat(doc, n), sketch_owner[entry]], axis=1), axis=0)
        shared = np.zeros(len(pair), dtype=np.int64)
        docs, start = np.unique(pair[:, 0], return_index=True)
        for d, lo, hi in zip(docs.tolist(), start.tolist(), [*start[1:].tolist(), len(pair)]):
            own = np.unique(h[first[d] : first[d + 1]])
            sizes = block.size[pair[lo:hi, 1]]
            wanted = block.shingle[by_item[ts.ragged(item_begin[pair[lo:hi, 1]], sizes)]]
            there = own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted
            shared[lo:hi] = ts.per_doc(there.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
        good = shared >= share * block.size[pair[:, 1]] - 1e-9
        rows.append(pair[good, 0] + part.first)
        items.append(block.item[pair[good, 1]])
        held.append(shared[good] / block.size[pair[good, 1]])
    return np.concatenate(rows), np.concatenate(items), np.concatenate(held)


def _search(batches: Iterator[pa.RecordBatch], block: Block, share: float, carried: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, items, held = _pairs(batch.column(0), block, share)
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i + 1).take(take) for i in range(carried)] + [pa.array(items), pa.array(held)],
            names=[f"c{i}" for i in range(carried)] + ["item_id", "containment"],
        )


def _without(batches: Iterator[pa.RecordBatch], block: Block, share: float, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[_pairs(batch.column(text), block, share)[0]] = False
        yield batch.filter(pa.array(keep))


def _blocks(items: DataFrame, share: float, size: int) -> Iterator[Block]:
    """All items, in blocks; null texts and null ids are no items."""
    source = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    held = []
    for row in source.orderBy("item_id", "text").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        if len(held) == size:
            yield index(held, share)
            held = []
    yield index(held, share)


def contained(docs: DataFrame, items: DataFrame, carried: list[str], share: float = 0.8, block: int = 20_000) -> DataFrame:
    """(text, carried) and items (item_id, text) -> carried, item_id, containment; one row per pair that holds.

    containment: the share of the item's distinct shingles that the document has.  Every
    document is searched for every item, items in blocks of `block` (one pass each), which
    bounds what a task holds.  Null texts and wordless items pair with nothing; repeated
    documents give repeated rows; items with an equal item_id are searched one by one and
    the greatest containment is returned.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string").alias("_text"), *carried)
    kinds = docs.select(*carried).dtypes
    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(kinds)] + ["item_id long", "containment double"])
    out = None
    for made in _blocks(items, share, block):
        found = docs.mapInArrow(lambda b, made=made: _search(b, made, share, len(kinds)), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(*[F.col(f"c{i}").alias(n) for i, (n, _) in enumerate(kinds)], "item_id", "containment")


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, containment) of every document and item it contains; each pair once."""
    found = contained(docs, items, ["doc_id"], share)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, share: float = 0.8, block: int = 20_000) -> DataFrame:
    """docs without the rows that contain an item; all columns stay as they are, and no row moves."""
    ship(docs.sparkSession)
    for made in _blocks(items, share, block):
        if len(made.shingle):
            at = docs.columns.index("text")
            docs = docs.mapInArrow(lambda b, made=made: _without(b, made, share, at), docs.schema)
    return docs
