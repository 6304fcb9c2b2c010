"""SimHash near-duplicates: fingerprints, linked by a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints within three bits
agree in at least five of the eight positions.  The inverted index lists fingerprints
by (positions, bytes); so that no list holds a 256th of the corpus, its terms are sets
of four positions instead of single ones.  TERMS is a covering family: any five
positions contain one of its sets, so every pair within three bits meets in some list.
In a list, the agreeing positions of each pair are tallied, pairs reaching MATCHES are
kept, and the bits are counted.

A list is never expanded into links of all its pairs: a spanning forest leaves it.
Short lists are tallied in blocks.  In longer lists (dense groups of near copies) the
same pairs are found without comparing all: two fingerprints are within three bits
exactly if some value is within one bit of the first and within two bits of the other.
Lists longer than `split` fingerprints are dealt over several tasks by that middle value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textscan as ts
from plumbline.llm.components import components
from plumbline.llm.session import ship, written

BYTES = 8
BITS = 3
MATCHES = BYTES - BITS
SEED = 42
WIDTH = 3


def _covering() -> list[tuple[int, ...]]:
    """Sets of four of the eight positions such that any five positions contain one; chosen greedily."""
    fives = [set(c) for c in combinations(range(BYTES), MATCHES)]
    chosen: list[tuple[int, ...]] = []
    fours = list(combinations(range(BYTES), 4))
    left = list(fives)
    while left:
        best = max(fours, key=lambda four: (sum(set(four) <= x for x in left), [-p for p in four]))
        chosen.append(best)
        left = [x for x in left if not set(best) <= x]
    return chosen


TERMS = _covering()


LONG = 1 << 20
_RUN = 1 << 15


def _ones(words: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """How many of the words' shingles have each bit set, and how many shingles there are."""
    text = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(text[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return counts, len(hashes)


def _print(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(words: list[bytes]) -> int:
    """The fingerprint of one document's (lower-cased) words."""
    return _print(*_ones(words, min(WIDTH, len(words)))) if words else 0


def long_fingerprint(part: ts.Slice, run: int = _RUN) -> int:
    """The same for a slice that is one long document, a run of words at a time."""
    starts, ends, _ = part.words()
    if len(starts) <= run:
        return fingerprint([part.buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())])
    counts, n = np.zeros(64, dtype=np.int64), 0
    for k in range(0, len(starts) - WIDTH + 1, run):
        some = slice(k, k + run + WIDTH - 1)
        more, m = _ones([part.buf[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist())], WIDTH)
        counts, n = counts + more, n + m
    return _print(counts, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        out = np.zeros(batch.num_rows, dtype=np.uint64)
        for part in ts.slices(texts, lower=True):
            if part.n_docs == 1 and len(part.buf) > LONG:
                out[part.first] = long_fingerprint(part)
                continue
            data = part.buf.tobytes()
            offs = part.offs.tolist()
            for k in range(part.n_docs):
                out[part.first + k] = fingerprint(data[offs[k] : offs[k + 1]].split())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, text_hash): fp holds the 64 bits as a signed long, text_hash is xxhash64 of the text."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def _term(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes of fp at the positions, side by side, as a long."""
    out = F.lit(0).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")))
    return out


class _Forest:
    """Union-find over indices, fed with arrays of links; keeps the links that joined."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Labels become the least index of each component."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                return
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def _bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _tally(fps: np.ndarray, forest: _Forest, block: int = 512) -> None:
    """All pairs of a short list, in blocks: tally equal positions, keep MATCHES and more, count bits."""
    by_position = fps[:, None].view(np.uint8)
    for i in range(0, len(fps), block):
        same = np.zeros((min(block, len(fps) - i), len(fps)), dtype=np.uint8)
        for p in range(BYTES):
            same += by_position[i : i + block, p][:, None] == by_position[:, p][None, :]
        a, b = np.nonzero(same >= MATCHES)
        a += i
        keep = a < b
        a, b = a[keep], b[keep]
        keep = _bit_count(fps[a] ^ fps[b]) <= BITS
        forest.join(a[keep], b[keep])


def _meet(fps: np.ndarray, free: np.ndarray, part: int, parts: int, forest: _Forest) -> None:
    """The same links in a long list, by middle values; free: the bits in which its members may differ."""
    one = np.concatenate([np.zeros(1, dtype=np.uint64), free])
    two = np.array([0, *free.tolist(), *(int(x) | int(y) for x, y in combinations(free.tolist(), 2))], dtype=np.uint64)
    at = np.arange(len(fps))
    middles, owners = [], []
    for x in one:
        m = fps ^ x
        mine = ts.mix(m) % np.uint64(parts) == part if parts > 1 else slice(None)
        middles.append(m[mine])
        owners.append(at[mine])
    middle, owner = np.concatenate(middles), np.concatenate(owners)
    order = np.argsort(middle, kind="stable")
    middle, owner = middle[order], owner[order]
    if not len(middle):
        return
    new = np.concatenate([[True], middle[1:] != middle[:-1]])
    first = owner[new][np.cumsum(new) - 1]
    forest.join(owner, first)  # both within one bit of the same value
    middle, owner = middle[new], owner[new]
    for x in two:
        m = fps ^ x
        k = np.minimum(np.searchsorted(middle, m), len(middle) - 1)
        hit = middle[k] == m
        forest.join(at[hit], owner[k[hit]])


def _links(batches: Iterator[pa.RecordBatch], short: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        terms, parts_of, parts_n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        for i in range(batch.num_rows):
            fps = np.unique(values[offsets[i] : offsets[i + 1]].view(np.uint64))
            forest = _Forest(len(fps))
            if len(fps) == 2:
                x = fps[:1] ^ fps[1:]
                if _bit_count(x)[0] <= BITS:
                    us.append(fps[1:])
                    vs.append(fps[:1])
                continue
            if len(fps) <= short and parts_n[i] == 1:
                _tally(fps, forest)
            else:
                fixed = set(TERMS[terms[i]])
                free = np.array([1 << (8 * p + k) for p in range(BYTES) if p not in fixed for k in range(8)], dtype=np.uint64)
                _meet(fps, free, int(parts_of[i]), int(parts_n[i]), forest)
            moved = np.flatnonzero(forest.label != np.arange(len(fps)))
            us.append(fps[moved])
            vs.append(fps[forest.label[moved]])
        u = np.concatenate(us) if us else np.zeros(0, dtype=np.uint64)
        v = np.concatenate(vs) if vs else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame, short: int = 512, split: int = 1 << 17) -> DataFrame:
    """Distinct fingerprints (fp long) -> (u, v): for each list of the index a spanning forest of its links.

    The components of these links are those of all pairs within three bits.  A list of
    more than `split` fingerprints is dealt over tasks by middle values; none is cut.
    """
    ship(distinct.sparkSession)
    terms = F.array(*[F.struct(F.lit(i).alias("term"), _term(F.col("fp"), t).alias("key")) for i, t in enumerate(TERMS)])
    posted = distinct.select("fp", F.inline(terms))
    counts = posted.groupBy("term", "key").agg(F.count("*").alias("n"))
    long_lists = written(
        counts.where(F.col("n") > split).select("term", "key", F.ceil(F.col("n") / split).cast("int").alias("parts")), "longlists"
    )
    posted = posted.join(long_lists, ["term", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = posted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lists = (
        dealt.groupBy("term", "key", "parts", "part")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("term", "part", "parts", "fps")
    )
    return lists.mapInArrow(lambda batches: _links(batches, short), "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> one row (doc_id, fp, component_id, root, text_hash) per row of docs.

    Texts: A-Z lower-cased, words, 3-word shingles with repeats (fewer words: the whole
    sequence), XXH64 with seed 42; a bit is set if it is set in over half the hashes.  A
    null, empty or wordless text has fingerprint 0, linked like any other.  component_id
    is the least doc_id reachable over links of three bits or fewer; exact copies share a
    fingerprint and so a component.  Repeated rows stay; a null doc_id is kept and never
    the least unless the component has no other.  root is a fingerprint of the component, and
    tells components apart where ids are null or repeated.  Other columns are not looked at.
    """
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id", "root")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that with the least doc_id (null last).

    Of unlike texts with that doc_id the one that hashes lowest stays; of rows with the same
    doc_id and text, one.  Components are told apart by their fingerprints, not by ids, so
    unlike documents that share a doc_id both stay, and so does one of each group without ids.
    """
    null, number, text = ("_" * (1 + max(len(c) for c in docs.columns)) + n for n in ("null", "id", "text"))  # of no column of docs
    found = near_duplicates(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(number), F.col("text_hash").alias(text)))
    keep = found.groupBy("root").agg(least.alias("k")).select("k.*")
    marked = docs.withColumns(
        {null: F.col("doc_id").isNull(), number: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text: F.xxhash64(F.col("text").cast("string"))}
    )
    kept = marked.join(keep, [null, number, text], "left_semi")
    row = F.first(F.struct(*[F.col(c) for c in docs.columns]))
    return kept.groupBy(null, number, text).agg(row.alias("row")).select("row.*")
