"""Quality rules: plain counts of every text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams: one of a trusted target, one of the raw
corpus.  A document's score is the mean over its n-grams of log P(target) - log P(raw).
A document is kept if it passes the plain rules and its score reaches the threshold;
nothing is drawn at random, so every run decides alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textscan as ts
from plumbline.llm.session import ship, written

BUCKETS = 1 << 16
SIZES = (2, 4)  # bytes of the n-grams
WINDOW = 5
SMALL = 1_000_000  # trusted ids that are broadcast; more are joined by a shuffle
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _grams(part: ts.Slice, run: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams that lie in one document, and each one's document; `run` bytes at a time."""
    for n in SIZES:
        for k in range(0, len(part.buf) - n + 1, run):
            b = part.buf[k : k + run + n - 1].astype(np.uint32)
            doc = np.repeat(np.arange(part.n_docs), np.diff(np.clip(part.offs, k, k + len(b))))
            code = np.zeros(len(b) - n + 1, dtype=np.uint32)
            for i in range(n):
                code = (code << np.uint32(8)) | b[i : i + len(code)]
            whole = doc[: len(code)] == doc[n - 1 :]
            code = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            yield (code >> np.uint32(16))[whole], doc[: len(code)][whole]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False)
        for part in ts.slices(batch.column(0)):
            mine = good[part.first : part.first + part.n_docs]
            for bucket, doc in _grams(part):
                raw += np.bincount(bucket, minlength=BUCKETS)
                if mine.any():
                    target += np.bincount(bucket[mine[doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the words that lie in a window found twice or more in it."""
    n_docs = len(first) - 1
    w = ts.windows(h, WINDOW)
    if not len(w):
        return np.zeros(n_docs, dtype=np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    whole = np.flatnonzero(doc[: len(w)] == doc[WINDOW - 1 :])
    keys = ts.mix(w[whole] ^ ts.mix(doc[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    edge[whole[twice]] += 1
    edge[whole[twice] + WINDOW] -= 1
    return ts.per_doc((np.cumsum(edge)[:-1] > 0).astype(np.int64), first)


def _again(part: ts.Slice) -> np.ndarray:
    """For each document the lines with a word that equal an earlier line."""
    a, b, first = part.lines()
    word_starts = part.words()[0]
    worded = np.searchsorted(word_starts, b) > np.searchsorted(word_starts, a)
    doc = np.repeat(np.arange(part.n_docs), np.diff(first))[worded]
    h = ts.span_hashes(part.buf, a[worded], b[worded])
    keys = ts.mix(h ^ ts.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(keys, return_index=True)
    return np.bincount(doc, minlength=part.n_docs) - np.bincount(doc[at], minlength=part.n_docs)


@dataclass
class Ratio:
    """log P(target) - log P(raw) of every bucket, and the threshold of a document's mean."""

    log_ratio: np.ndarray
    threshold: float

    def scores(self, part: ts.Slice) -> np.ndarray:
        n, total = np.zeros(part.n_docs, dtype=np.int64), np.zeros(part.n_docs)
        for bucket, doc in _grams(part):
            n += np.bincount(doc, minlength=part.n_docs)
            total += np.bincount(doc, weights=self.log_ratio[bucket], minlength=part.n_docs)
        return total / np.maximum(n, 1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch], ratio: Ratio, carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for part in ts.slices(batch.column(0)):
            starts, ends, first = part.words()
            chars = ((part.buf & 0xC0) != 0x80) & ~ts.SPACE[part.buf]
            values = (
                np.diff(first),
                ts.per_doc(chars.astype(np.int64), part.offs),
                ts.per_doc(_SYMBOL[part.buf], part.offs),
                _again(part),
                _repeats(ts.span_hashes(part.buf, starts, ends), first),
                ratio.scores(part),
            )
            for column, value in zip(out, values):
                column.append(value)
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(i + 1) for i in range(len(carried))] + [pa.array(np.concatenate(c)) for c in out], names=[*carried, *COUNTS, "score"]
            )


def _aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, and whether they set the threshold (a fifth of them) rather than make the target."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ts.mix(ids) % np.uint64(5) == 0)], names=["doc_id", "aside"])


def _quantile(scores: DataFrame, share: float) -> float | None:
    """The interpolated quantile of (score), from its lowest share alone; None of no rows."""
    n = scores.count()
    if not n:
        return None
    at = share * (n - 1)
    low = scores.orderBy("score").limit(int(at) + 2)
    got = np.sort(np.asarray(low.toArrow().column(0), dtype=np.float64))
    return float(np.interp(at, np.arange(len(got)), got))


def fit(docs: DataFrame, trusted: DataFrame, loss: float = 0.002, prior: float = 10.0, margin: float = 0.02) -> Ratio:
    """The ratio of a trusted target to the raw corpus.

    docs (doc_id, text): all rows count for the raw multinomial.  trusted (doc_id): all ids
    count, joined as a table; four fifths of them make the target, and the rest set the
    threshold: the score that all but a share `loss` of them reach, less `margin`, and 0 at
    most.

    Raw counts are scaled to the target's total and both get `prior` more in every bucket,
    so a bucket with little evidence says little.  With no trusted row every document
    scores 0 and passes.
    """
    ship(docs.sparkSession)
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = written(ids.mapInArrow(_aside, "doc_id long, aside boolean"), "trusted")
    if ids.count() <= SMALL:  # then no text is moved
        ids = F.broadcast(ids)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    marked = docs.join(ids, "doc_id", "left").select("text", F.coalesce(~F.col("aside"), F.lit(False)).alias("used"))
    found = marked.mapInArrow(_tally, "bucket long, raw long, target long")
    found = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bucket = np.asarray(found.column("bucket"), dtype=np.int64)
    raw[bucket], target[bucket] = np.asarray(found.column("raw"), dtype=np.float64), np.asarray(found.column("target"), dtype=np.float64)
    if not target.sum():
        return Ratio(np.zeros(BUCKETS), 0.0)
    ratio = Ratio(log_ratio(raw, target, prior), 0.0)
    among = docs.join(ids, "doc_id").where("aside").select("text")
    low = _quantile(written(measure(among, ratio, []).select("score"), "calibration"), loss)
    ratio.threshold = min(0.0, float(low) - margin) if low is not None else -margin
    return ratio


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float) -> np.ndarray:
    """log P(target) - log P(raw) of every bucket, both smoothed by `prior` at the target's scale."""
    return np.log(target + prior) - np.log(raw * (target.sum() / raw.sum()) + prior)


def measure(docs: DataFrame, ratio: Ratio, carried: list[str]) -> DataFrame:
    """(text, carried) -> carried, the counts, score, base_failed, kept; one row per row.

    A null text counts as empty: no word, base_failed.  Copies get equal rows.
    """
    ship(docs.sparkSession)
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.select(*carried).dtypes)
    schema = ", ".join([kinds] * bool(carried) + [f"{c} long" for c in COUNTS] + ["score double"])
    out = docs.select(F.col("text").cast("string").alias("_text"), *carried).mapInArrow(lambda b: _measure(b, ratio, carried), schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(ratio.threshold)))
