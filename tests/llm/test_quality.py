import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import quality as ql
from plumbline.llm import textscan as ts

SCHEMA = "doc_id long, text string, score string, kept int"


def brute(text):
    raw = (text or "").encode()
    words = raw.split()
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in raw.split(b"\n") if x.split()]
    counts = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
    return counts, len(words) < 10 or 100 * len(covered) > 20 * len(words)


def measured(values):
    ratio = ql.Ratio(np.zeros(ql.BUCKETS), 0.0)
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(range(len(values)))], names=["t", "i"])
    out = next(ql._measure(iter([batch]), ratio, ["i"]))
    return [tuple(r[c] for c in ql.COUNTS) for r in out.to_pylist()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\t", "\n\n", "a b c d e ", "<|>"]), max_size=40).map("".join)), min_size=1, max_size=5))
def test_counts(values):
    assert measured(values) == [brute(v)[0] for v in values]


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        words = [rng.choice(["WIN!!", "$$$", "CASH!!", "|", "%%%"]) if junk else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, int(not junk), 0))
    return rows, labels


def test_ratio_is_that_of_the_counts_and_tells_junk(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    trusted = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("quality = 1")
    ratio = ql.fit(docs.repartition(5), trusted)
    ids = np.array(sorted(d for d, q, _ in labels if q), dtype=np.int64)
    good = set(ids[ts.mix(ids.astype(np.uint64)) % np.uint64(5) != 0].tolist())
    raw, target = np.zeros(ql.BUCKETS), np.zeros(ql.BUCKETS)
    for d, t in rows:
        for part in ts.slices(pa.array([t])):
            for bucket, _ in ql._grams(part):
                c = np.bincount(bucket, minlength=ql.BUCKETS)
                raw += c
                target += c * (d in good)
    for b in np.flatnonzero(raw)[:500]:
        want = math.log((target[b] + 10) / (target.sum() + 10 * ql.BUCKETS)) - math.log((raw[b] / raw.sum() * target.sum() + 10) / (target.sum() + 10 * ql.BUCKETS))
        assert ratio.log_ratio[b] == pytest.approx(want)
    got = ql.measure(docs, ratio, ["doc_id"]).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & set(range(0, 400, 5))
    assert len(set(range(400)) - set(range(0, 400, 5)) - kept) <= 4
    again = {r["doc_id"]: r["score"] for r in ql.measure(docs.coalesce(1), ql.fit(docs.coalesce(1), trusted), ["doc_id"]).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in got)


def test_edge_rows(spark):
    values = [None, "", " ", "a", "a b c d e f g h i j", "x " * 30000, "line\n" * 20, "é " * 11 + "\n\n"]
    rows = [(i if i else None, v) for i, v in enumerate(values)] * 2
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    ratio = ql.fit(docs, spark.createDataFrame([(None,)], "doc_id long"))
    got = ql.measure(docs, ratio, ["doc_id"]).collect()
    assert len(got) == len(rows)
    of = dict((i if i else None, v) for i, v in enumerate(values))
    for r in got:
        counts, failed = brute(of[r["doc_id"]])
        assert tuple(r[c] for c in ql.COUNTS) == counts and r["base_failed"] == failed and r["kept"] == (not failed)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ql.measure(docs, ql.fit(docs, spark.createDataFrame([(1,)], "doc_id long")), ["doc_id"]).count() == 0


@pytest.mark.parametrize("run", [1, 3, 7, 1 << 20])
def test_grams_do_not_depend_on_the_run(run):
    values = ["abcdef", None, "", "x", "é漢", "yz" * 10]
    part = next(ts.slices(pa.array(values)))
    got = sorted((d, b) for bucket, doc in ql._grams(part, run) for b, d in zip(bucket.tolist(), doc.tolist()))
    alone = []
    for i, v in enumerate(values):
        one = next(ts.slices(pa.array([v], pa.string())))
        alone += [(i, b) for bucket, _ in ql._grams(one) for b in bucket.tolist()]
    assert got == sorted(alone) and len(got) == sum(max(0, len((v or "").encode()) - n + 1) for v in values for n in ql.SIZES)


@pytest.mark.parametrize("small", [1_000_000, 100])
def test_every_trusted_row_counts(spark, monkeypatch, small):
    """More than 20,000 trusted rows: the target counts all four fifths, the quantile all the rest."""
    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "'ab' as text")
    monkeypatch.setattr(ql, "SMALL", small)
    seen = []
    plain = ql.log_ratio
    ql.log_ratio = lambda raw, target, prior: seen.append((raw.sum(), target.sum())) or plain(raw, target, prior)
    try:
        ql.fit(docs, docs.select("doc_id"))
    finally:
        ql.log_ratio = plain
    ids = np.arange(n, dtype=np.uint64)
    assert seen == [(n, (ts.mix(ids) % np.uint64(5) != 0).sum())]


def test_quantile_is_interpolated(spark):
    scores = spark.range(1000).selectExpr("cast(999 - id as double) as score")
    assert ql._quantile(scores, 0.002) == pytest.approx(np.quantile(np.arange(1000), 0.002))
    assert ql._quantile(scores.limit(0), 0.002) is None
