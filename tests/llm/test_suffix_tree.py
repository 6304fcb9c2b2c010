import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import suffix_tree as pst
from plumbline.llm import textscan as ts

SCHEMA = "doc_id long, text string, score string, n_known int"
HOW = {"p_min": 0.01, "gamma_min": 0.02, "least_pair": 3}


def tokens(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + [None]


def brute_base(rows, held):
    counts = Counter(w for (d, t), h in zip(rows, held) if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {(d, t): (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in rows}


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(150):
        words = []
        while len(words) < 60:
            words += rng.choice([["new", "york", "city"], ["the", "cat"], ["the", "dog"], [f"rare{rng.randint(0, 900)}"], ["a", "b", "c"], ["x", "b", "d"]])
        rows.append((i, " ".join(words)))
    return rows


EDGE = [(None, "New York"), (None, None), (500, ""), (501, None), (502, "unseen words only"), (502, "unseen words only"), (503, "the " * 60000), (504, "é \x1f\tß")]


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus() + EDGE
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    held = [zlib.crc32(str(d if d is not None else "").encode()) % 5 == 1 for d, _ in rows]
    return rows, held, df, pst.score_corpus(df, pst.remainder(F.col("doc_id"), 5) == 1, **HOW).collect()


def test_counts_and_base_scores(scored):
    rows, held, _, got = scored
    want = brute_base(rows, held)
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((d, h) for (d, _), h in zip(rows, held))
    by = {}
    for (d, t), w in want.items():
        by.setdefault(d, []).append(w)
    for r in got:
        assert any((r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3], rel=1e-9) for w in by[r["doc_id"]])


def reference(tree, text):
    """The tree's log10 probability of a text, word by word, from its definition."""
    data = (text or "").encode()
    part = next(ts.slices(pa.array([data.decode()]), lower=True))
    h = pst._tokens(part)[0].tolist()
    top = {x: i for i, x in enumerate(tree.hashes.tolist())}
    total = 0.0
    for t, x in enumerate(h):
        w = top.get(x)
        p = float(tree.root(tree.counts[w])) if w is not None else float(tree.root(np.float64(0)))
        for k, level in enumerate(tree.levels, 1):
            before = tuple(top.get(y, -1) for y in h[t - k : t]) if t >= k else None
            at = {tuple(ws): i for i, ws in enumerate(level.words.tolist())}.get(before)
            if at is not None and level.kept[at]:
                stored = dict(zip(level.codes.tolist(), level.mass.tolist()))
                p = level.rest[at] * p + (stored.get(int(at) * pst.TOP + w, 0.0) if w is not None else 0.0)
        total += math.log10(p)
    return total


def test_scores_follow_the_definition_and_help(spark, scored):
    rows, held, df, got = scored
    train = df.where(~(pst.remainder(F.col("doc_id"), 5) == 1))
    tree, _ = pst.train(train, **HOW)
    assert sum(level.kept.sum() for level in tree.levels) >= 3
    texts = dict(rows)
    for r in got[:60]:
        if r["doc_id"] is not None and r["doc_id"] < 500:
            assert r["score"] == pytest.approx(reference(tree, texts[r["doc_id"]]), rel=1e-9)
    out = [r for r in got if r["held_out"] and (r["doc_id"] or 0) < 500]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 10


def test_distributions_sum_to_one(spark):
    tree, _ = pst.train(spark.createDataFrame(corpus(), "doc_id long, text string"), **HOW)
    words = np.arange(len(tree.hashes))
    root = tree.root(tree.counts)
    assert root.sum() + tree.root(np.float64(0)) == pytest.approx(1)
    for depth, level in enumerate(tree.levels):
        for c in np.flatnonzero(level.kept):
            p = pst._step(level, np.full(len(words), c), words, root)
            assert p.min() > 0
            assert p.sum() + level.rest[c] * tree.root(np.float64(0)) == pytest.approx(1)


def test_independent_words_keep_no_context(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(100))) for i in range(200)]
    tree, _ = pst.train(spark.createDataFrame(rows, "doc_id long, text string"), **HOW)
    assert sum(level.kept[: len(level.kept)].sum() for level in tree.levels[1:]) <= 2


def test_words_beyond_the_top_list(spark, monkeypatch):
    rows = corpus()
    want = brute_base(rows, [False] * len(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree, vocabulary = pst.train(df, **HOW)
    few = np.sort(np.argsort(-tree.counts)[:10])
    small = pst.Tree(tree.total, tree.distinct, tree.hashes[few], tree.counts[few], [])
    for r in pst.score(df, small, vocabulary, ["doc_id"]).collect():
        w = want[rows[r["doc_id"]]]
        assert (r["n_tokens"], r["n_known"]) == w[:2] and r["base_score"] == pytest.approx(w[3]) and r["score"] == pytest.approx(w[3])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pst.score_corpus(df, F.lit(False)).count() == 0
    only = pst.score_corpus(spark.createDataFrame([(1, "a", "", 0)], SCHEMA), F.lit(True)).first()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"]) == (2, 0, 0, 0.0)


def test_rare_contexts_count_and_tables_match_the_tree_in_memory(spark, monkeypatch):
    """Contexts of 20 occurrences in 60,000 words are retained; most runs are joined, and every score is that of the tree."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(300))) for i in range(200)]
    rows += [(200 + i, " ".join([rng.choice(common), "deep", f"k{i % 4}", "v", "w", f"z{i % 4}", f"p{i % 2}", "q", f"r{i % 2}"])) for i in range(80)]
    rows += [(300, None), (301, ""), (302, "z1 deep k1 v w z1 unseen p0 q r0 deep k2"), (303, "deep")]
    monkeypatch.setattr(pst, "HOT", 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tree, vocabulary, runs = pst.grow(df)
    assert runs.table.count() > 20 and 0 < len(runs.hashes) <= 10
    exact, _ = pst.train(df, depth=3, p_min=8 / tree.total, gamma_min=0)
    assert all(level.kept.any() for level in exact.levels) and len(exact.levels) == 3
    texts = dict(rows)
    got = pst.score_corpus(df, F.lit(False)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] >= 190:
            assert r["score"] == pytest.approx(reference(exact, texts[r["doc_id"]]), rel=1e-8), r
    by = {r["doc_id"]: r for r in got}
    assert by[203]["score"] > by[203]["base_score"] + 5


def test_grown_tree_of_nothing(spark):
    _, _, runs = pst.grow(spark.createDataFrame([], "text string"))
    assert runs.table.count() == 0 and not len(runs.hashes)
