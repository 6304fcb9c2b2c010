import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import decontaminate as dc
from plumbline.llm import textscan as ts

SCHEMA = "doc_id long, text string, item_id string, containment int"


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items, share=0.8):
    out = {}
    for d, t in docs:
        mine = shingles(t)
        for i, x in items:
            s = shingles(x)
            if s and len(s & mine) >= share * len(s) - 1e-9 and i is not None:
                out[d, i] = max(out.get((d, i), 0), len(s & mine) / len(s))
    return sorted(((d, i, round(c, 9)) for (d, i), c in out.items()), key=str)


def build():
    rng = random.Random(1)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 6, 7, 12, 20, 21, 40, 90])))) for i in range(60)]
    docs = []
    for i in range(150):
        words = [word() for _ in range(rng.randint(0, 400))]
        if i % 2:
            leak = items[rng.randrange(60)][1].upper().split()
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = leak
        docs.append((i, "  ".join(words)))
    docs += [(None, items[3][1]), (None, None), (900, ""), (901, items[5][1] + "\n" + "x " * 50000), (902, "short item"), (902, "short item"), (903, "short item and more")]
    items += [(100, "short item"), (101, ""), (102, None), (None, items[0][1]), (103, "same same same same same same same same"), (7, items[8][1])]
    return docs, items


@pytest.mark.parametrize("block", [20_000, 7])
def test_pairs_match_brute_force(spark, block):
    docs, items = build()
    df = spark.createDataFrame([(*r, "clash", 1) for r in docs], SCHEMA).repartition(3)
    it = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    got = dc.contained(df, it, ["doc_id"], block=block)
    best = {}
    for r in got.collect():
        k = r["doc_id"], r["item_id"]
        best[k] = max(best.get(k, 0), r["containment"])
    assert sorted(((d, i, round(c, 9)) for (d, i), c in best.items()), key=str) == brute(docs, items)
    if block == 20_000:
        assert sorted(((r[0], r[1], round(r[2], 9)) for r in dc.leaks(df, it).collect()), key=str) == brute(docs, items)


def test_clean_drops_the_leaking_rows_alone(spark):
    docs, items = build()
    df = spark.createDataFrame([(*r, "clash", 1) for r in docs], SCHEMA)
    it = spark.createDataFrame(items, "item_id long, text string")
    kept = dc.clean(df, it, block=25)
    assert kept.columns == df.columns
    want = [(d, t) for d, t in docs if not brute([(d, t)], items)]
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_a_sketch_cannot_be_missed(share):
    """Whatever shingles a document lacks, as long as it has the share, one of the sketch is there."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 5, 10, 15, 16, 17, 33, 100):
        text = " ".join(f"t{i}" for i in range(n + 4))
        block = dc.index([(1, text)], share)
        assert block.size.tolist() == [n]
        lost = n - int(np.ceil(share * n - 1e-9))
        assert block.sketched.sum() > lost


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "", 0)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs, none).count() == 0
    assert dc.clean(docs, none).count() == 1
    assert dc.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_only_sketches_make_candidates():
    """Without its sketch an item is not searched for, and an item of any size is counted in full."""
    item = " ".join(f"t{i}" for i in range(30))
    block = dc.index([(1, item)], 0.8)
    rows, items, held = dc._pairs(pa.array(["x y " + item + " z", None]), block, 0.8)
    assert (rows.tolist(), items.tolist(), held.tolist()) == ([0], [1], [1.0])
    part = next(ts.slices(pa.array([item])))
    looked = []
    plain = np.searchsorted
    try:
        dc.np.searchsorted = lambda a, v, *more: looked.append(len(a)) or plain(a, v, *more)
        dc._pairs(pa.array([item]), block, 0.8)
    finally:
        dc.np.searchsorted = plain
    assert block.sketched.sum() in looked and block.sketched.sum() < len(dc.shingles(part)[0])
