import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import components, simhash
from plumbline.llm import textscan as ts

SCHEMA = "doc_id long, text string, fp string, u long"


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    n = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(label, 2):
            if bin(a ^ b).count("1") <= 3 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
                changed = True
    return label


def brute(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    label = brute_components({p for _, p in prints})
    least = {}
    for d, p in prints:
        if d is not None:
            least[label[p]] = min(least.get(label[p], d), d)
    return sorted(((d, p, least.get(label[p])) for d, p in prints), key=str)


def test_terms_cover_every_five_positions():
    assert all(any(set(t) <= set(five) for t in simhash.TERMS) for five in combinations(range(8), 5))


def test_edge_rows_match_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the others in the wide field"
    rows = [
        (1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "ONE"), (8, "one two"), (9, base + " x"),
        (9, base + " x"), (None, base), (None, None), (12, "é ü ß"), (13, "word " * 30000), (14, "word " * 29999),
    ]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=str) == brute(rows)


def test_random_near_copies_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for k in range(12):
            text = list(base)
            for _ in range(k % 4):
                text[rng.randrange(400)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("short,split", [(512, 1 << 17), (2, 1 << 17), (2, 5)])
def test_every_way_of_searching_a_list_finds_all_links(spark, short, split):
    rng = np.random.default_rng(3)
    prints = set()
    for _ in range(25):
        base = int(rng.integers(0, 1 << 63))
        for _ in range(8):
            x = base
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                x ^= 1 << int(b)
            prints.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = components.components(simhash.links(spark.createDataFrame(signed, "fp long"), short, split)).collect()
    got = {}
    for r in found:
        got.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
    want = {}
    for p, root in brute_components(prints).items():
        want.setdefault(root, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.deduplicate(df).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(3, text), (1, text), (1, text), (2, text + "  "), (7, "other words are here today"), (None, text), (None, "alone 1 2"), (None, "alone 1 2"), (5, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, text), (7, "other words are here today"), (None, "alone 1 2"), (5, None)], key=str)


def test_deduplicate_tells_groups_apart_by_their_texts(spark):
    """Repeated and missing ids, and columns named as the operator's own might be."""
    words = [f"w{i}" for i in range(400)]
    near = " ".join(["other", *words[1:]])
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(400))
    prints = [r["fp"] & (1 << 64) - 1 for r in simhash.near_duplicates(spark.createDataFrame([(1, a), (2, near)], "doc_id long, text string")).collect()]
    assert prints[0] != prints[1] and bin(prints[0] ^ prints[1]).count("1") <= 3
    rows = [(1, a, 0, "x", "y"), (1, b, 0, "x", "y"), (2, near, 0, "x", "y"), (3, b, 0, "x", "y")]
    schema = "doc_id long, text string, _null int, _id string, root string"
    kept = simhash.deduplicate(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "_null", "_id", "root"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b)])
    assert simhash.deduplicate(spark.createDataFrame([(None, t, *r) for _, t, *r in rows], schema)).count() == 2


def test_chain_of_links(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(1000, 1001), (5, 5), (None, 3)], "u long, v long"))
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 11, 12, 13, 40])
def test_long_documents_are_taken_in_runs(n):
    text = " \n".join(f"W{i * i}" for i in range(n))
    part = next(ts.slices(pa.array([text or " "]), lower=True))
    assert simhash.long_fingerprint(part, run=5) == brute_print(text)
