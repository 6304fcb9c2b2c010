import hashlib
import random

import pytest

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, active = share * sum(sizes.values()), {}, set(order)
    while active:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in active}
        target |= {s: float(most * sizes[s]) for s in over}
        active -= over
    return target


def hash60(doc_id, text):
    key = str(doc_id) if doc_id is not None else "text:" + (text or "")
    return int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:15], 16)


def brute(rows):
    sizes, of = {}, {}
    for d, t, s in rows:
        n = len((t or "").encode().split())
        sizes[s] = sizes.get(s, 0) + n
        of.setdefault(s, {}).setdefault(hash60(d, t), []).append(n)
    target = brute_targets(sizes)
    taken = {}
    for s, hashes in of.items():
        passes = min(2, int(target[s] // sizes[s])) if sizes[s] else 0
        budget, before = target[s] - passes * sizes[s], 0
        for h in sorted(hashes):
            n = sum(hashes[h])
            taken[s, h] = passes + (before + n / 2 <= budget if passes < 2 else 0)
            before += n
    return sorted((str(d), n, sizes[s], round(target[s], 6), n * taken[s, hash60(d, t)]) for d, t, s in rows for n in [len((t or "").encode().split())] )


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA)
    got = mixing.mix(df.repartition(3), ["source"]).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got if r["size"]) == [x for x in brute(rows) if x[1]]
    assert len(got) == len(rows)
    return df, got


def test_random_sources_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "ä", "Z", None] + ["hot"] * 5)) for i in range(700)]
    df, got = check(spark, rows)
    by = {}
    for r in got:
        x = by.setdefault(r["c0"], [0, r["target"], 0])
        x[0] += r["taken"]
        x[2] = max(x[2], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(t - goal) <= most / 2 + 1e-6 for t, goal, most in by.values())
    again = mixing.mix(df.coalesce(1), []).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \x1f ", "b"), (None, "x y", None), (None, "x y", None), (4, "w " * 50000, "c"), (5, "one", "c"), (5, "one", "c"), (6, None, "empty")]
    check(spark, rows)


def test_empty_table_and_wordless_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), []).count() == 0
    only = mixing.mix(spark.createDataFrame([(1, "", "a", "", 0), (2, None, None, "", 0)], SCHEMA), []).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2


def test_mix_repeats_rows(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == pytest.approx(135, abs=3)


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a", "s", "", 0)], SCHEMA)
    plan = mixing.mix(df, [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
