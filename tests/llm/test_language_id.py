import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id as li
from plumbline.llm import textscan as ts

LANGS = {"aa": "kila mono tuba reso", "bb": "schwirz pfon glanst krumt", "cc": "él añó cióñ ré"}


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(rng.choice(sorted(LANGS)) for _ in range(n))]


def test_gradients_are_those_of_the_loss():
    net = li.Network.fresh(["x", "y", "z"], 3, 0)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rows = np.array([[97, 98, 99], [99, 99, 97]])
    label, weight = np.array([0, 2]), np.array([1.0, 2.0])
    _, g = net.gradients(rows, label, weight)
    rng = np.random.default_rng(0)
    for name, w in net.weights.items():
        for _ in range(4):
            at = (97,) + tuple(rng.integers(0, s) for s in w.shape[1:]) if name.endswith("x") else tuple(rng.integers(0, s) for s in w.shape)
            old = w[at]
            w[at] = old + 1e-3
            up, _ = net.gradients(rows, label, weight)
            w[at] = old - 1e-3
            down, _ = net.gradients(rows, label, weight)
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_learns_and_defines_edge_rows(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    net = li.train(docs, epochs=12)
    assert net.languages == sorted(LANGS)
    rows = [*corpus(40, 2), (900, None, "aa"), (901, "", None), (902, " 123 ++ \n", "bb"), (903, "漢字", None), (904, "kila " * 40000, None), (904, "kila " * 40000, None)]
    test = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred2 string, n double")
    got = li.identify(test.repartition(3), net, ["doc_id", "lang", "n"]).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang in rows[:40])
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert by_id[903]["lang_pred"] in LANGS and by_id[904]["lang_pred"] == "aa"


def test_a_text_scores_alike_wherever_it_stands(spark):
    net = li.train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"), epochs=2)
    text = "kila schwirz averyveryveryveryverylongwordwithoutanyspace " * 3
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    many = spark.createDataFrame([(i, t) for i, t, _ in corpus(30, 3)] + [(1000, text)], "doc_id long, text string").coalesce(1)
    a = li.identify(one, net, ["doc_id"]).first()
    b = li.identify(many, net, ["doc_id"]).where("doc_id = 1000").first()
    assert a["score"] == pytest.approx(b["score"], abs=2e-4) and a["lang_pred"] == b["lang_pred"]


def one_position_at_a_time(net, data):
    """The network's distributions over a text, from its equations, one byte and one number at a time."""
    bend = lambda x: x / (1 + abs(x))
    sig = lambda x: 0.5 + 0.5 * bend(x)
    w, n = {k: v.astype(np.float64) for k, v in net.weights.items()}, net.hidden
    states = {}
    for d, order in (("f", range(len(data))), ("b", range(len(data) - 1, -1, -1))):
        h = np.zeros(n)
        for t in order:
            a, b = w[d + "x"][data[t]] + w[d + "c"], h @ w[d + "h"]
            z, r = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
            h = (1 - z) * bend(a[2 * n :] + r * b[2 * n :]) + z * h
            states[d, t] = h
    y = np.array([np.exp(np.concatenate([states["f", t], states["b", t]]) @ w["o"] + w["oc"]) for t in range(len(data))])
    return y / y.sum(axis=1, keepdims=True)


def test_windows_label_every_byte_once_and_match_a_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(li, "WINDOW", 40)
    monkeypatch.setattr(li, "MARGIN", 6)
    net = li.Network.fresh(["x", "y", "z"], 5, 3)
    texts = ["kila mono", "", "a", "x" * 40, "word after word, blanks too " * 9, "y" * 41, None, "é" * 77]
    part = next(ts.slices(pa.array(texts), lower=True))
    got = li.distributions(net, part)
    doc, start, length, low, high = li._windows(part.offs)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        own = [(s - part.offs[i] + a, s - part.offs[i] + b) for d, s, a, b in zip(doc, start, low, high) if d == i]
        assert [x for a, b in own for x in range(a, b)] == list(range(len(data)))
        want = np.zeros(3)
        for d, s, n, a, b in zip(doc, start, length, low, high):
            if d == i:
                want += one_position_at_a_time(net, part.buf[s : s + n])[a:b].sum(axis=0)
        assert np.allclose(got[i], want / max(len(data), 1), atol=1e-5)


def test_neighbouring_words_and_blanks_count():
    net = li.Network.fresh(["x", "y"], 5, 3)
    one, other = (net.positions(np.frombuffer(x, dtype=np.uint8)[None])[:, :, 0] for x in (b"ab cd", b"xy cd"))
    assert abs(one[3:] - other[3:]).max() > 1e-3  # the second word's labels depend on the first


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "abc", "l", 2)], "doc_id long, text string, lang_pred string, score int")
    assert li.identify(docs, None, docs.columns).columns == ["doc_id", "text", "lang_pred", "score"]
    net = li.Network.fresh(["x"], 2, 0)
    assert li.identify(docs, net, docs.columns).first()["lang_pred"] == "x"


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.train(empty) is None
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert li.train(docs) is None
    r = li.identify(docs, None, ["doc_id"]).first()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert li.identify(empty, None, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held_out", li.held_out(F.col("doc_id")))
    net = li.train(docs.where("not held_out"))
    found = li.identify(docs, net, ["held_out", "lang"]).where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    assert found.where(~li.confident(found)).count() == 0
