import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import textscan as ts
from plumbline.llm import token_files as tf
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.session import shared_path

PATH = tokenizer_path()
alphabet = list("ab'sé 'tA1.,\n\t ß") + [" ", "　", "́", "漢", "😀", " ", " the", "<|endoftext|>", "\x85", "\x1f"]


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(alphabet), max_size=25).map("".join), max_size=4))
def test_pieces_encode_as_whole_texts(values):
    enc, whole = tf.encoder(PATH), plain()
    for part in ts.slices(pa.array(values, pa.string())):
        ids, first = enc.encode(part)
        for i in range(part.n_docs):
            assert ids[first[i] : first[i + 1]].tolist() == whole.encode(values[part.first + i], add_special_tokens=False).ids


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n)), "".join("ba"[bin(i).count("1") & 1] for i in range(n))


def test_texts_of_like_structure_keep_their_own_ids():
    for values in (thue_morse(1024), thue_morse(4096), [x + " y" for x in thue_morse(2048)]):
        ids, first = tf.Encoder(PATH).encode(next(ts.slices(pa.array(values))))
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(2)] == [e.ids for e in plain().encode_batch(list(values), add_special_tokens=False)]


def test_pieces_whose_hashes_meet_are_told_by_their_bytes(monkeypatch):
    monkeypatch.setattr(ts, "span_hashes", lambda buf, a, b: ((b - a) % 3).astype(np.uint64))
    enc, texts = tf.Encoder(PATH), ["some words of one length abc xyz", "x" * 90 + " " + "y" * 90, "abc def abc ghi" * 2, "<|endoftext|>"]
    for values in (texts, texts[::-1], texts):
        ids, first = enc.encode(next(ts.slices(pa.array(values))))
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(4)] == [e.ids for e in plain().encode_batch(values, add_special_tokens=False)]


def test_special_strings_are_the_librarys_tokens():
    ids, _ = tf.encoder(PATH).encode(next(ts.slices(pa.array(["a <|endoftext|> b"]))))
    assert 50256 in ids.tolist() and ids.tolist() == plain().encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    enc = tf.Encoder(PATH)
    monkeypatch.setattr(tf.Encoder, "MOST", 3)
    texts = [f"the word{i} and more é{i}" for i in range(50)]
    for _ in range(2):
        for part in ts.slices(pa.array(texts)):
            ids, first = enc.encode(part)
            assert [ids[first[i] : first[i + 1]].tolist() for i in range(50)] == [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]


ROWS = [(5, "hello world"), (-3, None), (None, "no id"), (2, ""), (2, "same id"), (9, "x" * 200_000), (7, "a b " * 60_000), (5, "hello world"), (11, "é漢😀\0 <|endoftext|>")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id long, text string, start string, n_tokens int")
    path = shared_path(spark, "t")
    tf.write_token_files(df.repartition(3), path, PATH)
    rows = sorted(tf.with_starts(tf.read_token_files(spark, path), path).collect(), key=lambda r: r["start"])
    want = [(d, plain().encode(t or "", add_special_tokens=False).ids + [2]) for d, t in ROWS]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [r["doc_id"] for r in rows] == [d for d, _ in sorted(want, key=key)]
    assert sorted(((str(r["doc_id"]), r["ids"]) for r in rows)) == sorted((str(d), i) for d, i in want)
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()
    crc = {(r["doc_id"], r["n_tokens"]): r["ids_crc32"] for r in tf.read_token_files(spark, path, digest=True).collect()}
    assert all(crc[d, len(i)] == zlib.crc32(np.array(i, dtype="<u4").tobytes()) for d, i in want)
    only = tf.read_token_files(spark, path, only=[2, 11]).collect()
    assert sorted(r["doc_id"] for r in only) == [2, 2, 11]
    assert tf.read_token_files(spark, path, only=[10**9]).count() == 0
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(r["documents"] for r in manifest) == len(ROWS) and sum(r["without_id"] for r in manifest) == 1
    assert sum(r["tokens"] for r in manifest) == sum(r["n_tokens"] for r in rows)


def test_shards_are_bounded_by_bytes(spark):
    path = shared_path(spark, "t")
    df = spark.range(60).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 100) AS text")
    tf.write_token_files(df, path, PATH, shard_bytes=4000)
    assert spark.read.parquet(f"{path}/manifest").count() >= 9
    assert [r["doc_id"] for r in tf.with_starts(tf.read_token_files(spark, path), path).orderBy("start").collect()] == list(range(60))


def test_a_torn_or_foreign_shard_is_refused(spark):
    df = spark.createDataFrame(ROWS[:2], "doc_id long, text string").coalesce(1)
    path = shared_path(spark, "t")
    tf.write_token_files(df, path, PATH)
    folder = path.removeprefix("file://") + "/shards"
    name = next(f for f in os.listdir(folder) if f.startswith("part-") and os.path.getsize(f"{folder}/{f}"))
    data = open(f"{folder}/{name}", "rb").read()
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()[0])
    assert tf.Shard(data, dictionary).n_tokens.sum() > 0
    with pytest.raises(ValueError):
        tf.Shard(data[:-30] + data[-20:], dictionary)
    with pytest.raises(ValueError):
        tf.Shard(data, b"other dictionary, other hash")


def test_empty_table(spark):
    path = shared_path(spark, "t")
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tf.with_starts(tf.read_token_files(spark, path), path).count() == 0
