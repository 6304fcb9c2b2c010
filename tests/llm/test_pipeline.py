import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumbline.llm import decontaminate, language_id, simhash, token_files
from plumbline.llm import queries as q

SF = "/root/testdata/sf0.001"
NUMBERS = (2, 7, 10, 3, 8)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_shape(stages):
    columns = stages[0][0].columns
    assert [n for n, _ in cp.STAGES] == ["language ID", "near-duplicates", "decontamination", "mixing", "token files"]
    assert all(after.columns == columns for _, after in stages[:-1])


def test_language_stage_drops_what_has_no_language(spark, stages):
    docs = stages[0][0]
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34 !!", "en", "src0", 8), (10**6 + 2, "", "en", None, 0)], docs.schema)
    kept = cp.language_stage(spark, docs.unionByName(odd), SF)
    assert ids(kept) == ids(docs)


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    found = simhash.near_duplicates(before).groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    assert ids(after) == ids(found)


def test_decontamination_stage(spark, stages):
    before, after = stages[2]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r[0] for r in decontaminate.leaks(before, items).select("doc_id").collect()}
    assert ids(after) == [i for i in ids(before) if i not in bad]
    assert decontaminate.leaks(after, items).count() == 0


def test_mixing_stage(spark, stages):
    from plumbline.llm import mixing

    before, after = stages[3]
    want = mixing.mix(before, []).where("copies > 0").select("doc_id", "copies").collect()
    assert ids(after) == sorted(i for i, n in want for _ in range(n))


def test_token_stage(stages):
    before, after = stages[4]
    enc = token_files.encoder(q.tokenizer_path())
    want = sorted(len(enc.tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
    rows = sorted(after.collect(), key=lambda r: r["start"])
    assert sorted(r["n_tokens"] for r in rows) == want
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_entry_registers_each_operator_once():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_confidence_is_a_bound_on_the_pooled_probability(spark):
    rows = spark.createDataFrame([("en", 0.9), ("en", 0.1), ("und", 0.0)], "lang_pred string, score double")
    assert rows.where(language_id.confident(rows)).count() == 1
