"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage is (spark, docs, sf_dir) -> DataFrame; it works on all that the stage before
kept, and its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language_id, mixing, simhash, token_files
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.session import shared_path, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised with some confidence."""
    net = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    names = tuple("_" * (1 + max(len(c) for c in docs.columns)) + n for n in ("language", "score"))  # of no column of docs
    found = language_id.identify(docs, net, docs.columns, names)
    return found.where(language_id.confident(found, names=names)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per document written."""
    path = shared_path(spark, "tokens")
    token_files.write_token_files(docs, path, tokenizer_path(), end_id=2)
    rows = token_files.with_starts(token_files.read_token_files(spark, path, digest=True), path)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", language_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token files", token_stage),
]

#: SQL can express neither the network nor the tokenizer; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
