"""A training corpus from ``documents``: good texts, one of each group of near-duplicates, without benchmark passages and secrets, packed.

Every stage takes all its predecessor kept, written as Parquet and read again; all but the last return the columns of documents.
Null, empty and very long texts, repeated rows and null doc_ids are as in the stages' operators: texts without words are kept by the first four stages and
packed as an end id alone; rows that repeat an id and a text become one; rows without doc_id count as rows of one id. Other columns pass unchanged, whatever their
names; an empty table gives none.

The quality model learns from ``labels``, as its query does; the benchmark is the whole ``benchmark`` table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.llm import decontaminate, jaccard_tree, knn_quality, packing, secrets
from tradewind.llm.shared import shared_folder, small_batches, stored, unused
from tradewind.llm.tokenizing import default_vocabulary

# The executors that run packing have run all other stages before. Less than alone is kept and encoded at a time, for more CPU time.
KNOWN_WORDS = 200_000
ENCODED_CHARS = 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents (score below 0.3) go."""
    small_batches(spark)
    return knn_quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of five-word Jaccard 0.75 and more, the document with the smallest doc_id stays."""
    small_batches(spark)
    return jaccard_tree.one_of_each(spark, docs, shared_folder(spark, "pipeline-near-duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    small_batches(spark)
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    found = unused(docs, "secret_spans")
    return secrets.masked(secrets.spans(docs, into=found), spans=found).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens and their places in sequences."""
    small_batches(spark)
    packed = packing.pack(spark, docs, shared_folder(spark, "pipeline-packing"), default_vocabulary(), words=KNOWN_WORDS, chars=ENCODED_CHARS)
    return packing.digest(packed)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

# Learned scores, edit distances and tokenizer ids have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/stage-{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
