"""A corpus from documents to token files: toxic documents go, of near-copies one stays, contaminated documents go, sources are
mixed to their weights, and the rest is written as token ids. Each stage's result is written and read again."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import without_contaminated
from tessera.llm.mixture import mixed
from tessera.llm.ngram_join import one_of_each
from tessera.llm.queries import WEIGHTS, table, tokenizer_path, toxicity_model
from tessera.llm.tokens import documents_through_files
from tessera.llm.toxicity import not_toxic
from tessera.session import delete, scratch, shared_path

#: The stages hold steps that SQL has no words for, so the rows are tested against a plain version of all stages (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled documents, does not call toxic. Null and empty texts stay."""
    return not_toxic(docs, toxicity_model(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share at least 0.8 of their five-word shingles, that with the smallest id. Null ids and texts without words stay; rows
    with equal ids stay or go together."""
    return one_of_each(docs, words=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth are in passages of the benchmark. Null and empty texts stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them. Texts without words carry nothing towards a target and go."""
    return mixed(docs, WEIGHTS, most=3)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files in the shared folder; the rows are what the files hold. A null text has its end id alone."""
    return documents_through_files(docs, tokenizer_path(), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", mixture),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote on its way is deleted when its result is written, and a result when the next one is; the files of
    the last stage, which are what the pipeline makes, stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark) if (name, stage) != STAGES[-1] else nullcontext():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
