"""Corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from captionlake.llm import jaccard_join, line_frequency, packing, substring_dedup, toxicity
from captionlake.llm.common import Scratch, shared_folder, small_batches
from captionlake.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last = threading.local()


def _scratch(spark: SparkSession) -> Scratch:
    """Work tables of a stage. Those of the stage before it in this thread go, as its result has been written."""
    if before := getattr(_last, "scratch", None):
        before.release()
    small_batches(spark)
    _last.scratch = Scratch(spark)
    return _last.scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The classifier is fitted on the labels, its language model on the stage's input.

    Null and empty texts have the score of a text without features; null ids are never fitted on; repeated rows go or stay
    together; no rows give none.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch=_scratch(spark))
    return toxicity.reject_toxic(docs, model)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limit go from the texts; documents that fail the rules or are depleted go.

    Null, empty and short texts fail; a null source is a host of its own; repeated rows count as one document and go or stay
    together; no rows give none.
    """
    return line_frequency.clean(docs, scratch=_scratch(spark))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 over five-word shingles, the document of the smallest id stays.

    Null ids come last, and of equal ids the text decides; rows of equal id and text become one; texts without words link
    to nothing and stay; no rows give none.
    """
    return jaccard_join.keep_one(docs, percent=80, words=5, scratch=_scratch(spark))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that occur elsewhere as well go from the texts.

    Null and empty texts stay as they are; repeated rows are each other's copies and become empty; no rows give none.
    """
    return substring_dedup.remove(docs, scratch=_scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces in sequences of at most 2048.

    A null or empty text is a piece of its end id alone; null ids stay null; repeated rows are packed each; no rows give none.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), scratch=_scratch(spark))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Character lattices, hashes of 35-word windows and best-fit packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/corpus-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    _scratch(spark)
    return docs
