"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes the
result of every stage as Parquet in the shared folder and rereads it as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from sward.llm import common as C
    return C.table(spark, sf_dir, name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level random field does not reject.  NULL and empty texts are scored like any other."""
    from sward.llm.quality import keep_good
    return keep_good(spark, docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near copies on 5-word shingles at 0.8.

    Texts without words and rows without a doc_id stay; rows repeated with one doc_id stay or go together.
    """
    from sward.llm.minhash import drop_near_duplicates
    return drop_near_duplicates(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs of passages that repeat another document's; every row stays, also an emptied one."""
    from sward.llm.paragraphs import drop_repeated_paragraphs
    return drop_repeated_paragraphs(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.  NULL and empty texts and rows without a doc_id stay."""
    from sward.llm.decontam import drop_leaks
    return drop_leaks(spark, docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens; an empty text is its end token."""
    from sward.llm.packing import pack_documents
    from sward.llm.queries import tokenizer_path
    return pack_documents(docs, tokenizer_path(), keep_cache=False)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

#: The random field and the tokenizer are beyond SQL; tests/llm/test_pipeline.py compares every stage behind the first with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written and read again.  Extra columns go through all stages but the last."""
    from sward.llm import common as C
    scratch = C.Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        result = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = result
    return docs
