"""A training corpus in four stages: each reads what the one before kept and writes what it keeps.

All but the last stage return the rows that they keep with the columns of ``docs`` as they are, whatever their names and
whatever extra ones there are. Null texts count as empty; repeated rows are judged each; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import jaccard, packing, quality, toxicity
from quire.llm.shared import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go: null and empty texts do, as they have too few words; a
    null source has no host verdict; repeated rows are judged each."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Null and empty texts score as texts without words; without labels of both kinds
    every score is the share of toxic ones; repeated rows score alike."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id: five-word shingles, a similarity of 0.8
    or more. Null and empty texts are copies of nothing; rows with a null doc_id stay; of rows with one doc_id all stay or
    go."""
    return jaccard.keep_one(docs, k=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: doc_id, piece, start, length, ids_crc32, sequence_id and offset. A null or empty text is
    its end id alone; null doc_ids are kept; repeated rows are packed each."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]
#: Training and byte-pair coding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    keep = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep.save(docs, f"stage-{k}")
    return docs
