"""A training corpus from the documents table, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.common import Scratch, fold
from clausemill.llm.decontaminate import drop_leaks
from clausemill.llm.langid import keep_known_languages, train_language_id
from clausemill.llm.mixing import mixed_stream
from clausemill.llm.ngram_join import drop_near_copies
from clausemill.llm.sharding import shard_documents


# Every stage works on all rows of its input, and returns all but the last their columns as they are: no name of an
# extra column clashes with what a stage works out. An empty table gives an empty table.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null or has no letter, and those whose language the model isn't sure of.

    The model learns from rows with a language; without any, all documents are dropped. Repeated rows share their fate.
    """
    model = train_language_id(docs, fold(F.col("doc_id"), 4) != 2)
    return keep_known_languages(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id: five-word shingles, similarity 0.8.

    Null ids come last. Texts without words link with nothing; of rows equal in id and text one stays.
    """
    return drop_near_copies(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, give or take its error budget. Null and empty texts hold none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per copy taken, whole, in the order of virtual finish times.

    A null source is a source of its own; texts without words are never sent; repeated rows queue one after the other.
    """
    return mixed_stream(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with the shard it goes to, and that shard's bytes; a null text has none. Repeated rows go to pages where they are too many."""
    return shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Hashed subword models, hash order and hash prefixes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
