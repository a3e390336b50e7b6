"""A corpus pipeline over `documents`: language ID, exact dedup, near dedup, packing. Each stage's rows are written and read again.

Nulls: a null or empty text, or one without a letter, has no language, so its document goes in the first stage. A null id stays where its text has no copy
with an id; its fragments carry a null id. A null source conflicts with nothing. Repeated rows are copies, so one of them stays. Ties follow the stages: of equal texts the
largest id, of near ones the smallest. A very long text is worked on whole, and packed in several fragments. An empty table gives no rows. Further columns pass through all stages
but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonamark.llm import exact_dedup, gru_langid, minhash, packing
from sonamark.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages learned go."""
    return gru_langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest doc_id stays."""
    return minhash.drop_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each fragment of each document goes."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: SQL has no recurrent network; tests hold run() and the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
