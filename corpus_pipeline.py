"""Corpus pipeline: five stages, each reading what the one before it kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``documents``; the last
returns the documents as read back from the committed shards, with shard, shard_rows and version.

For all stages: an empty table gives an empty result with the same columns; texts of any length are read whole; every column of the
input is carried along, also under a name that an operator uses itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogline.llm import decontaminate, language_id, mixing, near_dedup, sharding
from fogline.llm._scratch import Scratch

#: Bits per symbol from which no learned language explains a text. Prose of a learned language takes two to three bits,
#: single words up to five; letters that no sample holds take about fifteen.
MAX_BITS = 7.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled documents teach; texts without a letter and texts that no language
    explains go. The stored lang column is not changed.

    Null, empty and blank texts go, as they have no letter. Rows that repeat a text or an id are judged each, and alike.
    """
    model = language_id.fit(docs)
    row = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    found = language_id.identify_languages(row, model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_symbol") <= MAX_BITS)).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates: the smallest doc_id.

    Null, empty and blank texts are alike with nothing and stay. Rows that repeat an id are one document, of which one row
    stays; rows with a null id are left alone.
    """
    return near_dedup.drop_near_duplicates(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark item is found.

    Null, empty and blank texts hold no item and stay, and so do all documents beside an empty benchmark. Rows that repeat an
    id are judged each by its own text; null ids do not matter.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw every source up or down to its target; a document may come twice or not at all.

    Null, empty and blank texts have no words and are never drawn. A null source is a source of its own, the last. Rows that
    repeat an id are drawn each.
    """
    return mixing.emit_mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents as compacted shards and read the committed version. All rows stay, nulls, repeats and empty texts
    too."""
    return sharding.shard_documents(docs, Scratch(spark, "shards").path("store"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_near_duplicates),
    ("decontaminate", without_benchmarks),
    ("mix_sources", mixed),
    ("sharding", sharded),
]

#: Languages, similarity and edit distances are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what a stage returns is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
