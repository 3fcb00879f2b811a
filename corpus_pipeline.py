"""Corpus pipeline over documents: toxic texts go, one document of each near-duplicate group
stays, repeated passages are cut, documents with benchmark passages go, the rest is tokenised.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; stages
are written as Parquet below the shared folder and read back.  Nothing of it has an SQL form
(fitted model, MinHash forest, sentence runs, merges), so ORACLE_SQL is None and the stages are
tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import contamination, forest, pieces, repeats, toxicity
from radiolake.llm.tables import small_batches, table
from radiolake.session import persist_table

ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of the text) is not among ``dropped``."""
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    return docs.join(dropped, same, "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, fitted on the labelled ones not held out, doesn't reject."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=docs.columns)
    return scored.where("score < 0.5").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more join, the one of smallest
    id; rows that agree in id and text are one document and stay together."""
    small_batches(spark)
    classes = forest.similarity_classes(docs)
    return _without(docs, classes.where("NOT kept"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences of runs that an earlier document holds."""
    small_batches(spark)
    cut = repeats.remove_repeats(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    small_batches(spark)
    index = contamination.build_index(docs)
    found = contamination.contamination(index, contamination.phrase_matches(index, table(spark, sf_dir, "benchmark")))
    return _without(docs, persist_table(found.where("n_hit > 0").select("doc_id", "th"), "contaminated"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, agrees) of every document that is left."""
    small_batches(spark)
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "agrees")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", contamination_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
