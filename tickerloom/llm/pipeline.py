"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``documents``. Rows with null or empty texts are clean and stay; a
document that suffix-array dedup empties goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import latent, mixing, neardup, suffixes, toxicity
from tickerloom.llm.tables import read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return neardup.one_of_each(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts."""
    cut = suffixes.without_repeats(docs).filter((F.col("removed") == 0) | (F.trim("row.text") != ""))
    length = F.when(F.col("row.n_chars").isNotNull(), F.length("row.text").cast("long"))
    return cut.select(*[length.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return latent.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")
