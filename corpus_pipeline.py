"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tickerloom.llm import pipeline  # noqa: E402
from tickerloom.llm.tables import read_table, settle  # noqa: E402

STAGES = [
    ("toxicity", pipeline.toxicity_stage),
    ("minhash_near_dedup", pipeline.near_dedup_stage),
    ("suffix_array_dedup", pipeline.suffix_dedup_stage),
    ("benchmark_decontamination", pipeline.decontamination_stage),
    ("mixing", pipeline.mixing_stage),
]

#: The stages train a classifier and search in a latent space, which SQL cannot express;
#: tests/llm/test_pipeline.py holds the rows against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
