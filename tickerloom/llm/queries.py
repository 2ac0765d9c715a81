"""Registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import archive, infill, latent, licenses, merkle, mixing, neardup, pivots, quality, suffixes, tokens, topk, toxicity
from tickerloom.llm.tables import read_table


def op1_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    return quality.resample(documents, labels)


def op2_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read_table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op3_content_archive(spark: SparkSession, folder: str) -> DataFrame:
    return archive.round_trip(read_table(spark, folder, "pages"), min_bytes=0)


def op4_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, folder, "documents"))


def op5_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    return toxicity.classify(documents, labels)


def op6_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read_table(spark, folder, "documents"))


def op7_prefix_doubling(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.removal_report(read_table(spark, folder, "documents"))


def op8_latent_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return latent.find(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op9_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, folder, "documents"))


def op10_norm_bucket_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(read_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_sparse_exception_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.fill_in_middle(read_table(spark, folder, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


def op12_octopus_manifest(spark: SparkSession, folder: str) -> DataFrame:
    proofs = merkle.prove(merkle.build(read_table(spark, folder, "documents"), claim=merkle.tampered()))
    digest = F.sha2(F.lower(F.hex("proof")), 256)
    return proofs.select("doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"), "folded_root", "verified")


def op13_pivot_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = pivots.near_duplicates(read_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and "_" in name
}
