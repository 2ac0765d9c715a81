"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are integers, ``floor(1024 * x)``. Candidates are grouped into buckets of similar length, and a
bucket into blocks of at most ``BLOCK_ROWS``. A first pass scores each query against the block of the
longest vectors; its k-th score is a floor that no final score can be below. Blocks too short for every query of
a block of queries are dropped before any vector moves. In the second pass a query meets a block with the local cosine threshold ``floor / (|q| * longest in block)``: above 1 the block is
skipped; if it is high, coordinate pruning keeps the vectors whose values on the query's strongest
coordinates could still reach that cosine; else length pruning keeps those long enough. What is left is
verified by exact integer products, and the k best of each block are ranked.

Query and candidate blocks meet through an equi-join on block pairs; a task holds one candidate block and
one block of at most ``QUERY_ROWS`` queries, and gives at most k rows per query.

Defined results: vectors that are null, hold null or non-finite components, or have no vec_id take no part;
a query is compared with vectors of its own number of components only; of repeated rows with a query's vec_id the
smallest vector is the query, and no row with that vec_id is its candidate; empty vectors score 0; an empty table gives no rows; ties go
to the smaller vec_id; other columns are ignored. A score beyond 64 bits fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.tables import settle, workers_import

SCALE = 1024
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
FOCUS = 3
COORDINATE_FROM = 0.5
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (array of long), norm and dim of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    vector = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
        .select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        .withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))
        .withColumn("dim", F.size("vector"))
    )


def with_blocks(vectors: DataFrame) -> DataFrame:
    """Adds ``bucket`` (quarter octaves of length) and ``block`` (at most about BLOCK_ROWS vectors of it)."""
    bucketed = vectors.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 4)).otherwise(F.lit(-1)).cast("int"))
    sizes = bucketed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    return bucketed.join(sizes, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int")).drop("parts")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, dim)


def exact_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer products; in floating point where every partial sum is below 2**53."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    top = int(np.abs(queries.astype(object)).max()) * int(np.abs(rows.astype(object)).max()) * queries.shape[1] if queries.size < 64 else float(np.abs(queries.astype(float)).max()) * float(np.abs(rows.astype(float)).max()) * queries.shape[1]
    if top < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return queries @ rows.T
    return (queries.astype(object) @ rows.T.astype(object)).astype(np.int64)


def survivors(query: np.ndarray, length: float, floor: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows (sorted by falling length) that can still reach ``floor`` with this query."""
    if not np.isfinite(floor) or floor <= 0 or length == 0:
        return np.arange(len(rows)) if floor <= 0 or not np.isfinite(floor) else np.zeros(0, np.int64)
    local = floor / (length * norms[0]) if norms[0] > 0 else np.inf
    if local > 1 + 1e-9:
        return np.zeros(0, np.int64)
    stop = int(np.searchsorted(-norms, -(floor / length) * (1 - 1e-9), side="right"))
    kept = np.arange(stop)
    if local < COORDINATE_FROM:
        return kept
    unit, slack = query / length, 1e-6
    angle = np.arccos(min(1.0, local))
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        a = np.arccos(np.clip(unit[f], -1, 1))
        low = -1.0 if a + angle >= np.pi else np.cos(a + angle)
        high = 1.0 if a - angle <= 0 else np.cos(a - angle)
        value = rows[kept, f] / np.maximum(norms[kept], 1e-300)
        kept = kept[(value >= low - slack) & (value <= high + slack)]
    return kept


def _best(k: int):
    """Of one candidate block and one query block the k best candidates of each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = int(left.column("dim")[0].as_py())
            norms = np.asarray(left.column("norm"))
            order = np.argsort(-norms, kind="stable")
            norms, ids = norms[order], np.asarray(left.column("vec_id"))[order]
            rows = _matrix(left.column("vector"), dim)[order] if dim else np.zeros((len(ids), 0), np.int64)
            queries = _matrix(right.column("vector"), dim) if dim else np.zeros((right.num_rows, 0), np.int64)
            qids, lengths, floors = (np.asarray(right.column(c)) for c in ("vec_id", "norm", "floor"))
            for at in range(0, len(qids), 64):
                part = slice(at, at + 64)
                kept = [survivors(q, n, f, rows, norms) for q, n, f in zip(queries[part], lengths[part], floors[part])]
                dense = [i for i, x in enumerate(kept) if 4 * len(x) >= len(rows)]
                scores = exact_products(queries[part][dense], rows)
                for i, rest in enumerate(kept):
                    if not len(rest):
                        continue
                    score = scores[dense.index(i)][rest] if i in dense else exact_products(queries[part][i : i + 1], rows[rest])[0]
                    own = ids[rest] != qids[at + i]
                    score, who = score[own], ids[rest][own]
                    if len(score) > k:
                        cut = np.partition(score, len(score) - k)[len(score) - k]
                        near = score >= cut
                        score, who = score[near], who[near]
                    best = np.lexsort((who, -score))[:k]
                    out[0].append(np.full(len(best), qids[at + i]))
                    out[1].append(who[best])
                    out[2].append(score[best])
        column = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
        return pa.table({"query_id": column(out[0]), "vec_id": column(out[1]), "score": column(out[2])})

    return run


def _meet(blocks: DataFrame, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Best candidates over the stated (block, query block) pairs."""
    key = ["dim", "bucket", "block", "part"]
    fresh = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  both sides come from one table
    left = blocks.join(pairs, ["dim", "bucket", "block"]).select(*fresh(*key, "vec_id", "vector", "norm"))
    right = queries.join(pairs, ["dim", "part"]).select(*fresh(*key, "vec_id", "vector", "norm", "floor"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), RESULT)


def useful_pairs(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """(dim, bucket, block, part): the candidate blocks that some query of a block of queries can still use.

    A product is at most the lengths' product, so a block whose longest vector is shorter than ``floor / |q|`` of every
    query holds no result; it is dropped here, before any vector moves.
    """
    limited = (F.col("norm") > 0) & (F.col("floor") > float("-inf"))
    need = F.min(F.when(limited, F.col("floor") / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("need")
    needs = queries.groupBy("dim", "part").agg(need)
    return blocks.join(needs, "dim").filter(F.col("longest") >= F.col("need") - 1e-9 * F.abs("need")).select("dim", "bucket", "block", "part")


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each query with all other rows."""
    workers_import(embeddings.sparkSession)
    vectors = settle(with_blocks(integer_vectors(embeddings)), "topk-vectors")
    chosen = vectors.filter(is_query).groupBy("dim", "vec_id").agg(F.min("vector").alias("vector"), F.min_by("norm", "vector").alias("norm"))
    first = chosen.groupBy("vec_id").agg(F.min("dim").alias("dim"))
    chosen = chosen.join(first, ["vec_id", "dim"])
    parts = chosen.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    queries = settle(chosen.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")), "topk-queries")
    query_parts = queries.groupBy("dim", "part").agg(F.count("*").alias("queries"))
    blocks = settle(vectors.groupBy("dim", "bucket", "block").agg(F.max("norm").alias("longest"), F.count("*").alias("n")), "topk-blocks")
    # the longest blocks that hold about BLOCK_ROWS vectors; one row per block is ranked
    longer = Window.partitionBy("dim").orderBy(F.col("longest").desc(), "bucket", "block").rowsBetween(Window.unboundedPreceding, -1)
    top = blocks.withColumn("before", F.coalesce(F.sum("n").over(longer), F.lit(0))).filter(F.col("before") < BLOCK_ROWS).select("dim", "bucket", "block")
    everyone = queries.withColumn("floor", F.lit(float("-inf")))
    seeds = _meet(vectors, everyone, top.join(query_parts, "dim"), k)
    scores = F.sort_array(F.collect_list("score"), asc=False)  # of fewer than 2 * BLOCK_ROWS candidates
    floors = seeds.groupBy("query_id").agg(F.try_element_at(scores, F.lit(k)).cast("double").alias("reached"))
    ready = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("reached", F.lit(float("-inf"))))
    ready = settle(ready.drop("query_id", "reached"), "topk-floors")
    found = _meet(vectors, ready, useful_pairs(blocks, ready), k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
