"""Quality classifier by importance resampling.

Two bag-of-n-grams generative models over hashed buckets are counted, one from target texts (documents that
the labels call good) and one from all raw texts; the weight of a document is the log ratio of its
likelihood under the two. Documents are then resampled without replacement: Gumbel noise from a hash of the
document is added to its weight and the highest keys are taken (Gumbel top-k).

The weight is the mean log ratio per n-gram times ``sharpness``, so that long texts do not win or lose by
their length alone. Features are words, pairs of neighbouring words and runs of signs.

Counts cover all documents: a task adds up its own texts and gives one row per bucket, and these are summed
by bucket. The model has a fixed number of buckets. Target texts are found by a bounded sample of labelled
ids (``max_target``). The k-th highest key is found exactly by counting keys in ever finer ranges.

Defined results: a text without features (null, empty) has weight 0; repeated rows have equal weights and,
with equal ids, equal keys; rows tied at the last key are all kept; null ids draw the noise of their own
hash; an empty table gives an empty result; without target labels all weights are 0. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import texts
from tickerloom.llm.tables import map_arrow, settle

BUCKETS = 1 << 14
KEEP, SHARPNESS, SMOOTHING = 0.8, 20.0, 0.5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram."""
    found, signs = texts.words(column, "alnum"), texts.words(column, "signs")
    pairs = found.row[1:] == found.row[:-1] if len(found.row) else np.zeros(0, bool)
    joint = texts.mix(found.hash[:-1] * texts._M2 + found.hash[1:])[pairs]
    row = np.concatenate([found.row, found.row[:-1][pairs], signs.row])
    value = np.concatenate([found.hash, joint, texts.mix(signs.hash + np.uint64(1))])
    return row, (value >> np.uint64(50)).astype(np.int64) % BUCKETS


def target_ids(labels: DataFrame, max_target: int) -> list[int]:
    """At most ``max_target`` ids labelled good and not toxic, the same in every run."""
    good = (
        labels.filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0")
        .select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
        .withColumn("draw", F.xxhash64("doc_id").bitwiseAND((1 << 40) - 1))
    )
    total = good.count()
    if total > max_target:
        good = good.filter(F.col("draw") < int((1 << 40) * min(1.0, 1.1 * max_target / total)))
    return sorted(r["doc_id"] for r in good.orderBy("draw", "doc_id").limit(max_target).collect())


def fit(documents: DataFrame, labels: DataFrame, max_target: int = 50_000) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket."""
    ids = np.array(target_ids(labels, max_target), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in texts.slices(batch):
                row, bucket = features(part.column(1))
                doc = part.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                good = np.isin(doc, ids)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    counted = map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def weigh(documents: DataFrame, ratio: np.ndarray, sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, n_grams, log_ratio (mean per n-gram) and key (weight plus Gumbel noise) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                row, bucket = features(part.column(1))
                count = np.bincount(row, minlength=part.num_rows)
                mean = np.bincount(row, ratio[bucket], part.num_rows) / np.maximum(1, count)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int64)), pa.array(mean)], ["doc_id", "n_grams", "log_ratio"])

    weighed = map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_grams long, log_ratio double")
    uniform = (F.xxhash64("doc_id", F.lit("gumbel")).bitwiseAND((1 << 52) - 1).cast("double") + 0.5) / float(1 << 52)
    return weighed.withColumn("key", F.col("log_ratio") * sharpness - F.log(-F.log(uniform)))


def kth_highest(frame: DataFrame, name: str, k: int, ranges: int = 1024) -> float | None:
    """The k-th highest value of a column, exactly: counts by range, then within the range that holds it."""
    low, high, total = frame.agg(F.min(name), F.max(name), F.count(name)).first()
    if total == 0 or k <= 0:
        return None
    above, k = 0, min(k, total)
    while low < high:
        width = (high - low) / ranges
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col(name) - low) / width), F.lit(ranges - 1))
        inside = frame.filter(F.col(name).between(low, high)).groupBy(at.alias("at"))
        counts = sorted(inside.agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect(), reverse=True)
        for _, n, least, most in counts:  # at most ``ranges`` rows
            if above + n >= k:
                low, high = least, most
                break
            above += n
    return low


def good_share(labels: DataFrame) -> float:
    """Share of labelled rows that are good, ``KEEP`` without labels."""
    good, total = labels.filter("doc_id is not null").agg(F.expr("count_if(quality = 1)"), F.expr("count_if(quality in (0, 1))")).first()
    return good / total if total else KEEP


def resample(documents: DataFrame, labels: DataFrame, keep: float | None = None) -> DataFrame:
    """Every document with its weight, its key and whether it is among the ``keep`` share taken.

    By default as large a share of the documents is taken as the labels call good.
    """
    keep = good_share(labels) if keep is None else keep
    weighed = settle(weigh(documents, fit(documents, labels)), "quality-keys")
    floor = kth_highest(weighed, "key", int(np.ceil(keep * weighed.count())))
    return weighed.withColumn("kept", F.col("key") >= F.lit(float("inf") if floor is None else floor))
