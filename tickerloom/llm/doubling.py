"""Plain distributed prefix doubling: ranks of all byte positions of a corpus at doubling lengths.

Every position starts with the rank of its first ``BASE`` bytes. In each round a position's pair is its own rank and that
of the position one length on; Spark counts and sorts the pairs, a pair that occurs once falls out with its position (no
longer string that begins there can repeat), and the others get the ordinal of their pair in the sorted order as their
next rank. After the last round, whose offset brings the length to the window exactly, the positions left are the repeated windows.

This is the method in its plain form. It moves every byte position of the corpus in its first rounds, many times
the input, so ``suffixes`` samples positions instead and is held against this form in the tests; the README has the figures.

Defined results: null and empty texts and texts shorter than the window have no position; repeated rows are texts of their
own if their ``tid`` differs; other columns are ignored; an empty table gives an empty result; long texts are one
row's positions and are spread by position afterwards. Ranks of the first ``BASE`` bytes are 64-bit fingerprints, all later ones ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import texts
from tickerloom.llm.suffixes import WINDOW, Ranks
from tickerloom.llm.tables import map_arrow, settle

BASE = 25  # 25, 50, 100, 200


def _first_ranks(numbered: DataFrame, base: int, window: int) -> DataFrame:
    """tid, pos and the rank of ``base`` bytes at every position of every text that holds a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                data, offsets = texts.buffers(part.column(1))
                size = np.diff(offsets)
                count = np.where(size >= window, size - base + 1, 0)
                row = np.repeat(np.arange(part.num_rows), count)
                pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                rank = Ranks(data).of(offsets[row] + pos, base) if len(row) else np.zeros(0, np.uint64)
                tid = np.asarray(part.column(0))[row]
                yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(pos), pa.array(rank.view(np.int64))], ["tid", "pos", "rank"])

    rows = numbered.select(F.col("tid").cast("long").alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows, run, "tid long, pos long, rank long")


def _reranked(pairs: DataFrame, *key: str) -> DataFrame:
    """Positions whose key repeats, with the key's ordinal among the repeated ones as their rank."""
    repeated = pairs.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1").select(*key)
    ordinals = settle(repeated.sort(*key).withColumn("next", F.monotonically_increasing_id()), "doubling-ordinals")
    return settle(pairs.join(ordinals, list(key)).select("tid", "pos", F.col("next").alias("rank")), "doubling-ranks")


def repeated_positions(numbered: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """tid, pos and rank of every window of (tid, text) that also begins anywhere else; equal windows have equal ranks."""
    base = min(base, window)
    ranks, length = _reranked(_first_ranks(numbered, base, window), "rank"), base
    while length < window:
        step = min(length, window - length)
        ahead = ranks.select("tid", (F.col("pos") - step).alias("pos"), F.col("rank").alias("tail"))
        ranks = _reranked(ranks.withColumnRenamed("rank", "head").join(ahead, ["tid", "pos"]), "head", "tail")
        length += step
    return ranks
