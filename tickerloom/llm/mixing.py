"""Mixing sources to target token counts by entropy balancing.

Each source states a token constraint: the words that the mix takes from it. Among all document rates that
meet the constraints, entropy balancing takes those closest (in relative entropy, words as base measure) to
the rates 1: exponentially tilted rates ``exp(lambda)``, where the dual variables minimise the convex
``sum(words * exp(lambda)) - lambda * target``. Newton's method solves the dual; every document meets one
constraint, so the Hessian is diagonal, its sums over documents are pre-aggregated before the shuffle, and
the iterations run on the distributed table of sources. A rate is then rounded to a number of copies: its
whole part, and one more copy where an error-diffusing pass over the documents of a source, largest first,
is behind by half a document. So a source's words differ from the target by about half of its smallest
documents. A source of many documents is cut into chunks that round on their own. Documents of equal id, source and
size are one row until they are rounded, so an id (or null) that holds very many rows gathers no group of its rows.

Defined results: null or empty text has size 0; null sources are one source, sorted last; sources of no
words have target 0; repeated rows and repeated or null ids are documents of their own, and of equal ones (by id
and size) any may get the copy more; documents of equal size round in order of their ids, null last; a very long text
counts whole; an empty table gives an empty mix; other columns are ignored. Sources are ranked in one task: one row per
distinct source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm import texts
from tickerloom.llm.tables import map_arrow, settle, workers_import

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
CHUNK_ROWS = 4_000
UNIT = 1_000_000_000  # rates are rounded to a billionth, so that copies need integers only
NEWTON_STEPS = 24


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                count = word_counts(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count)], ["doc_id", "source", "size"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "source", "text"), run, "doc_id long, source string, size long")


def word_counts(column: pa.Array) -> np.ndarray:
    data, offsets = texts.buffers(column)
    inside = texts.CLASSES["space"][data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1]
    starts = starts[starts < len(data)]
    first[starts] = inside[starts]
    total = np.r_[0, np.cumsum(first)]
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, documents and target: weights by rank, none above ``MOST`` times its source.

    The excess of sources at their limit goes to the others by weight: with sources sorted by limit over
    weight, all up to some place are at their limit and the rest share what is left.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * MOST)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("place", F.when(F.col("level") <= F.col("ratio"), F.row_number().over(by_ratio)))
        .withColumn("level", F.min_by("level", "place").over(everything))
        .select(
            "source",
            "source_size",
            "documents",
            F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double"))).alias("target"),
        )
    )


def solve(goals: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """Newton iterations of the dual; adds the rate ``exp(lambda)``, 0 where nothing can be taken.

    From a start below the solution the first step overshoots and all later ones fall towards it
    (the dual is convex in each variable), so a fixed number of steps reaches full precision.
    """
    words, goal = F.col("source_size").cast("double"), F.col("target")

    def newton(dual, _):
        mass = words * F.exp(dual)
        return dual + F.least(F.greatest((goal - mass) / mass, F.lit(-1.0)), F.lit(1.0))

    dual = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), newton)
    rate = F.least(F.exp(dual), F.lit(float(MOST)))
    return goals.withColumn("rate", F.when((words > 0) & (goal > 0), rate).otherwise(0.0))


def _round(group: pd.DataFrame) -> pd.DataFrame:
    """How many of ``times`` equal documents get one copy more than the whole part of the rate."""
    group = group.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    base, part = divmod(int(group["units"].iloc[0]), UNIT)
    more, behind = [], 0
    for size, times in zip(map(int, group["size"].tolist()), map(int, group["times"].tolist())):
        extra = 0
        if size > 0 and part > 0:
            # what is behind grows by at most one document a step, so the extra copies of a run of equal ones have a closed form
            behind += part * size * times
            extra = min(times, max(0, (2 * behind + UNIT * size) // (2 * UNIT * size)))
            behind -= UNIT * size * extra
        more.append(extra)
    group["base"], group["more"] = base, more
    return group[["doc_id", "source", "size", "source_size", "target", "base", "more", "times"]]


def mix(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    workers_import(documents.sparkSession)
    sized = settle(sizes(documents), "mix-sizes")
    goals = solve(targets(sized)).select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.round(F.col("rate") * UNIT).cast("long").alias("units"),
        F.ceil(F.col("documents") / CHUNK_ROWS).alias("chunks"),
    )
    goals = settle(goals, "mix-goals")
    # equal rows are one with a number of times; ids that repeat with other sizes fall into other chunks
    equal = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    spread = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1_000_003)) * 7919 + F.col("size") * 104_729, F.col("chunks"))
    rounded = (
        equal.join(goals, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("chunk", spread)
        .groupBy("of", "chunk")
        .applyInPandas(_round, "doc_id long, source string, size long, source_size long, target double, base int, more long, times long")
    )
    return _repeated(settle(rounded, "mix-rounded")).withColumn("taken", F.col("copies") * F.col("size"))


def _repeated(rounded: DataFrame) -> DataFrame:
    """One row for each document again; a row of very many times is cut into pieces that spread over tasks."""
    kept = ["doc_id", "source", "size", "source_size", "target"]
    groups = F.array(
        F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("rows")),
        F.struct(F.col("base").alias("copies"), (F.col("times") - F.col("more")).alias("rows")),
    )
    parts = rounded.select(*kept, F.inline(groups)).filter("rows > 0")
    few, many = parts.filter(F.col("rows") <= CHUNK_ROWS), parts.filter(F.col("rows") > CHUNK_ROWS)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / CHUNK_ROWS)), lambda k: F.least(F.lit(CHUNK_ROWS), F.col("rows") - k * CHUNK_ROWS))
    cut = many.select(*kept, "copies", F.posexplode(pieces).alias("piece", "rows")).repartition("doc_id", "size", "copies", "piece").drop("piece")
    each = few.unionByName(cut)
    return each.select(*kept, "copies", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row")
