"""Connected components, numbering and written intermediate tables that no single task has to hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import shared_folder

MOST_ROUNDS = 60


def settled(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: later plans start from the files."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for ``links(a, b)`` of numbers; a component is named by its smallest node.

    Every round hooks each node's current label to the smallest label next to it and then lets labels follow their
    own label twice, so a path of n nodes takes about log(n) rounds. Rounds are written, so lineage stays short.
    Neighbours are reduced by aggregates that combine before the shuffle; no neighbourhood is gathered.
    """
    both = links.filter("a <> b").select("a", "b").distinct()
    both = settled(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        of = lambda name, to: labels.select(F.col("node").alias(name), F.col("label").alias(to))
        # links between labels, and what each label should hook to
        across = both.join(of("a", "la"), "a").join(of("b", "lb"), "b").filter("lb < la").groupBy("la").agg(F.min("lb").alias("low"))
        across = settled(across, "hooks")
        if across.isEmpty():
            return labels.withColumnRenamed("label", "component")
        hooked = labels.join(across, labels["label"] == across["la"], "left").select("node", F.coalesce("low", "label").alias("label"))
        labels = settled(hooked, "labels")
        for _ in range(2):  # a label's own label is at least as small
            follow = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = settled(labels.join(follow, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def placed_in_order(frame: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Adds ``run`` and ``position`` (from 0 within the key): rows sorted by range over the cluster and counted by run.

    A run is one written partition, so a key that holds most rows is numbered by many tasks.
    """
    order = [F.col(key), *order]
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    in_runs = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settled(in_runs.select("*", F.spark_partition_id().alias("run"), local.alias("place")), name)
    counts = rows.groupBy(key, "run").agg(F.count("*").alias("n"), F.min("place").alias("least"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("run")) - F.col("n")
    starts = settled(counts.select(key, "run", (before - F.col("least")).alias("shift")), f"{name}-runs")
    return rows.join(starts, [key, "run"]).withColumn("position", F.col("place") + F.col("shift")).drop("place", "shift")


def decayed_sums(rows: DataFrame, key: str, index: str, order: str, value: str, decay: float, longest: int = 1 << 14) -> DataFrame:
    """Adds ``decayed``: x(i) = decay * x(i - 1) + value(i) along ``index`` (0, 1, 2 ... of each key), a segmented scan.

    Rows may share an index if only the first of them by ``order`` has a value. Each row is the affine map
    x -> decay * x + value, and maps compose: segments of bounded length are summed by a window of their own, weighted
    relative to their start, and the states at their ends are chained by the same scan over the segments. However
    long a series is, no task holds more than a segment of it.
    """
    length = max(2, min(longest, int(300 / -math.log(decay))))
    after = math.pow(decay, length)
    segment, offset = F.floor(F.col(index) / length).cast("long"), F.pmod(F.col(index), F.lit(length)).cast("double")
    weighted = rows.withColumn("segment", segment).withColumn("offset", offset)
    along = Window.partitionBy(key, "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.coalesce(F.col(value), F.lit(0.0)) * F.pow(F.lit(1 / decay), "offset")
    inner = weighted.withColumn("inner", F.pow(F.lit(decay), "offset") * F.sum(share).over(along))
    inner = settled(inner, "segments")
    ends = inner.groupBy(key, "segment").agg(F.max_by("inner", order).alias("end"))
    if after > 1e-40:  # an earlier segment still counts: chain all of them
        chained = decayed_sums(ends.withColumnRenamed("segment", "number"), key, "number", "number", "end", after, longest)
        ends = chained.select(key, F.col("number").alias("segment"), F.col("decayed").alias("end"))
    before = ends.select(key, (F.col("segment") + 1).alias("segment"), F.col("end").alias("before"))
    carried = F.pow(F.lit(decay), F.col("offset") + 1) * F.coalesce("before", F.lit(0.0))
    return inner.join(before, [key, "segment"], "left").withColumn("decayed", F.col("inner") + carried).drop("segment", "offset", "inner", "before")
