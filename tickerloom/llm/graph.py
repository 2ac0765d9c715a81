"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.tables import settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; the component is its smallest node.

    Each step replaces neighbours by the smallest one known: aggregates that combine before the shuffle and
    joins that Spark can split where a node has very many neighbours. Nothing is gathered in one place.
    """
    known = settle(_tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    for _ in range(most_rounds):
        if _settled(known):
            break
        known = settle(_small_star(_large_star(known)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return known.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        known.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node that has none: then that is its component.

    One aggregate instead of a round that changes nothing; it combines before the shuffle, however many nodes share one.
    """
    ends = [F.struct(F.col(c).alias("node"), F.lit(up).cast("long").alias("up"), F.lit(1 - up).alias("down")) for c, up in (("a", 1), ("b", 0))]
    nodes = edges.select(F.explode(F.array(*ends)).alias("end")).select("end.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count(F.when((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)), 1))).first()[0] == 0


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Each row as several edges (a, b), in one pass: a union would plan what it is made from once for each."""
    own = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]
    return edges.select(F.explode(F.array(*own)).alias("edge")).select("edge.*")


def _with_low(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the ``low`` of their a. Both sides grow with the corpus: merged, so that no round builds tables on the driver."""
    return edges.join(least.select(F.col("a").alias("hub"), "low").hint("merge"), F.col("a") == F.col("hub"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is linked to the smallest in the node's neighbourhood."""
    both = _pairs(edges, ("a", "b"), ("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return _tidy(_pairs(_with_low(both.filter(F.col("b") > F.col("a")), least), ("b", "low")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; edges point from a to smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    return _tidy(_pairs(_with_low(edges, least), ("b", "low"), ("a", "low")))
