"""MinHash near-dedup with tensored banding.

Two collections of ``SKETCHES`` sketches are computed for a document, each sketch of ``WIDTH`` minhashes over
its distinct five-word shingles. Tables are keyed by pairs, one sketch of each collection: ``SKETCHES ** 2``
tables of ``2 * WIDTH`` minhashes each come from ``2 * SKETCHES * WIDTH`` minhash values instead of
``2 * SKETCHES ** 2 * WIDTH``. A sketch value that only one document has can be in no shared table, so such
values are dropped before pairs are formed. Two documents of similarity 0.75 share no table with a
probability below 2 (1 - 0.75 ** WIDTH) ** SKETCHES, about 4e-6.

Candidates are verified on full shingle sets, in two steps. The members of tables are linked to the smallest
ones they share a table with, and first compared with these, in blocks of at most ``BLOCK_ROWS`` documents (and
``BLOCK_BYTES`` of text): work and moved texts are in proportion to the members, however large a group of copies is.
What this confirms are classes. Only where candidate links lead from one class to another is more to be compared:
such clusters are cut into blocks of similar set size, and blocks whose sizes allow the similarity are compared
across classes. A task emits only a spanning forest of the links that it confirms, never all pairs. Components
of the confirmed links are the classes.

Documents with equal shingle sets are one node from the start, so copies are never compared.

Defined results: null and empty texts have 0 shingles and are linked with nothing; repeated rows are linked
as equal texts; a null doc_id takes part but names no component (null, where no other id is reached);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tickerloom.llm import texts
from tickerloom.llm.graph import components
from tickerloom.llm.tables import map_arrow, settle, workers_import

SHINGLE, PERCENT = 5, 75
SKETCHES, WIDTH = 24, 3
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
NAMELESS = 1 << 62  # nodes of rows without doc_id lie from here on
SHARED = -(1 << 62)  # owner of the blocks that small classes share

_rng = np.random.Generator(np.random.PCG64(11))
_MULTIPLIERS = _rng.integers(1, 1 << 62, 2 * SKETCHES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _merged(frame: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the corpus: merged, so that no step builds tables on the driver."""
    return frame.join(other.hint("merge"), on, how)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketches(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 2 * SKETCHES) sketch values of shingles sorted by row; rows without shingles hold 0."""
    out = np.zeros((rows, 2 * SKETCHES), np.uint64)
    spans = texts.row_spans(row, rows)
    some = np.flatnonzero(np.diff(spans))
    if not len(some):
        return out
    starts = spans[:-1][some]
    total = np.zeros((len(some), 2 * SKETCHES), np.uint64)
    for k, factor in enumerate(_MULTIPLIERS):
        x = value * factor
        x ^= x >> np.uint64(32)
        x *= texts._M1
        total[:, k // WIDTH] = total[:, k // WIDTH] * texts._M2 + np.minimum.reduceat(x, starts)
    out[some] = texts.mix(total)
    return out


def fingerprints(documents: DataFrame, keep: str | None = None) -> DataFrame:
    """Per row: doc_id, number of shingles, two sums that identify the set, text bytes and sketch values.

    With ``keep``, a text or a row that holds it, that column of the documents instead of the sketch values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(texts.with_text(batch, 1)):
                n = part.num_rows
                row, value = texts.shingles(texts.words(part.column("text")), n, SHINGLE)
                spans = texts.row_spans(row, n)
                sums = []
                for factor in (texts._M1, texts._M2):
                    total = np.r_[np.zeros(1, np.uint64), np.cumsum(texts.mix(value * factor), dtype=np.uint64)]
                    sums.append(total[spans[1:]] - total[spans[:-1]])
                if keep:
                    last = part.column(1)
                else:
                    found = sketches(row, value, n)
                    last = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * found.shape[1], _signed(found.ravel()))
                size = pa.array(np.diff(spans).astype(np.int64))
                length = pa.array(np.diff(texts.buffers(part.column("text"))[1]))
                columns = [part.column(0), size, _signed(sums[0]), _signed(sums[1]), length, last]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *SET, "bytes", keep or "sketch"])

    schema = StructType([StructField(name, LongType()) for name in ("doc_id", *SET, "bytes")])
    schema.add(keep or "sketch", documents.schema[keep].dataType if keep else ArrayType(LongType()))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(keep or "text").alias("kept"))
    return map_arrow(source, run, schema)


SET = ["n_shingles", "key1", "key2"]


def _nameless():
    return F.lit(NAMELESS) + F.shiftrightunsigned(F.col("key1"), 3)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect the members of each shared table.

    A table's head is its smallest member, a node's ``low`` the smallest head of its tables. Each node is linked to
    its low, and each head to the lows of its members: a link or so for each node, however many tables a group shares.
    """
    values = nodes.select("node", F.posexplode("sketch").alias("at", "value"))
    shared = values.groupBy("at", "value").agg(F.count("*").alias("n")).filter("n > 1").select("at", "value")
    alive = _merged(values, shared, ["at", "value"]).groupBy("node").agg(F.collect_list(F.struct("at", "value")).alias("alive"))
    left = F.filter("alive", lambda x: x["at"] < SKETCHES)
    right = F.filter("alive", lambda x: x["at"] >= SKETCHES)
    keys = (
        alive.select("node", F.explode(left).alias("left"), right.alias("right"))
        .select("node", "left", F.explode("right").alias("right"))
        .select("node", F.xxhash64("left.at", "left.value", "right.at", "right.value").alias("key"))
    )
    keys = settle(keys, "neardup-tables")
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # a node is in at most SKETCHES ** 2 tables, so its heads are bounded
    met = _merged(keys, heads, "key").groupBy("node").agg(F.collect_set("head").alias("heads")).withColumn("low", F.array_min("heads"))
    ends = F.explode(F.array_append("heads", F.col("node")))  # not a union, which would plan all of the above twice
    return met.select(ends.alias("a"), F.col("low").alias("b")).filter("a != b").distinct()


def _confirm(table: pa.Table) -> pa.Table:
    """Spanning forest of the links between the documents of one pair of blocks; those of one ``known`` class are linked already."""
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    nodes, sides, known = (np.asarray(table.column(name)) for name in ("node", "side", "known"))
    n = len(nodes)
    row, value = texts.shingles(texts.words(column), n, SHINGLE)
    spans = texts.row_spans(row, n)
    sizes = np.diff(spans)
    _, code = np.unique(value, return_inverse=True)
    mark = np.zeros(len(code) + 1, np.int64)
    _, first, which = np.unique(known, return_index=True, return_inverse=True)
    parent = first[which].tolist()

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    alone = sides.max(initial=0) == 0
    out: list[tuple[int, int]] = []
    for i in range(n):
        if not alone and sides[i] == 1:
            continue
        rest = np.arange(i + 1, n) if alone else np.flatnonzero(sides == 1)
        fits = (100 * sizes[rest] >= PERCENT * sizes[i]) & (100 * sizes[i] >= PERCENT * sizes[rest]) & (known[rest] != known[i])
        rest = rest[fits]
        if not len(rest):
            continue
        mine = code[spans[i] : spans[i + 1]]
        mark[mine] = 1
        cuts = np.stack([spans[rest], spans[rest + 1]], 1)
        where = np.concatenate([np.arange(a, b) for a, b in cuts])
        common = np.add.reduceat(mark[code[where]], np.r_[0, np.cumsum(cuts[:, 1] - cuts[:, 0])[:-1]])
        mark[mine] = 0
        union = sizes[i] + sizes[rest] - common
        for j in rest[100 * common >= PERCENT * union]:
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _parts():
    """How many blocks a group of members needs."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("parts")


def beside_heads(member: DataFrame, links: DataFrame) -> DataFrame:
    """(node, hub, part): the blocks of the first comparison, each node with the smallest it is linked to.

    The members of a hub are cut into blocks, and the hub stands in each: a member moves once, a hub once for each block.
    """
    low = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("hub"))
    hubs = settle(_merged(low, member.select("node", "bytes"), "node"), "neardup-hubs")
    parts = hubs.groupBy("hub").agg(_parts())
    spread = _merged(hubs, parts, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    return spread.union(parts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))


def place(member: DataFrame) -> DataFrame:
    """Adds ``places``: the pairs of blocks that a member (node, n_shingles, bytes, known, cluster) is compared in.

    Sizes of a ratio of 0.75 or more fall into one band or two neighbouring bands; a cluster that fits one block is
    not cut into bands. A class that is ``known`` to be linked and needs several blocks has them to itself, and they
    are not compared with each other; smaller classes share blocks. Each table that several steps read is written
    once: a plan holds what it reads as often as it names it, and steps of steps would multiply that on the driver.
    """
    small = member.groupBy("cluster").agg(_parts()).filter("parts <= 1").select("cluster", F.lit(True).alias("small"))
    band = F.floor(F.log("n_shingles") / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    member = _merged(member, small, "cluster", "left").withColumn("band", F.when(F.col("small"), F.lit(-1)).otherwise(band)).drop("small")
    member = settle(member, "neardup-banded")
    large = member.groupBy("cluster", "band", "known").agg(_parts()).filter("parts > 1").select("cluster", "band", "known", F.col("known").alias("own"))
    member = settle(_merged(member, large, ["cluster", "band", "known"], "left").fillna(SHARED, ["own"]), "neardup-owned")
    groups = settle(member.groupBy("cluster", "band", "own").agg(_parts()), "neardup-groups")
    numbers = groups.select("cluster", "band", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = F.when(F.col("band") < 0, F.array("band")).otherwise(F.sequence(F.greatest(F.col("band") - 1, F.lit(0)), F.col("band") + 1))
    blocks = numbers.select("cluster", F.explode(near).alias("to"), F.struct("band", "own", "part").alias("block"))
    blocks = blocks.groupBy("cluster", F.col("to").alias("band")).agg(F.collect_list("block").alias("met"))
    mine = F.struct("band", "own", "part")
    pair = lambda x: F.struct(F.least(mine, x).alias("low"), F.greatest(mine, x).alias("high"), (mine > x).cast("int").alias("side"))
    return (
        _merged(member, groups, ["cluster", "band", "own"])
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .join(blocks.hint("merge"), ["cluster", "band"])
        .select("node", "known", "cluster", F.transform(F.filter("met", lambda x: (x["own"] != F.col("own")) | (x["own"] == SHARED)), pair).alias("places"))
    )


def confirmed_links(documents: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): enough confirmed links to connect what all links among candidates connect.

    First each node is compared with the smallest it is linked to, in blocks: in a large group of copies this confirms
    nearly all, at a cost in proportion to its members. Then only clusters in which different classes remain are
    compared, across classes.
    """
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    member = settle(_merged(nodes, linked, "node").select("node", "n_shingles", "bytes").distinct(), "neardup-members")
    named = documents.select(F.col("doc_id").cast("long").alias("node"), "text").filter("node is not null and text is not null")
    unnamed = fingerprints(documents.filter("doc_id is null"), keep="text").select(_nameless().alias("node"), "text")
    found = settle(_merged(named.union(unnamed), member.select("node"), "node", "left_semi"), "neardup-texts")

    hubs = _merged(found, beside_heads(member, links), "node").select("hub", "part", "node", F.col("node").alias("known"), F.lit(0).alias("side"), "text")
    near = settle(hubs.groupBy("hub", "part").applyInArrow(_confirm, "a long, b long"), "neardup-first")
    known = _merged(member, components(near), "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")
    known = settle(known, "neardup-known")

    named_class = lambda side: known.select(F.col("node").alias(side), F.col("known").alias(f"{side}_class"))
    across = _merged(_merged(links, named_class("a"), "a"), named_class("b"), "b").filter("a_class != b_class")
    clusters = components(across.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct())
    left = settle(_merged(known, clusters.select(F.col("node").alias("known"), F.col("component").alias("cluster")), "known"), "neardup-left")
    placed = settle(place(left), "neardup-places")
    spread = _merged(found, placed, "node").select("node", "text", "known", "cluster", F.explode("places").alias("p"))
    rest = spread.select("cluster", "p.*", "node", "known", "text").groupBy("cluster", "low", "high").applyInArrow(_confirm, "a long, b long")
    return near.union(settle(rest, "neardup-rest"))


def classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of every row, and for each distinct set its class (``component``), node and first doc_id."""
    workers_import(documents.sparkSession)
    marks = settle(fingerprints(documents), "neardup-marks")
    sets = marks.filter("n_shingles > 0").groupBy(*SET).agg(F.min("doc_id").alias("first"))
    sets = settle(sets.withColumn("node", F.coalesce("first", _nameless())), "neardup-sets")
    mine = [marks[c] == sets[c] for c in SET]
    nodes = marks.join(sets.hint("merge"), [*mine, marks["doc_id"].eqNullSafe(sets["first"])]).select("node", sets["n_shingles"], "bytes", "sketch")
    links = settle(candidate_links(nodes.select("node", "sketch")), "neardup-links")
    found = components(confirmed_links(documents, nodes.drop("sketch"), links))
    named = _merged(sets, found, "node", "left").select(*SET, "first", "node", F.coalesce("component", "node").alias("component"))
    return marks.drop("sketch"), named


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    marks, named = classes(documents)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("component") < NAMELESS, F.col("component"))
    return (
        marks.select("doc_id", *SET)
        .join(named.select(*SET, "component"), SET, "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without all but one of each class; rows without shingles stay."""
    _, named = classes(documents)
    keepers = named.filter("node = component").select(*[F.col(c).alias(f"of_{c}") for c in SET], "first")
    names = documents.columns
    whole = documents.select("doc_id", F.struct(*names).alias("row"))
    keyed = fingerprints(whole, keep="row")
    match = [F.col(c) == F.col(f"of_{c}") for c in SET] + [F.col("doc_id").eqNullSafe(F.col("first"))]
    joined = _merged(keyed, keepers, match, "left")
    # rows with the id and the set of the keeper are repeats of one row
    repeat = F.row_number().over(Window.partitionBy(*SET, "doc_id").orderBy(F.xxhash64("row.text")))
    kept = joined.withColumn("repeat", repeat).filter((F.col("n_shingles") == 0) | (F.col("of_key1").isNotNull() & (F.col("repeat") == 1)))
    return kept.select(*[F.col("row")[c].alias(c) for c in names])
