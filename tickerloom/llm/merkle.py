"""Merkle manifest of a table, with an octopus multiproof for each leaf partition.

Every row is a leaf: the sha256 of its fields. The leaves of one ``lang`` ascend by doc_id and form a tree in which
every ``FAN`` consecutive nodes have a parent; the roots of these trees, ordered by ``lang``, form one more tree
above them, whose root stands for the whole table.

*Building.* Leaves are sorted by range over the cluster and numbered by partition counts, never in one task, however
many rows one ``lang`` has. Aligned blocks of ``FAN ** TIER`` nodes are then reduced to one node each, and the
next tier does the same with those, so a task holds one block and a table of N rows takes log(N) / log(4096) tiers.

*Proving.* The leaves to be proved lie in partitions of one block each. A partition works out which nodes it lacks:
the union of the siblings of all its leaves' paths, less what can be computed from its own leaves. It fetches each of
these coordinates once, computes the shared interior nodes once, and expands the proof of every single leaf from
them locally. If all leaves of a block are proved, only siblings above the block are fetched. Coordinates near a root
are wanted by every partition; wishes are therefore made distinct by salt before they meet the nodes.

Fields are joined as ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value. Inner nodes and proofs are
hashed over digests as lower-case hex text.

Defined results: a null ``lang`` is a tree of its own and comes first; a null doc_id comes first in its tree and takes
no part in tampering; rows with one doc_id are ordered by leaf digest, and equal rows each have a leaf; a null text
has the field ``-``, an empty one ``0:``; a very long text is hashed like any other; an empty table has no root and
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.tables import settle, workers_import
from tickerloom.operators.joins import salted_lookup

FAN, TIER = 8, 4
_BITS = 3  # FAN = 1 << _BITS
SPAN = _BITS * TIER
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""  # name of the tree of subroots; trees of rows are named by the field of their lang, which is never empty
NODE = "tree string, size long, level int, idx long, hash binary, top boolean"
REQUESTS_PER_SALT = 4096


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """sha256 of a row's fields; ``columns`` replaces some of them."""
    given = {name: F.col(name) for name in FIELDS} | (columns or {})
    return F.unhex(F.sha2(F.concat(*[_field(given[name]) for name in FIELDS]), 256))


@dataclass(frozen=True)
class Manifest:
    """Written tables of a manifest.

    ``leaves``: tree, position, size (of the tree), doc_id, leaf, claim; ``nodes``: tree, level, idx, hash of all nodes
    above the leaves; ``roots``: tree, place and places (its position among all subroots); ``parts``: leaf partitions.
    """

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: str | None
    parts: int


def _numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``position`` within each tree by ``order`` and the tree's ``size``; rows that tie are split anywhere."""
    order = [*order, F.col("row_at")]
    sorted_rows = frame.withColumn("row_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settle(sorted_rows.drop("row_at").select("*", F.spark_partition_id().alias("run"), local.alias("local")), f"{name}-sorted")
    runs = placed.groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("local").alias("least"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = settle(runs.select("tree", "run", (before - F.col("least")).alias("shift"), F.sum("n").over(tree).alias("size")), f"{name}-runs")
    return placed.join(starts, ["tree", "run"]).withColumn("position", F.col("local") + F.col("shift")).drop("run", "local", "shift")


def _hash(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _hexes(column: pa.ChunkedArray) -> list[bytes]:
    return [value.hex().encode() for value in column.to_pylist()]


def _reduce_block(table: pa.Table) -> pa.Table:
    """The nodes above one aligned block of nodes (tree, size, level, idx, hash), up to TIER levels or the tree's root."""
    tree, whole, level = (table.column(name)[0].as_py() for name in ("tree", "size", "level"))
    order = np.argsort(np.asarray(table.column("idx")), kind="stable")
    values = _hexes(table.column("hash").take(pa.array(order)))
    start = int(np.asarray(table.column("idx"))[order[0]])
    size = whole
    for _ in range(level):
        size = -(-size // FAN)
    out = []
    for step in range(1, TIER + 1):
        if size == 1:
            break
        values = [_hash(values[k : k + FAN]) for k in range(0, len(values), FAN)]
        size, start = -(-size // FAN), start // FAN
        out += [(tree, whole, level + step, start + k, bytes.fromhex(v.decode()), size == 1) for k, v in enumerate(values)]
    columns = list(zip(*out)) if out else [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("tree", "size", "level", "idx", "hash", "top"), columns, kinds)})


def _grow(leaves: DataFrame, name: str) -> DataFrame:
    """All nodes above the leaves (tree, position, size, hash) of every tree."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    now = leaves.select("tree", "size", F.lit(0).alias("level"), F.col("position").alias("idx"), "hash")
    tiers, level = [], 0
    while most > 1:
        block = F.shiftright("idx", SPAN).alias("block")
        tiers.append(settle(now.groupBy("tree", block).applyInArrow(_reduce_block, NODE), f"{name}-tier"))
        level, most = level + TIER, -(-most // FAN**TIER)
        now = tiers[-1].filter((F.col("level") == level) & ~F.col("top")).drop("top")
    empty = leaves.sparkSession.createDataFrame([], NODE)
    return reduce(DataFrame.unionByName, tiers, empty)


def build(rows: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of a table with the columns FIELDS.

    ``claim`` is a leaf digest to be judged in place of the row's own by ``prove`` (null: the row's own).
    """
    workers_import(rows.sparkSession)
    digests = rows.select(
        _field(F.col("lang")).alias("tree"),
        F.col("lang"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("hash"),
        (F.lit(None).cast("binary") if claim is None else claim).alias("claim"),
    )
    first = lambda name: F.col(name).asc_nulls_first()
    leaves = _numbered(digests, [first("lang"), first("doc_id"), F.col("hash")], "manifest-leaves")
    inner = _grow(leaves, "manifest")
    single = leaves.filter("size = 1").select("tree", "hash")
    subroots = inner.filter("top").select("tree", "hash").union(single)
    named = subroots.join(leaves.filter("position = 0").select("tree", "lang"), "tree")
    places = _numbered(named.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "lang", "hash"), [first("lang")], "manifest-roots")
    upper = _grow(places, "manifest-top")
    last = upper.filter("top").select("hash").union(places.filter("size = 1").select("hash")).first()
    bottom = places.select("tree", F.lit(0).alias("level"), F.col("position").alias("idx"), "hash")
    parts = leaves.filter("position = 0").agg(F.sum(F.shiftright(F.col("size") - 1, SPAN) + 1)).first()[0] or 0
    return Manifest(
        leaves.select("tree", "position", "size", "doc_id", "lang", F.col("hash").alias("leaf"), "claim"),
        reduce(DataFrame.unionByName, (part.select("tree", "level", "idx", "hash") for part in (inner, bottom, upper))),
        settle(places.select(F.col("of").alias("tree"), F.col("position").alias("place"), F.col("size").alias("places")), "manifest-places"),
        last[0].hex() if last else None,
        int(parts),
    )


def missing(positions: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(level, indexes) of the nodes that the paths of these leaves need and that cannot be computed from the leaves."""
    own, level, out = np.unique(positions), 0, []
    while size > 1:
        parents = np.unique(own >> _BITS)
        needed = ((parents << _BITS)[:, None] + np.arange(FAN)).ravel()
        out.append((level, np.setdiff1d(needed[needed < size], own, assume_unique=True)))
        own, size, level = parents, -(-size // FAN), level + 1
    return out


def _wishes(table: pa.Table) -> pa.Table:
    """The coordinates that one leaf partition lacks."""
    tree, part, size, place, places = (table.column(n)[0].as_py() for n in ("tree", "part", "size", "place", "places"))
    found = [(tree, *m) for m in missing(np.asarray(table.column("position")), size)]
    found += [(TOP, *m) for m in missing(np.array([place]), places)]
    count = [len(idx) for _, _, idx in found]
    return pa.table(
        {
            "tree": pa.array([tree] * sum(count), pa.string()),
            "part": pa.array([part] * sum(count), pa.int64()),
            "of": pa.array(np.repeat(np.array([f[0] for f in found], object), count), pa.string()),
            "level": pa.array(np.repeat(np.array([f[1] for f in found], np.int32), count), pa.int32()),
            "idx": pa.array(np.concatenate([np.zeros(0, np.int64), *[f[2] for f in found]]), pa.int64()),
        }
    )


class _Path:
    """The nodes of one tree that a leaf partition knows, from its own nodes and the fetched ones."""

    def __init__(self, own: dict[int, bytes], size: int, fetched: dict[tuple[int, int], bytes]):
        self.runs: list[dict[int, list[bytes]]] = []  # level -> parent -> its children
        level = 0
        while size > 1:
            runs = {}
            for parent in sorted({k >> _BITS for k in own}):
                children = range(parent << _BITS, min(size, (parent + 1) << _BITS))
                try:
                    runs[parent] = [own[k] if k in own else fetched[level, k] for k in children]
                except KeyError as error:
                    raise ValueError(f"the manifest lacks the node {error} of a tree") from None
            self.runs.append(runs)
            own = {parent: _hash(run) for parent, run in runs.items()}
            size, level = -(-size // FAN), level + 1
        (self.root,) = own.values()

    def siblings(self, above: bytes = b"") -> dict[int, bytes]:
        """For each own leaf the raw digests of its siblings, level by level, then ``above``."""
        below = {0: above}
        for runs in reversed(self.runs):
            nodes = {}
            for parent, run in runs.items():
                raw = [bytes.fromhex(v.decode()) for v in run]
                for k in range(len(run)):
                    nodes[(parent << _BITS) + k] = b"".join(raw[:k] + raw[k + 1 :]) + below[parent]
            below = nodes
        return below

    def fold(self, position: int, value: bytes) -> bytes:
        """The root that a node's siblings give with ``value`` in its place."""
        for runs in self.runs:
            run, k = runs[position >> _BITS], position & (FAN - 1)
            if run[k] == value:
                return self.root  # the shared interior nodes are this very computation
            value = _hash([*run[:k], value, *run[k + 1 :]])
            position >>= _BITS
        return value


PROOF = "lang string, doc_id long, position long, leaf string, subroot string, proof binary, folded_root string"


def _expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of one partition."""
    size, place, places = (leaves.column(n)[0].as_py() for n in ("size", "place", "places"))
    got: dict[bool, dict[tuple[int, int], bytes]] = {True: {}, False: {}}
    for of, level, idx, value in zip(*(fetched.column(n).to_pylist() for n in ("of", "level", "idx", "hash"))):
        got[of == TOP][level, idx] = value.hex().encode()
    positions, own = leaves.column("position").to_pylist(), _hexes(leaves.column("leaf"))
    low = _Path(dict(zip(positions, own)), size, got[False])
    high = _Path({place: low.root}, places, got[True])
    proofs = low.siblings(high.siblings()[place])
    folded = []
    for position, mine, claim in zip(positions, own, leaves.column("claim").to_pylist()):
        value = mine if claim is None else claim.hex().encode()
        folded.append(high.fold(place, low.fold(position, value)).decode())
    return pa.table(
        {
            "lang": leaves.column("lang"),
            "doc_id": leaves.column("doc_id"),
            "position": leaves.column("position"),
            "leaf": pa.array([v.decode() for v in own], pa.string()),
            "subroot": pa.array([low.root.decode()] * len(own), pa.string()),
            "proof": pa.array([proofs[p] for p in positions], pa.binary()),
            "folded_root": pa.array(folded, pa.string()),
        }
    )


def prove(manifest: Manifest, wanted: Column | None = None) -> DataFrame:
    """Per leaf: lang, doc_id, position, leaf, subroot, root, proof (digests of its siblings), folded_root, verified.

    ``wanted`` chooses leaves by a condition on the columns of ``manifest.leaves``; all by default.
    """
    part = F.shiftright("position", SPAN)
    leaves = manifest.leaves if wanted is None else manifest.leaves.filter(wanted)
    # salted, so that the blocks of a large tree are neither joined nor, by reuse of the exchange, proved in one task
    leaves = salted_lookup(leaves, manifest.roots, ["tree"], ["position"], how="inner").withColumn("part", part)
    coordinates = leaves.select("tree", "part", "position", "size", "place", "places")
    wishes = settle(
        coordinates.groupBy("tree", "part").applyInArrow(_wishes, "tree string, part long, of string, level int, idx long"), "manifest-wishes"
    )
    fetched = fetch(wishes, manifest, with_leaves=wanted is not None)
    proofs = leaves.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(_expand, PROOF)
    root = F.lit(manifest.root).cast("string")
    return proofs.select(
        "lang", "doc_id", "position", "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def fetch(wishes: DataFrame, manifest: Manifest, with_leaves: bool) -> DataFrame:
    """``wishes`` with the hash of each coordinate.

    A coordinate is looked up once for each salt and handed on to at most about REQUESTS_PER_SALT partitions
    from there; leaves are looked up only if a partition may lack some of its own block.
    """
    nodes = manifest.nodes
    if with_leaves:
        bottom = manifest.leaves.select("tree", F.lit(0).alias("level"), F.col("position").alias("idx"), F.col("leaf").alias("hash"))
        nodes = nodes.union(bottom)
    nodes = nodes.withColumnRenamed("tree", "of")
    salts = manifest.parts // REQUESTS_PER_SALT + 1
    salted = wishes.withColumn("salt", F.pmod(F.xxhash64("tree", "part"), F.lit(salts)).cast("int"))
    where = ["of", "level", "idx"]
    found = salted.select(*where, "salt").distinct().join(nodes, where)
    return salted.join(found, [*where, "salt"]).select("tree", "part", *where, "hash")


def tampered() -> Column:
    """A claim for ``build``: the leaf with its text's A-Z lower-cased, where 3 divides the crc32 of the doc_id."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen & F.col("text").isNotNull(), leaf({"text": F.translate("text", capitals, capitals.lower())}))
