"""SimHash near-dedup with pivot distance tables.

A fingerprint of 64 bits is the bitwise majority of the XXH64 digests of a text's four-word shingles, repeats
included. Fingerprints link at ``RADIUS`` or fewer differing bits; classes are the components of these links.

For every distinct fingerprint the Hamming distances to many reference fingerprints (pivots) are computed once. Two
fingerprints at distance r differ by at most r in each of these coordinates. The pivots come in two kinds:

* *Families.* A family has a base pivot and, for each bit of one block of the 64, the base with that bit turned. The
  family's coordinates rise or fall by one against its base's, and two fingerprints have all of a family's differences
  equal exactly if they agree in its block. Of ``RADIUS + a`` blocks a linked pair agrees in at least ``a``, so pairs are
  looked for only among fingerprints that have equal coordinates for some ``a`` families: one table for each choice.
  ``a`` grows with the number of fingerprints, so that a key has few of them however many there are.
* *Scattered pivots.* Within a key, pairs whose largest coordinate difference over the scattered pivots exceeds ``RADIUS``
  are discarded; the survivors are verified on their bits.

A task emits a spanning forest of the links in a key, never all pairs: it walks from a fingerprint to all that are
linked to it and not yet reached, so fingerprints that are close together cost little more than one comparison
each. Keys that hold more than ``CROWDED`` fingerprints are first divided by the same rule over the blocks that the key
leaves open, which loses no pair.

Defined results: null, empty and blank texts have the fingerprint zero and are linked with each other (and with what
else lies within the radius of zero); a text of fewer than four words is one shingle; repeated rows and copies are one
fingerprint from the start; a null doc_id takes part but names no component (null, where no other id is reached); a
very long text is hashed in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tickerloom.llm import texts
from tickerloom.llm.graph import components
from tickerloom.llm.tables import map_arrow, settle, workers_import

WORDS, SEED, RADIUS = 4, 42, 4
PIECE = 1 << 16  # shingles hashed at once
SCATTERED = 24
LOAD = 64  # fingerprints that a key may hold on average
PAIRED, PAIRS_AT_ONCE = 64, 1 << 20  # keys of at most PAIRED members are compared pair by pair, many keys at once
CROWDED = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- fingerprints


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of a column's words, lower-cased and with one space between any two of a text."""
    data, offsets = texts.buffers(column)
    inside = texts.CLASSES["space"][data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = inside[heads]
    start = np.flatnonzero(begin)
    row = np.searchsorted(offsets, start, side="right") - 1
    # each word keeps its bytes and is followed by one blank
    word = np.cumsum(begin)[inside] - 1
    length = np.bincount(word, minlength=len(start)) if len(start) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(length + 1)]).astype(np.int64)
    out = np.full(int(at[-1]), 32, np.uint8)
    out[np.arange(len(word)) + word] = _LOWER[data[inside]]
    return out, at[:-1], at[1:] - 1, row


def simhashes(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text of a column."""
    data, start, end, row = normalized(column)
    rows = len(column)
    spans = texts.row_spans(row, rows)
    count = np.diff(spans)
    first = np.arange(len(start))
    keep = first + WORDS <= spans[row + 1] if len(row) else np.zeros(0, bool)
    keep |= (count[row] < WORDS) & (first == spans[row]) if len(row) else keep
    first = first[keep]
    owner = row[first]
    last = np.minimum(first + WORDS, spans[owner + 1]) - 1
    lo, hi = start[first], end[last]
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    totals, n = np.zeros((rows, 64), np.int64), np.zeros(rows, np.int64)
    for at in range(0, len(lo), PIECE):
        part = slice(at, at + PIECE)
        found = [digest(view[a:b], SEED) for a, b in zip(lo[part].tolist(), hi[part].tolist())]
        bits = np.unpackbits(np.array(found, ">u8").view(np.uint8)).reshape(-1, 64)
        edges = np.flatnonzero(np.r_[True, np.diff(owner[part]) != 0])
        who = owner[part][edges]
        totals[who] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
        n[who] += np.diff(np.r_[edges, len(bits)])
    return np.packbits(2 * totals > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint (64 bits, as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                found = simhashes(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    schema = StructType([StructField("doc_id", LongType()), StructField("fingerprint", LongType())])
    return map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


# ---- pivots


def blocks(bits: np.ndarray | int, parts: int) -> list[np.ndarray]:
    """The bits (numbers, or how many) cut into ``parts`` blocks of nearly equal length."""
    return np.array_split(np.arange(bits) if isinstance(bits, int) else bits, parts)


_rng = np.random.Generator(np.random.PCG64(23))
BASE = np.uint64(_rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
TURNED = BASE ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # one pivot of a family for each bit
FAR = _rng.integers(0, 1 << 64, SCATTERED, dtype=np.uint64)


def distances(fingerprint: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot distance table: (fingerprints, pivots) Hamming distances."""
    return np.bitwise_count(fingerprint[:, None] ^ pivots[None, :])


def family_keys(fingerprint: np.ndarray, parts: int, agree: int, free: np.ndarray | None = None) -> np.ndarray:
    """(fingerprints, tables) keys: equal in a table exactly if the coordinates of the table's families are equal.

    One table for each choice of ``agree`` of the ``parts`` blocks of ``free`` (all bits by default).
    """
    free = np.arange(64) if free is None else free
    rise = distances(fingerprint, TURNED[free]) > distances(fingerprint, np.array([BASE]))
    numbers = np.zeros((len(fingerprint), parts), np.uint64)
    for k, block in enumerate(blocks(len(free), parts)):
        for bit in block:
            numbers[:, k] = numbers[:, k] * np.uint64(2) + rise[:, bit]
    tables = list(combinations(range(parts), agree))
    out = np.empty((len(fingerprint), len(tables)), np.uint64)
    for t, chosen in enumerate(tables):
        key = np.full(len(fingerprint), t + 1, np.uint64)
        for k in chosen:
            key = texts.mix(key * np.uint64(0x9E3779B97F4A7C15) + numbers[:, k])
        out[:, t] = key
    return out


def agreement(count: int) -> int:
    """How many blocks keys are made of, for ``count`` distinct fingerprints: expected load at most LOAD."""
    for agree in range(2, 9):
        if count * 2.0 ** -(64 * agree / (RADIUS + agree)) <= LOAD:
            return agree
    return 8


def _shared_blocks(agree: int) -> list[np.ndarray]:
    """Per table, the bits that its keys leave open."""
    cut = blocks(64, RADIUS + agree)
    return [np.concatenate([cut[k] for k in range(len(cut)) if k not in chosen]) for chosen in combinations(range(len(cut)), agree)]


def forest(fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links of at most RADIUS bits among distinct fingerprints connect."""
    order = np.argsort(distances(fingerprint, FAR[:1])[:, 0], kind="stable")
    value = fingerprint[order]
    table = distances(value, FAR).astype(np.int8)
    unseen = np.arange(len(value))
    out: list[tuple[np.ndarray, int]] = []
    while len(unseen):
        queue = [int(unseen[0])]
        unseen = unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            # the first coordinate is sorted: only its window can hold a linked fingerprint
            lo, hi = np.searchsorted(table[unseen, 0], [table[at, 0] - RADIUS, table[at, 0] + RADIUS + 1]) if len(unseen) > 64 else (0, len(unseen))
            near = unseen[lo:hi]
            for c in range(1, SCATTERED):
                if len(near) < 16:
                    break
                near = near[np.abs(table[near, c] - table[at, c]) <= RADIUS]
            near = near[np.bitwise_count(value[near] ^ value[at]) <= RADIUS]
            if len(near):
                out.append((near, at))
                queue.extend(near.tolist())
                unseen = np.setdiff1d(unseen, near, assume_unique=True)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a = np.concatenate([near for near, _ in out])
    b = np.repeat([at for _, at in out], [len(near) for near, _ in out])
    return value[a], value[b]


LINK = "a long, b long"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _links_of_key(table: pa.Table) -> pa.Table:
    a, b = forest(np.asarray(table.column("fingerprint")).view(np.uint64))
    return pa.Table.from_batches([_pairs(a, b)])


def stars(members: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as ``forest`` gives them, for many keys of at most PAIRED members each: each member and its class's first."""
    value, size = members, np.diff(offsets)
    left = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(value))  # members of the same key behind each
    i = np.repeat(np.arange(len(value)), left)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
    table = distances(value, FAR).astype(np.int8)
    for c in range(SCATTERED):
        near = np.abs(table[i, c] - table[j, c]) <= RADIUS
        i, j = i[near], j[near]
    linked = np.bitwise_count(value[i] ^ value[j]) <= RADIUS
    i, j = i[linked], j[linked]
    first = np.arange(len(value))
    while True:
        low = np.minimum(first[i], first[j])
        if (low == np.maximum(first[i], first[j])).all():
            break
        np.minimum.at(first, i, low)
        np.minimum.at(first, j, low)
    own = np.flatnonzero(first != np.arange(len(value)))
    return value[own], value[first[own]]


def _links_of_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of keys that come as arrays of fingerprints."""
    for batch in batches:
        column = batch.column("members")
        members, offsets = np.asarray(column.values).view(np.uint64), np.asarray(column.offsets).astype(np.int64)
        size = np.diff(offsets)
        for k in np.flatnonzero(size > PAIRED):
            yield _pairs(*forest(members[offsets[k] : offsets[k + 1]]))
        few = np.flatnonzero(size <= PAIRED)
        weight = np.cumsum(size[few] ** 2) // PAIRS_AT_ONCE
        for run in np.split(few, np.flatnonzero(np.diff(weight)) + 1):
            # the chosen keys of a run, made contiguous
            at = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in run]) if len(run) else np.zeros(0, np.int64)
            yield _pairs(*stars(members[at], np.r_[0, np.cumsum(size[run])]))


def links(distinct: DataFrame, agree: int) -> DataFrame:
    """(a, b): enough pairs of fingerprints within RADIUS to connect what all such pairs connect."""
    parts, tables = RADIUS + agree, len(_shared_blocks(agree))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.asarray(batch.column(0)).view(np.uint64)
            keys = family_keys(value, parts, agree)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(value))),
                    pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.repeat(value, tables).view(np.int64)),
                ],
                ["at", "key", "fingerprint"],
            )

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, key = np.asarray(batch.column("at")), np.asarray(batch.column("key")).view(np.uint64)
            value = np.asarray(batch.column("fingerprint")).view(np.uint64)
            for t in np.unique(at):
                mine = at == t
                finer = family_keys(value[mine], RADIUS + 1, 1, open_bits[t])
                finer = texts.mix(finer ^ key[mine][:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(finer.ravel().view(np.int64)), pa.array(np.repeat(value[mine], finer.shape[1]).view(np.int64))],
                    ["key", "fingerprint"],
                )

    open_bits = _shared_blocks(agree)
    table = settle(map_arrow(distinct.select("fingerprint"), keyed, "at int, key long, fingerprint long"), "pivot-table")
    load = settle(table.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "pivot-load")
    small, crowded = load.filter(F.col("n") <= CROWDED).select("key"), load.filter(F.col("n") > CROWDED).select("key")
    members = table.join(small, "key").groupBy("key").agg(F.collect_list("fingerprint").alias("members")).select("members")
    finer = map_arrow(table.join(crowded, "key"), divided, "key long, fingerprint long")
    return map_arrow(members, _links_of_row, LINK).union(finer.groupBy("key").applyInArrow(_links_of_key, LINK)).distinct()


# ---- classes


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id (smallest doc_id reachable) and links (of the fingerprint's class)."""
    workers_import(documents.sparkSession)
    marks = settle(fingerprints(documents), "pivot-marks")
    distinct = settle(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "pivot-distinct")
    found = components(links(distinct, agreement(distinct.count())))
    named = distinct.join(found, distinct["fingerprint"] == found["node"], "left")
    named = named.select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("class"))
    smallest = named.groupBy("class").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "class").select("fingerprint", "component_id")
    return marks.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")
