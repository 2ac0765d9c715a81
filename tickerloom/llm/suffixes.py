"""Suffix-array dedup by distributed prefix doubling on sampled positions.

A byte is removed where it is covered by a ``WINDOW``-byte string that also starts somewhere else. Sorting
every position of a corpus is not affordable, so the positions that are ranked are sampled first and the
exact ends are found by doubling back:

1. Anchors. In each window the smallest fingerprint of its ``CORE``-byte strings is its anchor (the leftmost,
   where several are equal); equal windows have equal anchors. The windows of one anchor follow each other,
   and there is one anchor per 65 bytes of text.
2. Positions whose core is unique hold no repeated window and fall out. The others are ranked by the whole
   stretch that the windows of their anchor cover, as a pair: the rank (a 64-bit fingerprint) of its head and
   that of its tail at an offset. Positions of equal pairs are repeated throughout.
3. The rest (one position for each distinct stretch of a core) is ranked at growing lengths, ``LENGTHS``:
   at each, position-rank pairs are grouped by Spark, and a position and offset whose pair is unique falls
   out, until the length is the window. What is left then are exactly the repeated windows.

For one anchor only its first and last repeated window matter, since all windows of an anchor overlap. Pair
counts combine before the shuffle, and pairs return to their positions by joins that Spark can split, so a
passage that a third of all texts hold is no group in any task. Equal texts are one text with a count.

Ranks of 200-byte strings are pairs of fingerprints, 128 bits: equal ranks are taken for equal strings.

Defined results: null and empty texts have 0 bytes, nothing removed and the digest of nothing; repeated rows
and repeated ids are documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickerloom.llm import texts
from tickerloom.llm.tables import map_arrow, settle, workers_import

WINDOW = 200
CORE = 73
SLOTS = WINDOW - CORE + 1  # offsets of a window before its anchor: 0 .. 127
LENGTHS = (185, 200)  # a string of 185 bytes is what 16 neighbouring windows share
PIECE = 1 << 21


class Anchors(NamedTuple):
    """Anchors of a column: row, place of the core, first and last window (in the row's text), and ranks."""

    row: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    head: np.ndarray
    tail: np.ndarray


class Ranks:
    """Fingerprints of substrings of a buffer, by prefix sums of powers (two independent ones)."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.sums = data, {}

    def of(self, start: np.ndarray, length, seed: int = 0) -> np.ndarray:
        if seed not in self.sums:
            n = len(self.data)
            up, down = texts.powers(1 << max(16, n.bit_length()), 0x9E3779B97F4A7C15 + 2 * seed)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(texts.byte_values(False, 7 + seed)[self.data] * up[:n], out=total[1:])
            self.sums[seed] = total, down
        total, down = self.sums[seed]
        return texts.mix((total[start + length] - total[start]) * down[start] + np.asarray(length, np.uint64))

    def pair(self, start: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the head, and rank of the tail at an offset of half the length."""
        half = length // 2
        return self.of(start, half), self.of(start + half, length - half, 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(column: pa.Array, with_pairs: bool = True) -> Anchors:
    """Anchors of every text, in order. A long text is gone through in pieces that overlap by a window.

    An anchor whose windows lie in two pieces counts once in each: it is then ranked by a shorter stretch,
    and its windows are compared one by one like those of any other unresolved position.
    """
    data, offsets = texts.buffers(column)
    found = [_anchors_of(data, offsets, begin, min(len(data), begin + PIECE), with_pairs) for begin in range(0, len(data), PIECE)]
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, *[np.zeros(0, np.uint64)] * 3)
    return Anchors(*(np.concatenate(x) for x in zip(*found)))


def _anchors_of(data: np.ndarray, offsets: np.ndarray, begin: int, end: int, with_pairs: bool) -> Anchors:
    """Of the windows that begin in [begin, end) of the buffer."""
    own = data[begin : min(len(data), end + WINDOW - 1)]
    ranks = Ranks(own)
    starts = np.arange(max(0, len(own) - WINDOW + 1))
    row = np.searchsorted(offsets, starts + begin, side="right") - 1
    whole = starts + begin + WINDOW <= offsets[row + 1]  # windows do not cross texts
    if not whole.any():
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, *[np.zeros(0, np.uint64)] * 3)
    places = np.arange(len(own) - CORE + 1)
    bits = np.uint64(max(1, len(own).bit_length()))
    key = (ranks.of(places, CORE) >> bits << bits) | places.astype(np.uint64)  # the leftmost of equal fingerprints wins
    at = (_sliding_min(key, SLOTS) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    low = np.flatnonzero(whole)
    at, row = at[low], row[low]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    high = low[np.r_[first[1:] - 1, len(low) - 1]]
    low, at, row = low[first], at[first], row[first]
    core = ranks.of(at, CORE)
    pair = ranks.pair(low, high - low + WINDOW) if with_pairs else (core, core)
    shift = begin - offsets[row]
    return Anchors(row, at + shift, low + shift, high + shift, core, *pair)


def _lists(values: np.ndarray, spans: np.ndarray) -> pa.ListArray:
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(spans.astype(np.int32), pa.array(values))


def marked(documents: DataFrame) -> DataFrame:
    """doc_id, digest and length of every text, and the cores of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                found = anchors(part.column(1), with_pairs=False)
                length = np.diff(texts.buffers(part.column(1))[1])
                spans = texts.row_spans(found.row, part.num_rows)
                columns = [part.column(0), part.column(2), pa.array(length), _lists(found.core, spans)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_bytes", "cores"])

    return map_arrow(_digested(documents), run, "doc_id long, digest binary, n_bytes long, cores array<long>")


def _digested(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def distinct_texts(marks: DataFrame) -> DataFrame:
    """digest, copies, first (smallest doc_id) and tid, a number of its own for each distinct text.

    The number is the first doc_id where that names one text only, else a negative number from the digest.
    """
    groups = marks.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    same = groups.groupBy("first").agg(F.count("*").alias("same")).withColumnRenamed("first", "of")
    own = F.when((F.col("same") == 1) & (F.col("first") >= 0), F.col("first")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("digest"), 1))
    return groups.join(same, F.col("first").eqNullSafe(F.col("of"))).select("digest", "copies", "first", own.alias("tid"))


def _of_first(frame: DataFrame, distinct: DataFrame) -> DataFrame:
    """Rows of the frame that stand for a distinct text (copies of one text are spread by doc_id)."""
    right = distinct.withColumnsRenamed({"digest": "of_digest"})
    return frame.join(right, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("first"))).drop("of_digest", "first")


def _repeated(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows whose rank occurs more than once."""
    return frame.join(frame.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1").drop("times"), list(keys))


def _packed(documents: DataFrame) -> DataFrame:
    """doc_id, digest and the compressed text of every row: texts move in half the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            data, offsets = texts.buffers(batch.column(1))
            parts = [codec.compress(data[i:j].tobytes(), asbytes=True) for i, j in zip(offsets[:-1], offsets[1:])]
            columns = [batch.column(0), batch.column(2), pa.array(np.diff(offsets)), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_bytes", "packed"])

    return map_arrow(_digested(documents), run, "doc_id long, digest binary, n_bytes long, packed binary")


def _unpacked(column: pa.Array, sizes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 3)
    parts = [codec.decompress(p.as_buffer(), n, asbytes=True) if n else b"" for p, n in zip(column, sizes.to_pylist())]
    return pa.array(parts, pa.binary()).cast(pa.string())


def active_texts(documents: DataFrame, marks: DataFrame, distinct: DataFrame) -> DataFrame:
    """Texts that hold a repeated core: tid, text, and the anchors of repeated cores."""
    cores = _of_first(marks, distinct).select("tid", F.posexplode("cores").alias("number", "core"))
    kept = _repeated(cores, "core").groupBy("tid").agg(F.collect_list("number").alias("numbers"))
    wanted = kept.join(distinct, "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "packed", texts.SLICE_BYTES // 2):
                text = _unpacked(part.column(1), part.column(2))
                found = anchors(text)
                spans = texts.row_spans(found.row, part.num_rows)
                chosen = part.column(3)
                flat = np.asarray(chosen.flatten()).astype(np.int64)
                counts = np.asarray(chosen.value_lengths())
                at = np.sort(flat + np.repeat(spans[:-1], counts))
                ends = np.r_[0, np.cumsum(counts)]
                lists = [_lists(x[at], ends) for x in (found.at, found.low, found.high, found.core, found.head, found.tail)]
                yield pa.RecordBatch.from_arrays([part.column(0), text, *lists], ["tid", "text", *PLACE])

    lists = ", ".join(f"{name} array<long>" for name in PLACE)
    found = _of_first(_packed(documents), wanted).select("tid", "packed", "n_bytes", "numbers")
    return map_arrow(found, run, f"tid long, text string, {lists}")


PLACE = ["at", "low", "high", "core", "head", "tail"]


def contexts(active: DataFrame, chosen: DataFrame) -> DataFrame:
    """pid, tid, at, and the bytes around each chosen anchor with the offsets of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                data, offsets = texts.buffers(part.column(1))
                numbers, flat = part.column(2), {}
                counts = np.asarray(numbers.value_lengths())
                row = np.repeat(np.arange(part.num_rows), counts)
                pick = np.asarray(numbers.flatten()).astype(np.int64)
                for k, name in enumerate(("at", "low", "high"), 3):
                    lists = part.column(k)
                    begin = np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))][:-1]
                    flat[name] = np.asarray(lists.flatten())[begin[row] + pick]
                left = np.maximum(0, flat["at"] - SLOTS + 1)
                right = np.minimum(np.diff(offsets)[row], flat["at"] + WINDOW)
                size = right - left
                ends = np.r_[0, np.cumsum(size)]
                where = np.arange(ends[-1]) - np.repeat(ends[:-1] - (offsets[row] + left), size)
                around = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[where])])
                columns = [np.asarray(part.column(0))[row], flat["at"], flat["at"] - left, flat["at"] - flat["high"], flat["at"] - flat["low"]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), around.cast(pa.binary())], ["tid", "at", "lead", "least", "most", "around"])

    rows = active.join(chosen, "tid").select("tid", "text", "numbers", "at", "low", "high")
    schema = "tid long, at long, lead long, least long, most long, around binary"
    return map_arrow(rows, run, schema).withColumn("pid", F.monotonically_increasing_id())


def ranked(frame: DataFrame, length: int, given: str | None = None, width: int = 1) -> DataFrame:
    """pid, slot and rank pair of the strings of ``length`` bytes that all windows of a slot share.

    A slot holds WINDOW - length + 1 neighbouring windows; ``given`` names a list of the slots of ``width``
    windows to go through, else all slots that hold a window of the anchor are.
    """
    span = WINDOW - length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, "around"):
                n = part.num_rows
                pid, lead, least, most = (np.asarray(part.column(k)) for k in range(4))
                _, offsets = texts.buffers(part.column(4))
                data, _ = texts.buffers(part.column(4))
                if given:
                    lists = part.column(5)
                    row = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
                    slot = (np.asarray(lists.flatten()).astype(np.int64)[:, None] * (width // span) + np.arange(width // span)).ravel()
                    row = np.repeat(row, width // span)
                else:
                    row, slot = np.repeat(np.arange(n), SLOTS // span), np.tile(np.arange(SLOTS // span), n)
                inside = (slot * span <= most[row]) & (slot * span + span - 1 >= least[row])
                row, slot = row[inside], slot[inside]
                start = offsets[row] + lead[row] - slot * span
                head, tail = Ranks(data).pair(start, length) if len(start) else (np.zeros(0, np.uint64),) * 2
                columns = [pid[row], slot, head.view(np.int64), tail.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["pid", "slot", "head", "tail"])

    columns = ["pid", "lead", "least", "most", "around", *([given] if given else [])]
    return map_arrow(frame.select(*columns), run, "pid long, slot long, head long, tail long")


def spans(active: DataFrame) -> DataFrame:
    """tid, start, stop: stretches of repeated windows of each text."""
    zipped = F.arrays_zip("low", "high", "core", "head", "tail")
    stretches = active.select("tid", F.posexplode(zipped).alias("number", "s")).select("tid", "number", "s.*")
    key = ["core", "head", "tail"]
    groups = settle(
        stretches.groupBy(*key).agg(F.count("*").alias("times"), F.min("tid").alias("tid"), F.min_by("number", "tid").alias("number")),
        "suffix-stretches",
    )
    whole = stretches.join(groups.filter("times > 1").select(*key), key).select("tid", F.col("low").alias("start"), (F.col("high") + WINDOW).alias("stop"))
    unresolved = groups.groupBy("core").agg(F.min("times").alias("rarest"), F.count("*").alias("kinds")).filter("rarest = 1 and kinds > 1").select("core")
    chosen = groups.join(unresolved, "core").groupBy("tid").agg(F.collect_list("number").alias("numbers"))
    around = settle(contexts(active, chosen), "suffix-contexts")
    alive, width = None, None
    for length in LENGTHS:
        given = "slots" if alive is not None else None
        frame = around if alive is None else around.join(alive, "pid")
        left = _repeated(ranked(frame, length, given, width), "head", "tail")  # cheaper to rank twice than to store
        alive, width = left.groupBy("pid").agg(F.collect_list("slot").alias("slots")), WINDOW - length + 1
    ends = left.groupBy("pid").agg(F.min("slot").alias("near"), F.max("slot").alias("far"))
    found = around.select("pid", "tid", "at").join(ends, "pid").select(
        "tid", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + WINDOW).alias("stop")
    )
    return whole.union(found)


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open ranges."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.r_[True, starts[1:] > stops[:-1]]
    return starts[fresh], stops[np.r_[fresh[1:], True]]


def _kept(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[stops] -= 1
    return data[np.cumsum(change[:-1], dtype=np.int8) == 0]


class Repeats(NamedTuple):
    marks: DataFrame
    distinct: DataFrame
    active: DataFrame
    spans: DataFrame


def repeats(documents: DataFrame) -> Repeats:
    """What repeats in the documents: marks of every row, distinct texts, and spans by text number."""
    workers_import(documents.sparkSession)
    marks = settle(marked(documents), "suffix-marks")
    distinct = settle(distinct_texts(marks), "suffix-distinct")
    active = settle(active_texts(documents, marks, distinct), "suffix-active")
    listed = spans(active).groupBy("tid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    return Repeats(marks.drop("cores"), distinct, active.select("tid", "text"), listed)


def _cut(batches: Iterator[pa.RecordBatch], leave) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in texts.slices(batch):
            data, offsets = texts.buffers(part.column("text"))
            out = []
            for i in range(part.num_rows):
                lists = [np.asarray(part.column(k)[i].values) if part.column(k)[i].is_valid else np.zeros(0, np.int64) for k in ("starts", "stops")]
                own = data[offsets[i] : offsets[i + 1]]
                out.append((own, *merged(*lists)) if len(lists[0]) else (own, lists[0], lists[1]))
            yield leave(part, out)


def removal_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    found = repeats(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leave(part, out):
            removed = [int((stops - starts).sum()) for _, starts, stops in out]
            digest = [hashlib.sha256(_kept(*x).tobytes()).hexdigest() for x in out]
            columns = [part.column(0), pa.array(removed, pa.int64()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array(digest)]
            return pa.RecordBatch.from_arrays(columns, ["tid", "removed", "runs", "sha"])

        return _cut(batches, leave)

    cut = map_arrow(found.active.join(found.spans, "tid").select("tid", "text", "starts", "stops"), run, "tid long, removed long, runs long, sha string")
    cut = cut.dropDuplicates(["tid"])
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    by_text = found.distinct.join(cut, "tid", "left").drop("tid", "first")
    return found.marks.join(by_text, "digest").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with repeated bytes cut out of their texts, in two columns: the row, and bytes removed.

    Characters that a cut leaves incomplete go as well. Rows without repeats pass unchanged.
    """
    found = repeats(documents)
    by_text = found.distinct.join(found.spans, "tid", "left").select(F.col("digest").alias("of"), "copies", "starts", "stops")
    names = documents.columns
    rows = documents.select(F.struct(*names).alias("row"))
    digest = F.unhex(F.sha2(F.coalesce("row.text", F.lit("")), 256))
    copied = (F.col("copies") > 1) & (F.octet_length("row.text") >= WINDOW)
    joined = rows.join(by_text, digest == F.col("of")).select(
        "row",
        F.when(copied, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"),
        F.when(copied, F.array(F.octet_length("row.text").cast("long"))).otherwise(F.col("stops")).alias("stops"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leave(part, out):
            left = [_kept(*x).tobytes().decode("utf-8", "ignore") if len(x[1]) else None for x in out]
            removed = [int((stops - starts).sum()) for _, starts, stops in out]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(left, pa.string()), pa.array(removed, pa.int64())], ["row", "left", "removed"])

        return _cut((texts.with_text(batch, 0) for batch in batches), leave)

    schema = StructType([joined.schema["row"], StructField("left", StringType()), StructField("removed", LongType())])
    cut = map_arrow(joined, run, schema)
    text = [F.coalesce("left", "row.text").alias("text") if n == "text" else F.col("row")[n].alias(n) for n in names]
    return cut.select(F.struct(*text).alias("row"), "removed")
