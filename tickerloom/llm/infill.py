"""Fill-in-the-middle transformation with a sparse index of multibyte characters.

A text is cut at two of its units (words with the blanks before them, or code points) into prefix, middle and
suffix, which are put together again around sentinels in prefix-suffix-middle or suffix-prefix-middle order.

All cutting is done on UTF-8 bytes. Words end at byte positions and lengths are wanted in code points, so
positions are converted between the two: ``Exceptions`` records only the multibyte characters, where each one
begins and how many bytes beyond one it and those before it take. A binary search in that list converts any
number of positions in either direction; between exceptions one byte is one code point, so ASCII spans are plain
arithmetic and an ASCII text has an empty index.

Where to cut and which form to take comes from digests of the seed and doc_id alone, so reruns, other
partitionings and repeated rows agree. A text that holds a sentinel stays plain, so ``restore`` is exact.

Defined results: a null text is an empty one; empty texts are plain with 0 units; a text of blanks is one unit; a
null doc_id is hashed as an empty string; a very long text is handled whole in the task that holds it, with about
ten bytes of scratch for each of its bytes; repeated rows come out alike, once each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickerloom.llm import texts
from tickerloom.llm.tables import map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80


class Exceptions(NamedTuple):
    """Multibyte characters of a buffer: first byte, first byte as a code point, excess bytes before each (and of all)."""

    byte: np.ndarray
    point: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        byte = np.flatnonzero(data >= 0xC0)
        lead = data[byte]
        excess = np.zeros(len(byte) + 1, np.int64)
        np.cumsum((lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0), out=excess[1:])
        return cls(byte, byte - excess[:-1], excess)

    def points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte position (positions between characters)."""
        return byte - self.excess[np.searchsorted(self.byte, byte)]

    def bytes(self, point: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return point + self.excess[np.searchsorted(self.point, point)]


class Units(NamedTuple):
    """Units of each text of a buffer: number of units, and the byte where the k-th unit of a text ends."""

    count: np.ndarray
    cut: object  # (rows' k) -> byte positions


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Words with the blanks before them; blanks at the end are a unit."""
    start, stop = offsets[:-1], offsets[1:]
    inside = texts.CLASSES["space"][data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = stop > start
    last[stop[full] - 1] = inside[stop[full] - 1]  # a word at the end of a text, whatever the next text begins with
    ends = np.flatnonzero(last) + 1
    first = np.searchsorted(ends, start, side="right")
    words = np.searchsorted(ends, stop, side="right") - first
    blank_end = np.zeros(len(start), np.int64)
    blank_end[full] = ~inside[stop[full] - 1]
    padded = np.append(ends, 0)

    def cut(k: np.ndarray) -> np.ndarray:
        at = padded[np.minimum(first + np.maximum(k, 1) - 1, len(ends))]
        return np.where(k == 0, start, np.where(k > words, stop, at))

    return Units(words + blank_end, cut)


def point_units(data: np.ndarray, offsets: np.ndarray, index: Exceptions) -> Units:
    """Code points."""
    bounds = index.points(offsets)
    return Units(np.diff(bounds), lambda k: index.bytes(bounds[:-1] + k))


def _transform(table: pa.RecordBatch, unit: str) -> pa.RecordBatch:
    """One slice of rows (doc_id, text, h1, h2, fim, spm) to its output rows."""
    column = table.column("text").fill_null("")
    data, offsets = texts.buffers(column)
    index = Exceptions.of(data)
    units = word_units(data, offsets) if unit == "word" else point_units(data, offsets, index)
    n = units.count
    draws = [np.asarray(table.column(name)) % (n + 1) for name in ("h1", "h2")]
    one, two = units.cut(np.minimum(*draws)), units.cut(np.maximum(*draws))
    marked = np.zeros(len(n), bool)
    for sign in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(column, sign).to_numpy(zero_copy_only=False)
    fim = table.column("fim").to_numpy(zero_copy_only=False) & ~marked & (np.diff(offsets) > 0)
    spm = table.column("spm").to_numpy(zero_copy_only=False)
    form = np.where(fim, np.where(spm, "spm", "psm"), "plain")
    points = [index.points(at) for at in (offsets[:-1], one, two)]
    sizes = [pa.array(b - a, pa.int64(), mask=~fim) for a, b in zip(points, points[1:])]
    p, s, m = (sign.encode() for sign in (PREFIX, SUFFIX, MIDDLE))
    view, out = memoryview(data), []
    for name, a, b, c, d in zip(form.tolist(), offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist()):
        if name == "plain":
            out.append(bytes(view[a:d]))
        elif name == "psm":
            out.append(b"".join((p, view[a:b], s, view[c:d], m, view[b:c])))
        else:
            out.append(b"".join((s, view[c:d], p, view[a:b], m, view[b:c])))
    columns = [table.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *sizes, pa.array(out, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, OUTPUT.names)


OUTPUT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("n", LongType()),
        StructField("form", StringType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output", StringType()),
    ]
)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of eight digits of its hex sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    documents: DataFrame, unit: str = "word", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points, null where plain) and the output text.

    ``unit`` is ``word`` or ``point``. One pass without a shuffle.
    """
    if unit not in ("word", "point"):
        raise ValueError(f"unit must be word or point, not {unit!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                yield _transform(part, unit)

    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    source = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        h1.alias("h1"),
        h2.alias("h2"),
        (h3 % 100 < fim_percent).alias("fim"),
        (h4 % 100 < spm_percent).alias("spm"),
    )
    return map_arrow(source, run, OUTPUT)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of.

    No part holds a sentinel, and no sentinel ends as another begins, so the outermost occurrences are the true ones.
    """
    before = lambda text, sign: F.substring_index(text, sign, 1)
    after = lambda text, sign: F.substring_index(text, sign, -1)
    rest = lambda text: text.substr(F.lit(len(PREFIX) + 1), F.length(text))
    middle, outer = after(output, MIDDLE), before(output, MIDDLE)
    return (
        F.when(form == "psm", F.concat(rest(before(outer, SUFFIX)), middle, after(outer, SUFFIX)))
        .when(form == "spm", F.concat(after(outer, PREFIX), middle, rest(before(outer, PREFIX))))
        .otherwise(output)
    )
