"""Words and fingerprints of Arrow string columns, as numpy arrays inside Spark tasks.

All functions work on the UTF-8 buffers of a column, so no text becomes a Python string. A text is
handled in pieces of bounded size, so scratch memory does not follow the longest text; what is kept
for a text is a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
PIECE_BYTES = 1 << 16  # what :func:`words` fingerprints at once: its scratch arrays stay in the processor's cache
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(NamedTuple):
    """Words of a column in text order: row, first byte and end in the buffer, 64-bit fingerprint."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def powers(n: int, base: int = int(_BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=8)
def byte_values(lower: bool, seed: int = 7) -> np.ndarray:
    """A random 64-bit number for each byte; with ``lower``, A-Z have those of a-z."""
    table = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
    table += np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def _class_table(allowed: str) -> np.ndarray:
    table = np.zeros(256, bool)
    if allowed == "space":  # anything but blanks
        table[:] = True
        table[[32, *range(9, 14)]] = False
    elif allowed == "signs":  # visible ASCII signs
        table[33:127] = True
        table &= ~CLASSES["alnum"]
    else:  # letters, digits and everything outside ASCII
        table[128:] = True
        for lo, hi in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(lo) : ord(hi) + 1] = True
    return table


CLASSES = {"alnum": _class_table("alnum")}
CLASSES |= {name: _class_table(name) for name in ("space", "signs")}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    width = 8 if wide else 4
    own = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width) if offsets else np.zeros(1, kind)
    own = own.astype(np.int64)
    if len(own) < len(column) + 1:
        own = np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[own[0] : own[-1]], own - own[0]


def with_text(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """The batch with a column ``text``: column ``at`` itself, or the field of that name of its rows (a view)."""
    column = batch.column(at)
    text = column.field("text") if pa.types.is_struct(column.type) else column
    return pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes; a longer text is a run of its own."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(name)))
    at, n = 0, batch.num_rows
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(n, max(stop, at + 1))
        yield batch.slice(at, stop - at)
        at = stop


def _pieces(data: np.ndarray, inside: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end between words (or later, where a word is longer)."""
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + size)
        while stop < n:
            gap = np.flatnonzero(~inside[stop - 1 : stop + size])
            if len(gap):
                stop = min(n, stop + int(gap[0]))
                break
            stop = min(n, stop + size)
        yield at, stop
        at = stop


def words(column: pa.Array, kind: str = "space", lower: bool = True, piece: int = PIECE_BYTES) -> Words:
    """All words of a column; words never cross rows."""
    data, offsets = buffers(column)
    inside = CLASSES[kind][data]
    edge = np.empty(len(data) + 1, bool)
    if len(data):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts] & inside[cuts - 1]]  # a text that begins inside a run of word bytes
    bounds = np.flatnonzero(edge) if len(data) else np.zeros(0, np.int64)
    if len(both):
        both = np.unique(both)
        bounds = np.sort(np.concatenate([bounds, both, both]))
    start, end = bounds[0::2], bounds[1::2]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    out = np.empty(len(start), np.uint64)
    values = byte_values(lower)
    for lo, hi in _pieces(data, inside, piece):
        first, last = np.searchsorted(start, lo), np.searchsorted(start, hi)
        if first == last:
            continue
        lo, hi = int(start[first]), int(end[last - 1])
        up, down = powers(1 << max(16, (hi - lo).bit_length()))
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[first:last] - lo, end[first:last] - lo
        out[first:last] = (total[e] - total[s]) * down[s]
    return Words(row, start, end, mix(out))


def row_spans(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's entries begin in a sorted row index, with the end."""
    return np.searchsorted(row, np.arange(rows + 1))


def shingles(found: Words, rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of the distinct ``width``-word shingles of each row, sorted by row.

    A row with fewer words has its whole word sequence as its only shingle.
    """
    spans = row_spans(found.row, rows)
    count = np.diff(spans)
    n = len(found.hash)
    value = np.zeros(n, np.uint64)
    factor = np.uint64(0xD1342543DE82EF95)
    for k in range(width):
        value[: n - k] = value[: n - k] * factor + found.hash[k:] if n > k else value[: n - k]
    inside = np.arange(n) + width <= spans[found.row + 1]
    row, value = found.row[inside], mix(value[inside])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.array(
            [_sequence(found.hash[spans[r] : spans[r + 1]], factor) for r in short], np.uint64
        )
        row, value = np.concatenate([row, short]), np.concatenate([value, mix(extra)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def _sequence(hashes: np.ndarray, factor: np.uint64) -> int:
    total = len(hashes) * 0x632BE59BD9B4E019
    for h in hashes:
        total = (total * int(factor) + int(h)) & 0xFFFFFFFFFFFFFFFF
    return total
