"""Benchmark decontamination by latent semantic retrieval.

1. Weights. Every document is cut into passages of ``PASSAGE`` words; a word is hashed to one of ``BUCKETS``
   terms, and terms are weighted by inverse passage frequency, counted over all passages.
2. Randomised SVD. With A the TF-IDF matrix of all passages and O a random matrix of ``SKETCH`` columns,
   tasks add up their part of ``A'(A O)`` (a fixed number of rows each); the sum gives the leading right
   singular vectors and values of A by Nystrom's method (only terms x SKETCH numbers reach the driver).
3. Candidates. Every whole document is covered by overlapping windows. A window must hold ``SHARED`` of an item's
   squared weights (of as many of its words as it has room for), which lists of the items that hold a word count for all
   items at once; such windows and the items (long ones in segments) are folded into the latent space, ``x V / s``,
   and compared by cosine: those above ``COSINE`` are candidates. Items of fewer than ``SHORT`` words also meet windows of
   12 words, where ``COSINE_SHORT`` is enough.
4. Checks. The longest common subsequence of the item's words and the text around the window is measured. An item is found
   where it covers ``FULL`` of the item's words, or ``PARTLY`` of them and the item's answer (its last quarter of words,
   three at least) stands there word for word; an item of several segments also where it covers ``FULL`` of one.
5. Exact way. Whatever the cosine, an item that stands in a text word for word is found by fingerprints of runs
   of words (cosine 1, all words common).

Items are taken in groups of at most ``ITEMS_AT_ONCE`` per pass over the documents, so what a task holds of
the benchmark is bounded and any number of items is searched exactly alike.

Defined results: null and empty texts hold nothing; items with fewer than ``LEAST_WORDS`` words are not
searched; repeated rows and repeated items give rows of their own; of equally good places the first by common words,
cosine, answer and position counts; a very long text is searched whole; null ids pass through; an empty table on either
side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import texts
from tickerloom.llm.tables import map_arrow, workers_import

PASSAGE, BUCKETS, SKETCH, RANK = 32, 1 << 13, 56, 48
WINDOWS, SHORT = (12, 24, 48), 16  # each twice the one before; they step by half their width
COSINE, COSINE_SHORT, SHARED, FULL, PARTLY = 0.4, 0.2, 0.3, 0.75, 0.6
LEAST_WORDS, SEGMENT = 5, 48
ITEMS_AT_ONCE = 4096
FIXED_POINT = 1 << 10
DENSE = 1 << 20  # blocks times items counted at once
SLICE = 1 << 18


class Space(NamedTuple):
    """Projection of a term's count into the latent space, inverse frequencies included, and those."""

    fold: np.ndarray
    values: np.ndarray
    weight: np.ndarray


class Runs(NamedTuple):
    """Fingerprints of whole items by length, and of their first ``LEAST_WORDS`` words, with a table of those' top bits."""

    heads: np.ndarray
    likely: np.ndarray
    whole: dict[int, tuple[np.ndarray, np.ndarray]]


class Holders(NamedTuple):
    """Which of some items hold a word: of common words as rows of a matrix, of the others as lists."""

    items: np.ndarray
    common: np.ndarray
    matrix: np.ndarray
    start: np.ndarray
    listed: np.ndarray


class Items(NamedTuple):
    """Items as lists of word numbers in their common vocabulary, and their segments in the latent space."""

    ids: list
    words: list[np.ndarray]
    vectors: np.ndarray
    segments: list[list[int]]
    pieces: list[np.ndarray]
    vocabulary: np.ndarray
    all: Holders
    short: Holders
    length: np.ndarray
    weight: np.ndarray
    runs: Runs


def _terms(found: texts.Words) -> np.ndarray:
    return (found.hash >> np.uint64(51)).astype(np.int64)


def _block_starts(found: texts.Words, rows: int, size: int) -> np.ndarray:
    """First word of every run of ``size`` words of a text."""
    begin = texts.row_spans(found.row, rows)[found.row]
    return np.flatnonzero((np.arange(len(found.row)) - begin) % size == 0)


def term_weights(documents: DataFrame) -> np.ndarray:
    """Inverse passage frequency of every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, passages = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for part in texts.slices(batch, limit=SLICE):
                found = texts.words(part.column(0), "alnum")
                starts = _block_starts(found, part.num_rows, PASSAGE)
                passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(found.row)]))
                key = np.sort(passage * BUCKETS + _terms(found))
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                count[:-1] += np.bincount(key % BUCKETS, minlength=BUCKETS)
                passages += len(starts)
        count[-1] = passages
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["term", "n"])

    counted = map_arrow(documents.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(BUCKETS + 1)
    for term, n in counted:  # BUCKETS + 1 rows at most
        total[term] = n
    return np.log((1 + total[-1]) / (1 + total[:-1]))


def fit(documents: DataFrame) -> Space:
    """Latent space of the passages of all documents."""
    weight = term_weights(documents)
    random = np.random.Generator(np.random.PCG64(3)).standard_normal((BUCKETS, SKETCH))
    probe = np.zeros((BUCKETS + 1, SKETCH), np.float32)  # the last row stands for the words that a short passage lacks
    probe[:-1] = random * weight[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SKETCH, BUCKETS))
        for batch in batches:
            for part in texts.slices(batch, limit=SLICE):
                found = texts.words(part.column(0), "alnum")
                if not len(found.row):
                    continue
                term, starts = _terms(found), _block_starts(found, part.num_rows, PASSAGE)
                size = np.diff(np.r_[starts, len(term)])
                sums, padded = np.zeros((len(starts), SKETCH), np.float32), np.r_[term, np.full(PASSAGE, BUCKETS)]
                for k in range(PASSAGE):
                    sums += probe[np.where(k < size, padded[starts + k], BUCKETS)]
                product = np.ascontiguousarray(sums.T, dtype=np.float64)
                passage = np.repeat(np.arange(len(starts)), size)
                for k in range(SKETCH):
                    total[k] += np.bincount(term, product[k][passage], BUCKETS)
        exact = np.rint(total.T * FIXED_POINT).astype(np.int64)
        some = np.flatnonzero(exact.any(axis=1))
        columns = [pa.array(some), *(pa.array(exact[some, k]) for k in range(SKETCH))]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["term", *(f"s{k}" for k in range(SKETCH))]
    partial = map_arrow(documents.select("text"), run, ", ".join(f"{n} long" for n in names))
    summed = partial.groupBy("term").agg(*(F.sum(n).alias(n) for n in names[1:])).collect()  # BUCKETS rows at most
    sketch = np.zeros((BUCKETS, SKETCH))
    for row in summed:
        sketch[row[0]] = row[1:]
    return _nystrom(sketch / FIXED_POINT * weight[:, None], random, weight)


def _nystrom(sketch: np.ndarray, random: np.ndarray, weight: np.ndarray) -> Space:
    """Right singular vectors and values of A from ``sketch = A'A random``."""
    size = np.linalg.norm(sketch)
    if not size:
        return Space(np.zeros((BUCKETS, RANK), np.float32), np.zeros(RANK), weight)
    shift = 1e-7 * size
    shifted = sketch + shift * random
    core = random.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, values.max() * 1e-12)
    left, s, _ = np.linalg.svd(shifted @ (vectors / np.sqrt(values)), full_matrices=False)
    s = np.sqrt(np.maximum(s[:RANK] ** 2 - shift, s[0] ** 2 * 1e-9))
    return Space((weight[:, None] * left[:, :RANK] / s).astype(np.float32), s, weight)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-20).astype(x.dtype)


def _holders(words: list[np.ndarray], chosen: np.ndarray, vocabulary: int) -> Holders:
    """Common words are those that a sixteenth of the chosen items hold."""
    own = [np.unique(words[i]) for i in chosen]
    held = np.concatenate([np.zeros(0, np.int64), *own])
    item = np.repeat(np.arange(len(own)), [len(w) for w in own])
    count = np.bincount(held, minlength=vocabulary + 1)
    often = np.flatnonzero(count > max(1, len(own) // 16))
    common = np.full(vocabulary + 1, -1)
    common[often] = np.arange(len(often))
    matrix = np.zeros((len(often), len(own)), np.float32)
    dense = common[held] >= 0
    matrix[common[held[dense]], item[dense]] = 1
    held, item = held[~dense], item[~dense]
    order = np.argsort(held, kind="stable")
    start = np.searchsorted(held[order], np.arange(vocabulary + 2))
    return Holders(chosen, common, matrix, start, item[order])


def _held_weight(holders: Holders, place: np.ndarray, weight: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """(blocks, items): the squared weights of a block's words that an item holds."""
    n, row = len(holders.items), holders.common[place]
    dense = row >= 0
    width = len(holders.matrix)
    sums = np.bincount(block[dense] * width + row[dense], weight[dense], blocks * width)
    out = sums.reshape(blocks, width).astype(np.float32) @ holders.matrix
    count = holders.start[place + 1] - holders.start[place]
    some = np.flatnonzero(count)
    count, begin = count[some], holders.start[place[some]]
    entry = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    key = np.repeat(block[some] * n, count) + holders.listed[entry]
    out += np.bincount(key, np.repeat(weight[some], count), blocks * n).reshape(blocks, n)
    return out


def prepare(ids: list, column: pa.Array, space: Space) -> Items | None:
    """Items in the latent space, with the words that they hold."""
    found = texts.words(column, "alnum")
    spans = texts.row_spans(found.row, len(column))
    kept = [i for i in range(len(column)) if spans[i + 1] - spans[i] >= LEAST_WORDS]
    if not kept:
        return None
    hashes = [found.hash[spans[i] : spans[i + 1]] for i in kept]
    term = _terms(found)
    vocabulary = np.unique(np.concatenate(hashes))
    words = [np.searchsorted(vocabulary, w) for w in hashes]
    vectors, segments, pieces = [], [], []
    for k, i in enumerate(kept):
        cut = np.array_split(np.arange(len(words[k])), -(-len(words[k]) // SEGMENT))
        segments.append(list(range(len(vectors), len(vectors) + len(cut))))
        vectors += [space.fold[term[spans[i] + piece]].sum(0) for piece in cut]
        pieces += [words[k][piece] for piece in cut]
    heavy = np.array([(space.weight[term[spans[i] : spans[i + 1]]] ** 2).sum() for i in kept])
    unit = _unit(np.array(vectors)).astype(np.float32)
    length = np.array([len(w) for w in words])
    every, short = (_holders(words, chosen, len(vocabulary)) for chosen in (np.arange(len(words)), np.flatnonzero(length < SHORT)))
    return Items([ids[i] for i in kept], words, unit, segments, pieces, vocabulary, every, short, length, heavy, _item_runs(hashes))


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which :func:`_run` reads the fingerprint of any run of words."""
    up, down = texts.powers(1 << max(16, len(hashes).bit_length()))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return total, down


def _run(total: np.ndarray, down: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return (total[at + size] - total[at]) * down[at]


def _item_runs(hashes: list[np.ndarray]) -> Runs:
    first, heads, by_length = np.zeros(1, np.int64), [], {}
    for i, own in enumerate(hashes):
        total, down = _sums(own)
        heads.append(_run(total, down, first, LEAST_WORDS)[0])
        by_length.setdefault(len(own), []).append((_run(total, down, first, len(own))[0], i))
    heads = np.unique(np.array(heads, np.uint64))
    likely = np.zeros(1 << 16, bool)
    likely[heads >> np.uint64(48)] = True
    whole = {n: (np.array([k for k, _ in sorted(own)], np.uint64), np.array([i for _, i in sorted(own)])) for n, own in by_length.items()}
    return Runs(heads, likely, whole)


def _verbatim(found: texts.Words, spans: np.ndarray, place: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(row, item, first word) of the places where an item stands word for word."""
    heads, likely, whole = items.runs
    n = len(found.hash) - LEAST_WORDS + 1
    if n <= 0:
        return
    total, down = _sums(found.hash)
    value = (total[LEAST_WORDS:] - total[:n]) * down[:n]
    at = np.flatnonzero(likely[value >> np.uint64(48)])
    value = value[at]
    at = at[heads[np.minimum(np.searchsorted(heads, value), len(heads) - 1)] == value]
    for size, (keys, numbers) in whole.items() if len(at) else ():
        begin = at[at + size <= spans[found.row[at] + 1]]
        value = _run(total, down, begin, size)
        low, high = np.searchsorted(keys, value), np.searchsorted(keys, value, side="right")
        some = high > low
        for p, a, b in zip(begin[some].tolist(), low[some].tolist(), high[some].tolist()):
            for i in numbers[a:b].tolist():
                if np.array_equal(place[p : p + size], items.words[i]):
                    yield int(found.row[p]), i, p


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one row of the table held as bits of an integer."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text.tolist():
        if match := row & places.get(w, 0):
            row = ((row + match) | (row - match)) & full
    return len(item) - row.bit_count()


def answer_of(item: np.ndarray) -> np.ndarray:
    return item[-max(3, len(item) // 4) :]


def _holds_run(text: np.ndarray, run: np.ndarray) -> bool:
    n = len(text) - len(run) + 1
    if n <= 0:
        return False
    at = np.flatnonzero(text[:n] == run[0])
    for k in range(1, len(run)):
        at = at[text[at + k] == run[k]]
    return len(at) > 0


def _windows(items: Items, found: texts.Words, spans: np.ndarray, place: np.ndarray, weight: np.ndarray) -> Iterator[tuple]:
    """(first word, end, item) of the windows that hold enough of an item's weight, by width and in parts of bounded size.

    What a window holds of an item is counted exactly, word by word, from the lists of the items that hold a word, so the
    latent vectors are formed for these windows only.
    """
    for width in WINDOWS:
        holders = items.short if width < WINDOWS[1] else items.all
        if not len(holders.items):
            continue
        step = width // 2
        starts = _block_starts(found, len(spans) - 1, step)
        stops = np.r_[starts[1:], len(found.row)]
        row = found.row[starts]
        goes_on = np.r_[row[1:] == row[:-1], False]
        least = (SHARED * items.weight * np.minimum(1.0, width / items.length))[holders.items].astype(np.float32) * np.float32(0.9999)
        at_once = max(1, DENSE // len(holders.items))
        for lo in range(0, len(starts), at_once):
            hi = min(len(starts), lo + at_once)
            end = min(len(starts), hi + 1)  # the last window's second block
            own = slice(starts[lo], stops[end - 1])
            block = np.repeat(np.arange(end - lo), stops[lo:end] - starts[lo:end])
            held = _held_weight(holders, place[own], weight[own], block, end - lo)
            known = held[: hi - lo].copy()
            more = np.flatnonzero(goes_on[lo:hi])
            known[more] += held[more + 1]
            window, item = np.divmod(np.flatnonzero(known >= least), len(least))
            if len(window):
                window = window + lo
                last = np.where(goes_on[window], stops[np.minimum(window + 1, len(stops) - 1)], stops[window])
                yield width, starts[window], last, holders.items[item]


def search_column(column: pa.Array, space: Space, items: Items) -> list[tuple[int, int, float, int, bool, int]]:
    """(row, item, cosine, common words, answer found, first word) of the items that texts hold."""
    found = texts.words(column, "alnum")
    if not len(found.row):
        return []
    spans = texts.row_spans(found.row, len(column))
    term = _terms(found)
    none = len(items.vocabulary)
    place = np.minimum(np.searchsorted(items.vocabulary, found.hash), none - 1)
    place[items.vocabulary[place] != found.hash] = none
    weight = space.weight[term] ** 2
    best: dict[tuple[int, int], tuple] = {}
    mark = np.zeros(none + 1, bool)
    for width, first, stop, item in _windows(items, found, spans, place, weight):
        begin, which = np.unique(first, return_inverse=True)
        end = np.zeros(len(begin), np.int64)
        end[which] = stop
        order = np.argsort(begin - end, kind="stable")  # longest first: those with a k-th word are the first n
        begin, size = begin[order], (end - begin)[order]
        which = np.argsort(order)[which]
        vector = np.zeros((len(begin), RANK), np.float32)
        for k in range(width):
            n = int(np.searchsorted(-size, -k))
            vector[:n] += space.fold[term[begin[:n] + k]]
        vector = _unit(vector)
        for at, last, i, v in zip(first.tolist(), stop.tolist(), item.tolist(), which.tolist()):
            near = items.vectors[items.segments[i]] @ vector[v]
            c = float(near.max())
            if c < (COSINE_SHORT if width < WINDOWS[1] else COSINE):
                continue
            r, own = int(found.row[at]), items.words[i]
            around = place[max(int(spans[r]), at - len(own)) : min(int(spans[r + 1]), last + len(own))]
            mark[around] = True
            present = int(mark[own].sum())
            mark[around] = False
            if present < PARTLY * len(own) and len(items.segments[i]) == 1:
                continue  # the subsequence is no longer than the words that are there at all
            mark[own] = True
            known = around[mark[around]]
            mark[own] = False
            common = common_subsequence(own, known)
            answer = common >= PARTLY * len(own) and _holds_run(around, answer_of(own))
            if common < FULL * len(own) and not answer and not _holds_segment(items, i, near, known):
                continue
            entry = (common, c, answer, at - int(spans[r]))
            best[r, i] = max(best.get((r, i), entry), entry)
    for r, i, at in _verbatim(found, spans, place, items):
        best.setdefault((r, i), (int(items.length[i]), 1.0, True, at - int(spans[r])))
    return [(r, i, c, common, answer, at) for (r, i), (common, c, answer, at) in sorted(best.items())]


def _holds_segment(items: Items, item: int, near: np.ndarray, around: np.ndarray) -> bool:
    """Whether a text covers ``FULL`` of a segment of a long item that is near."""
    pieces = [items.pieces[s] for s, c in zip(items.segments[item], near) if c >= COSINE]
    return len(items.segments[item]) > 1 and any(common_subsequence(p, around) >= FULL * len(p) for p in pieces)


def _item_groups(benchmark: DataFrame) -> Iterator[tuple[list, pa.Array]]:
    """The distinct texts of the benchmark with their digests, in groups of bounded size."""
    rows = benchmark.select("text").filter("text is not null").distinct().withColumn("item_key", F.sha2("text", 256))
    groups = max(1, -(-rows.count() // (ITEMS_AT_ONCE // 2)))
    for g in range(groups):
        own = rows.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).orderBy("item_key").collect()
        if own:
            yield [r["item_key"] for r in own], pa.array([r["text"] for r in own], pa.string())


def find(documents: DataFrame, benchmark: DataFrame, space: Space | None = None) -> DataFrame:
    """One row for each document and item that it holds; each text of the benchmark is searched once, however many items have it."""
    workers_import(documents.sparkSession)
    space = space or fit(documents)
    schema = "doc_id long, item_key string, cosine double, common_words int, item_words int, answer_found boolean, near_word long"
    base, result = documents.select(F.col("doc_id").cast("long"), "text"), None
    for keys, column in _item_groups(benchmark):
        if items := prepare(keys, column, space):
            part = map_arrow(base, _finder(space, items), schema)
            result = part if result is None else result.union(part)
    if result is None:
        result = documents.sparkSession.createDataFrame([], schema)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.sha2("text", 256).alias("item_key"))
    return result.join(named, "item_key").select("doc_id", "item_id", "cosine", "common_words", "item_words", "answer_found", "near_word")


def _finder(space: Space, items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch, limit=SLICE):
                hits = search_column(part.column(1), space, items)
                columns = [
                    part.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([items.ids[h[1]] for h in hits], pa.string()),
                    pa.array([float(h[2]) for h in hits], pa.float64()),
                    pa.array([h[3] for h in hits], pa.int32()),
                    pa.array([int(items.length[h[1]]) for h in hits], pa.int32()),
                    pa.array([h[4] for h in hits], pa.bool_()),
                    pa.array([h[5] for h in hits], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_key", "cosine", "common_words", "item_words", "answer_found", "near_word"])

    return run


def without_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark; rows are filtered in place, without a shuffle."""
    workers_import(documents.sparkSession)
    space = fit(documents)
    for ids, column in _item_groups(benchmark):
        items = prepare(ids, column, space)
        if items is None:
            continue

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in texts.slices(batch, limit=SLICE):
                    clean = np.ones(part.num_rows, bool)
                    at = part.schema.get_field_index("text")
                    clean[[h[0] for h in search_column(part.column(at), space, items)]] = False
                    yield part.filter(pa.array(clean))

        documents = map_arrow(documents, run, documents.schema)
    return documents
