"""Toxicity: a convolutional text classifier in numpy.

A word is embedded as the sum of three hashed embeddings (the word, its first four and its first five
bytes), whose first component starts from the word's association with the labels and all of which are
learned; filters of widths 1, 2 and 3 slide over the whole text, each is max-pooled, and a logistic layer
gives the score. The network is trained in numpy on a sample of labelled rows of documented bounds
(``max_rows`` rows and ``max_bytes`` of text, drawn by hash whatever their length); a calibration part of the sample fits the score's scale and one
threshold per language. Scoring reads every whole text, in one pass without a shuffle.

Defined results: a null or empty text has the score of a text without features; a null ``doc_id`` is not
held out; repeated rows score alike; without labels of both kinds every score is the labels' mean (0
without labels), so an empty table of labels gives 0 and one of documents no rows. Very long texts are scored whole.
Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm import texts
from tickerloom.llm.tables import map_arrow, settle

BUCKETS, WIDTH_OF, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PREFIXES = (4, 5)
PAD = max(WIDTHS) - 1
THRESHOLD = 0.3


class Model(NamedTuple):
    embedding: np.ndarray | None
    kernels: tuple
    biases: tuple
    out: np.ndarray
    scale: float
    shift: float
    thresholds: dict


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, lengths): three bucket ids for each word, each text followed by padding words."""
    found = texts.words(column, "alnum")
    data, _ = texts.buffers(column)
    rows, n = len(column), len(found.hash)
    spans = texts.row_spans(found.row, rows)
    length = np.diff(spans)
    ids = np.zeros((1 + len(PREFIXES), n + rows * PAD), np.int32)
    at = np.arange(n) + found.row * PAD
    ids[0, at] = (found.hash >> np.uint64(48)).astype(np.int64) % (BUCKETS - 1) + 1
    values, size = texts.byte_values(True), found.end - found.start
    for k, width in enumerate(PREFIXES, 1):
        total = np.zeros(n, np.uint64)
        whole = size >= width
        for j in range(width):
            total[whole] = total[whole] * texts._M1 + values[data[found.start[whole] + j]]
        ids[k, at[whole]] = (texts.mix(total[whole] + np.uint64(width)) >> np.uint64(48)).astype(np.int64) % (BUCKETS - 1) + 1
    return ids, spans[:-1] + np.arange(rows) * PAD, length


def _sample_features(column: pa.Array, rows: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`features` of a sample, a few rows at a time and in 16 bits, so that the driver holds little more than the ids."""
    parts, starts, lengths, begin = [], [], [], 0
    for at in range(0, len(column), rows):
        ids, start, length = features(column.slice(at, rows))
        parts.append(ids.astype(np.uint16))
        starts.append(start + begin)
        lengths.append(length)
        begin += ids.shape[1]
    return np.concatenate(parts, axis=1), np.concatenate(starts), np.concatenate(lengths)


def _stretches(ids: np.ndarray, size: int = 1 << 15) -> Iterator[np.ndarray]:
    """Views of the ids, a stretch of words each: an index as wide as the sample would be several times its size."""
    for at in range(0, ids.shape[1], size):
        yield ids[:, at : at + size]


def _embed(embedding: np.ndarray, ids: np.ndarray) -> np.ndarray:
    total = embedding[ids[0]]
    for k in range(1, len(ids)):
        total += embedding[ids[k]]
    return total


def _windows(x: np.ndarray, width: int) -> np.ndarray:
    """Row i holds the words i .. i+width-1 side by side."""
    if width == 1:
        return x
    padded = np.concatenate([x, np.zeros((width - 1, x.shape[1]), x.dtype)])
    return np.concatenate([padded[k : k + len(x)] for k in range(width)], axis=1)


def _pool(z: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Largest value of each filter in each text; 0 where a text has no words."""
    out = np.zeros((len(start), z.shape[1]), z.dtype)
    some = length > 0
    if some.any():
        cuts = np.stack([start[some], start[some] + length[some]], 1).ravel()
        tail = cuts[:-1] if cuts[-1] >= len(z) else cuts
        out[some] = np.maximum.reduceat(z, tail, axis=0)[0::2]
    return np.maximum(out, 0)


def logits(model: Model, column: pa.Array) -> np.ndarray:
    ids, start, length = features(column)
    x = _embed(model.embedding, ids)
    pooled = [
        _pool(_windows(x, w) @ k + b, start, length) for w, k, b in zip(WIDTHS, model.kernels, model.biases)
    ]
    h = np.concatenate([*pooled, np.ones((len(start), 1), np.float32)], axis=1)
    return (h @ model.out).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(column: pa.Array, label: np.ndarray, lang: list, epochs: int = 6, least_steps: int = 200, seed: int = 5) -> Model:
    """Fit the network by Adam on minibatches; every fifth row is kept for calibration.

    Small samples are gone over more often, until ``least_steps`` batches were seen.
    """
    rng = np.random.default_rng(seed)
    n = len(label)
    if n == 0 or label.min() == label.max():
        mean = float(label.mean()) if n else 0.0
        return Model(None, (), (), np.zeros(0), 0.0, mean, {})
    holdout = np.arange(n) % 5 == 4
    if label[holdout].min(initial=1) == label[holdout].max(initial=0):
        holdout[:] = False
    ids, start, length = _sample_features(column)
    held, toxic = _held_by(ids, start, length, label, ~holdout)
    for part in _stretches(ids):
        part[held[part] <= 1] = 0  # a word of one text only could do nothing but memorise it
    f = len(WIDTHS) * FILTERS
    p = {"e": (rng.standard_normal((BUCKETS, WIDTH_OF)) * 0.1).astype(np.float32)}
    mean = label[~holdout].mean()
    p["e"][:, 0] = (toxic - held * mean) / np.sqrt(held * mean * (1 - mean) + 4)
    p["e"][0] = 0
    for w in WIDTHS:
        p[f"k{w}"] = (rng.standard_normal((w * WIDTH_OF, FILTERS)) / np.sqrt(w * WIDTH_OF)).astype(np.float32)
        p[f"k{w}"][::WIDTH_OF] = np.abs(p[f"k{w}"][::WIDTH_OF])
        p[f"b{w}"] = np.zeros(FILTERS, np.float32)
    p["o"] = (rng.standard_normal(f + 1) * 0.1).astype(np.float32)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    rows, step = np.flatnonzero(~holdout), 0
    for _ in range(max(epochs, -(-least_steps // -(-len(rows) // 64)))):
        rng.shuffle(rows)
        for at in range(0, len(rows), 64):
            step += 1
            gradient = _gradient(p, ids, start, length, label, np.sort(rows[at : at + 64]))
            for k, g in gradient.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = 0.01 / (1 - 0.9**step)
                p[k] -= rate * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            p["e"][0] = 0
    unused = np.ones(BUCKETS, bool)
    for part in _stretches(ids):
        unused[part] = False
    p["e"][unused] = 0
    model = Model(p["e"], tuple(p[f"k{w}"] for w in WIDTHS), tuple(p[f"b{w}"] for w in WIDTHS), p["o"], 1.0, 0.0, {})
    score = np.concatenate([logits(model, column.slice(i, 256)) for i in range(0, n, 256)])
    part = holdout if holdout.any() else np.ones(n, bool)
    scale, shift = _platt(score[part], label[part])
    model = model._replace(scale=scale, shift=shift)
    return model._replace(thresholds=_by_language(_sigmoid(scale * score + shift), label, lang, part))


def _held_by(ids: np.ndarray, start: np.ndarray, length: np.ndarray, label: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of ``part`` hold each id, and how many toxic ones."""
    held, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in np.flatnonzero(part):
        own = np.unique(ids[:, start[i] : start[i] + length[i]])
        held[own] += 1
        toxic[own] += label[i]
    return held, toxic


def _gradient(p: dict, ids: np.ndarray, start: np.ndarray, length: np.ndarray, label: np.ndarray, rows: np.ndarray) -> dict:
    where = np.concatenate([np.arange(start[r], start[r] + length[r] + PAD) for r in rows])
    own = length[rows]
    begin = np.cumsum(np.r_[0, own + PAD])[:-1]
    batch = ids[:, where]
    x = _embed(p["e"], batch)
    grown, pooled, kept = {}, [], []
    for w in WIDTHS:
        z = _windows(x, w) @ p[f"k{w}"] + p[f"b{w}"]
        top = _pool(z, begin, own)
        place = np.zeros(top.shape, np.int64)
        for i, (s, m) in enumerate(zip(begin, own)):
            if m:
                place[i] = s + z[s : s + m].argmax(0)
        pooled.append(top)
        kept.append(place)
    h = np.concatenate([*pooled, np.ones((len(rows), 1), np.float32)], axis=1)
    error = ((_sigmoid(h @ p["o"]) - label[rows]) / len(rows)).astype(np.float32)
    grown["o"] = h.T @ error + 1e-5 * p["o"]
    back = error[:, None] * p["o"][None, :-1]
    total = np.zeros_like(x)
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS] * (pooled[i] > 0)
        grown[f"b{w}"] = g.sum(0)
        kernel, padded = np.zeros_like(p[f"k{w}"]), np.concatenate([x, np.zeros((w, x.shape[1]), x.dtype)])
        for j in range(FILTERS):
            at = kept[i][:, j]
            for k in range(w):
                part = slice(k * WIDTH_OF, (k + 1) * WIDTH_OF)
                kernel[part, j] += padded[at + k].T @ g[:, j]
                inside = at + k < len(x)
                np.add.at(total, at[inside] + k, g[inside, j][:, None] * p[f"k{w}"][part, j][None, :])
        grown[f"k{w}"] = kernel
    used = np.flatnonzero(np.abs(total).sum(1))
    grown["e"] = np.zeros_like(p["e"])
    for row in batch:
        np.add.at(grown["e"], row[used], total[used])
    return grown


def _platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift by Newton steps, with smoothed targets so that it stays finite."""
    pos = label.sum()
    goal = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (len(label) - pos + 2))
    spread = score.std() or 1.0
    a, b = 1.0 / spread, -score.mean() / spread
    for _ in range(50):
        q = _sigmoid(a * score + b)
        g = np.array([((q - goal) * score).sum() + 1e-6 * a, (q - goal).sum()])
        w = q * (1 - q) + 1e-9
        h = np.array([[(w * score * score).sum() + 1e-6, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


def _by_language(score: np.ndarray, label: np.ndarray, lang: list, part: np.ndarray, least: int = 20) -> dict:
    """For a language with enough toxic calibration rows the threshold of the best F1, else none."""
    out = {}
    lang = np.array([x if x is not None else "" for x in lang])
    for name in sorted(set(lang[part])):
        own = part & (lang == name)
        if label[own].sum() < least or label[own].min() == 1:
            continue
        s, y = score[own], label[own]
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(len(s)) + 1 + y.sum())
        best = int(f1.argmax())
        below = s[order][best + 1] if best + 1 < len(s) else 0.0
        out[name] = float((s[order][best] + below) / 2)
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Labelled texts that are not held out, drawn by hash until ``max_rows`` or ``max_bytes``; the same in every run.

    Texts of any length are drawn alike. A text that repeats under one doc_id is one row, whose labels count as toxic if any is.
    """
    usable = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
    )
    mark = F.xxhash64("doc_id", "text").alias("mark")
    present = documents.filter("text is not null").select("doc_id", mark, F.octet_length("text").cast("long").alias("bytes"))
    found = present.join(usable, "doc_id").groupBy("doc_id", "mark").agg(F.max("toxic").alias("toxic"), F.max("bytes").alias("bytes"))
    found = settle(found.withColumn("draw", F.xxhash64("mark", "doc_id").bitwiseAND((1 << 40) - 1)), "toxicity-labelled")
    total = found.count()
    if total > max_rows:
        found = found.filter(F.col("draw") < int((1 << 40) * min(1.0, 1.1 * max_rows / total + 1e-4)))
    first = found.orderBy("draw", "doc_id").limit(max_rows)
    taken = F.sum("bytes").over(Window.orderBy("draw", "doc_id", "mark"))  # over max_rows rows
    chosen = first.withColumn("taken", taken).filter(F.col("taken") <= max_bytes).select("doc_id", "mark", "toxic")
    texts_of = documents.select("doc_id", "text", "lang", mark).join(F.broadcast(chosen), ["doc_id", "mark"])  # bounded by max_rows
    return texts_of.groupBy("doc_id", "mark").agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.max("toxic").alias("toxic")).drop("mark")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 16 << 20) -> Model:
    sample = labelled_sample(documents, labels, max_rows, max_bytes).select("doc_id", "text", "lang", "toxic").toArrow().combine_chunks()
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    text = sample.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    label, lang = sample.column("toxic").to_numpy().astype(np.float32), sample.column("lang").to_pylist()
    del sample
    model = train(text, label, lang)
    del text
    pa.default_memory_pool().release_unused()
    return model


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    if model.embedding is None:
        return np.full(len(column), model.shift)
    return _sigmoid(model.scale * logits(model, column) + model.shift)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                value = _scores(model, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(value)], ["doc_id", "lang", "score"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text", "lang"), run, "doc_id long, lang string, score double")


def not_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with a score below the threshold of their language, ``THRESHOLD`` where none was calibrated;
    rows are filtered in place, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.slices(batch):
                column = part.column(part.schema.get_field_index("text"))
                lang = part.column(part.schema.get_field_index("lang")).to_pylist()
                limit = np.array([model.thresholds.get(x if x is not None else "", THRESHOLD) for x in lang])
                yield part.filter(pa.array(_scores(model, column) < limit))

    return map_arrow(documents, run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """One row per document: held_out, score, predicted, and the language's own threshold and verdict."""
    model = fit(documents, labels, **bounds)
    own = F.lit(THRESHOLD)
    for lang, value in model.thresholds.items():
        own = F.when(F.coalesce(F.col("lang"), F.lit("")) == lang, F.lit(value)).otherwise(own)
    return score(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        own.alias("lang_threshold"),
        (F.col("score") >= own).alias("toxic_in_language"),
    )
