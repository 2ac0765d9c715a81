"""Importance weights and the convolutional network against plain Python."""

import math

import helpers as h
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickerloom.llm import quality, texts, toxicity

WORDS = {
    "alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
    "signs": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+",
}


def fingerprint(word, kind="alnum"):
    return int(texts.words(pa.array([word]), kind).hash[0])


def mixed(value):
    return int(texts.mix(np.array([value % (1 << 64)], np.uint64))[0])


def n_grams(text):
    """Buckets of words, neighbouring pairs of words and runs of signs."""
    import re

    text = h.lower(text or "")
    words = [fingerprint(w) for w in re.findall(WORDS["alnum"], text)]
    pairs = [mixed(a * int(texts._M2) + b) for a, b in zip(words, words[1:])]
    signs = [mixed(fingerprint(s, "signs") + 1) for s in re.findall(WORDS["signs"], text)]
    return [(v >> 50) % quality.BUCKETS for v in (*words, *pairs, *signs)]


def test_importance_weights_and_keys_equal_plain_python(spark):
    bodies = h.edge_texts()[:8] + [h.prose(k, 12, width=30) + (" !!! ?" if k % 2 else "") for k in range(40)]
    marks = [(k, k % 2, 0) for k in range(8, 48)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = quality.resample(h.documents(spark, bodies, clash=True), labels, keep=0.5).collect()
    grams = [n_grams(t) for t in bodies]
    target, raw = [0] * quality.BUCKETS, [0] * quality.BUCKETS
    good = {k for k, q, _ in marks if q}
    for k, own in enumerate(grams):
        for b in own:
            raw[b] += 1
            target[b] += k in good
    size = lambda counts: sum(counts) + quality.SMOOTHING * quality.BUCKETS
    weight = {}
    for k, own in enumerate(grams):
        ratios = [math.log((target[b] + quality.SMOOTHING) / size(target)) - math.log((raw[b] + quality.SMOOTHING) / size(raw)) for b in own]
        weight[k] = sum(ratios) / max(1, len(ratios))
    draw = {r["id"]: r["u"] & ((1 << 52) - 1) for r in spark.range(len(bodies)).select("id", F.xxhash64("id", F.lit("gumbel")).alias("u")).collect()}
    key = {k: weight[k] * quality.SHARPNESS - math.log(-math.log((draw[k] + 0.5) / (1 << 52))) for k in weight}
    last = sorted(key.values(), reverse=True)[math.ceil(0.5 * len(bodies)) - 1]
    for r in found:
        k = r["doc_id"]
        assert r["n_grams"] == len(grams[k]) and math.isclose(r["log_ratio"], weight[k], abs_tol=1e-9)
        assert math.isclose(r["key"], key[k], abs_tol=1e-7) and r["kept"] == (key[k] >= last - 1e-9)


def word_ids(word):
    """The three buckets of a word: itself, its first four and its first five bytes."""
    own = (fingerprint(word) >> 48) % (toxicity.BUCKETS - 1) + 1
    values, data, out = texts.byte_values(True), word.encode(), [own]
    for width in toxicity.PREFIXES:
        total = 0
        if len(data) >= width:
            for byte in data[:width]:
                total = (total * int(texts._M1) + int(values[byte])) % (1 << 64)
        out.append((mixed(total + width) >> 48) % (toxicity.BUCKETS - 1) + 1)
    return out


def plain_logit(model, text):
    import re

    words = re.findall(WORDS["alnum"], h.lower(text or ""))
    vectors = [sum(model.embedding[i].astype(float) for i in word_ids(w)) for w in words]
    zero = np.zeros(toxicity.WIDTH_OF)
    pooled = []
    for width, kernel, bias in zip(toxicity.WIDTHS, model.kernels, model.biases):
        for j in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(words)):
                window = np.concatenate([vectors[at + k] if at + k < len(words) else zero for k in range(width)])
                best = max(best, float(window @ kernel[:, j].astype(float)) + float(bias[j]))
            pooled.append(best)
    return float(np.array([*pooled, 1.0]) @ model.out.astype(float))


def test_the_network_equals_plain_python():
    bodies = [f"{h.prose(k, 8 + k % 9, width=20)} {'awful hateful' if k % 3 == 0 else 'kind words'}" for k in range(120)]
    label = np.array([k % 3 == 0 for k in range(120)], np.float32)
    model = toxicity.train(pa.array(bodies), label, ["en"] * 120, least_steps=40)
    asked = [None, "", " ", "one", "Awful", "Ünïcödé ß wörd", *bodies[:12], h.prose(3, 300)]
    found = toxicity.logits(model, pa.array(asked))
    assert np.allclose(found, [plain_logit(model, t) for t in asked], atol=1e-3)
    scores = toxicity._scores(model, pa.array(bodies))
    assert scores[label == 1].min() > scores[label == 0].max()
