"""The search of benchmark items against all windows and all items in plain Python."""

import math
import random
import re

import helpers as h
import numpy as np
import pyarrow as pa
import pytest

from tickerloom.llm import latent, texts

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def space(seed=1):
    rng = np.random.default_rng(seed)
    weight = rng.uniform(0.5, 6, latent.BUCKETS)
    fold = (weight[:, None] * rng.standard_normal((latent.BUCKETS, latent.RANK))).astype(np.float32)
    return latent.Space(fold, np.ones(latent.RANK), weight)


def term_of(word):
    return int(latent._terms(texts.words(pa.array([word]), "alnum"))[0])


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(row[k], last[k + 1]))
    return row[-1]


def stands_in(run, words):
    return any(words[k : k + len(run)] == run for k in range(len(words) - len(run) + 1))


def brute(documents, items, of):
    terms = {w: term_of(w) for t in (*documents, *items) for w in re.findall(ALNUM, h.lower(t or ""))}
    fold = lambda words: np.sum([of.fold[terms[w]] for w in words], axis=0, dtype=np.float64)
    cosine = lambda a, b: float(a @ b) / math.sqrt(float(a @ a) * float(b @ b))
    found = set()
    for r, text in enumerate(documents):
        words = re.findall(ALNUM, h.lower(text or ""))
        for i, item in enumerate(items):
            own = re.findall(ALNUM, h.lower(item))
            if len(own) < latent.LEAST_WORDS:
                continue
            if stands_in(own, words):
                found.add((r, i))
                continue
            mass = sum(of.weight[terms[w]] ** 2 for w in own)
            pieces = [p.tolist() for p in np.array_split(np.array(own), -(-len(own) // latent.SEGMENT))]
            for width in latent.WINDOWS if len(own) < latent.SHORT else latent.WINDOWS[1:]:
                for at in range(0, len(words), width // 2):
                    window = words[at : at + width]
                    held = sum(of.weight[terms[w]] ** 2 for w in window if w in own)
                    if held < latent.SHARED * mass * min(1, width / len(own)):
                        continue
                    near = [cosine(fold(window), fold(p)) for p in pieces]
                    if max(near) < (latent.COSINE_SHORT if width < latent.WINDOWS[1] else latent.COSINE):
                        continue
                    around = words[max(0, at - len(own)) : at + len(window) + len(own)]
                    common, answer = subsequence(own, around), own[-max(3, len(own) // 4) :]
                    by_piece = len(pieces) > 1 and any(
                        c >= latent.COSINE and subsequence(p, around) >= latent.FULL * len(p) for c, p in zip(near, pieces)
                    )
                    if common >= latent.FULL * len(own) or common >= latent.PARTLY * len(own) and stands_in(answer, around) or by_piece:
                        found.add((r, i))
    return found


def changed(words, share, rng):
    return [f"other{rng.randrange(99)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("dense", [1 << 20, 40])
def test_search_equals_all_windows_and_items(monkeypatch, dense):
    monkeypatch.setattr(latent, "DENSE", dense)
    rng, of = random.Random(3), space()
    items = [h.prose(50 + k, n, width=60) for k, n in enumerate([4, 5, 8, 14, 15, 16, 30, 47, 49, 130, 8])]
    documents = [None, "", "one", *items]
    for item in items:
        for share in (0, 0.1, 0.2, 0.3, 0.45):
            body = h.prose(rng.randrange(999), rng.randrange(10, 90), width=60).split()
            at = rng.randrange(len(body))
            documents.append(" ".join([*body[:at], *changed(item.split(), share, rng), *body[at:]]))
    segment = items[9].split()[:44]
    documents.append(h.prose(7, 100) + " " + " ".join(segment) + " " + h.prose(8, 100))
    prepared = latent.prepare(list(range(len(items))), pa.array(items), of)
    found = {(r, prepared.ids[i]) for r, i, *_ in latent.search_column(pa.array(documents), of, prepared)}
    expected = brute(documents, items, of)
    assert found == expected and len(expected) > 30 and (len(documents) - 1, 9) in expected


def test_a_repeated_item_is_searched_once_and_named_each_time(spark):
    text = h.prose(2, 20)
    benchmark = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, None)], "item_id long, text string")
    found = latent.find(h.documents(spark, [h.prose(1, 50) + " " + text, h.prose(4, 60)]), benchmark, space())
    assert sorted((r["doc_id"], repr(r["item_id"])) for r in found.collect()) == [(0, "1"), (0, "1"), (0, "2"), (0, "None")]
    assert [len(keys) for keys, _ in latent._item_groups(benchmark)] == [1]
