"""Each operator against a brute-force version on edge rows: nulls, empty and very long texts, repeated rows, clashing columns."""

import base64
import hashlib
import random
import re

import helpers as h
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import archive, doubling, latent, licenses, mixing, neardup, quality, suffixes, tables, tokens, topk, toxicity

EMPTY_LABELS = "doc_id long, quality int, toxic int"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def labels(spark, rows):
    return spark.createDataFrame(rows, EMPTY_LABELS)


# ---- mixing


def brute_targets(sizes):
    """source -> target, by resharing the excess in rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_mixing(spark, clash):
    texts = h.edge_texts() + [h.prose(100 + k, 5 + k % 90) for k in range(400)]
    found = mixing.mix(h.documents(spark, texts, clash)).collect()
    assert len(found) == len(texts)
    sizes, taken, target = {}, {}, {}
    for r in found:
        assert r["size"] == len(re.findall(h.WORD, texts[r["doc_id"]] or ""))
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s], rel=1e-6)
        assert abs(taken[s] - target[s]) <= 10
    again = mixing.mix(h.documents(spark, texts, clash).repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mixing_cuts_large_sources_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 20)
    texts = [h.prose(k, 5 + k % 50) for k in range(300)]
    found = mixing.mix(h.documents(spark, texts)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.03 * r["target"] for r in found)


def test_mixing_without_words_or_rows(spark):
    assert [r["taken"] for r in mixing.mix(h.documents(spark, [None, "", " "])).collect()] == [0, 0, 0]
    assert mixing.mix(h.documents(spark, [])).count() == 0


# ---- archive


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string, header string")


PAGES = [
    (1, "http://a", "<p>same</p>"), (7, "http://b", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://d\r\nX: y", None), (5, "u", ""),
    (6, "u", "ünïcödé\r\n\r\nWARC-Type: response\r\n"), (9, "u", "z" * 300_000), (10, "u", "tie"), (10, "u", "tie"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    found = h.rows(
        archive.round_trip(pages(spark, [(*p, "x", "y", "z") for p in PAGES]), least),
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
    )
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        keeper = max(j for j, _, other in PAGES if (other or "").encode() == data)
        own = i == keeper or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((i, len(data), digest, "response" if own else "revisit", None if own else keeper))
    assert found == sorted(expected, key=repr)


def test_archive_null_ids_and_empty_table(spark):
    rows = [(None, "u", "p"), (2, "u", "p"), (None, "u", "q")]
    found = archive.round_trip(pages(spark, [(*r, "", "", "") for r in rows])).collect()
    assert sorted((repr(r["page_id"]), r["record_type"], repr(r["refers_to"])) for r in found) == [
        ("2", "response", "None"), ("None", "response", "None"), ("None", "revisit", "2"),
    ]
    assert archive.round_trip(pages(spark, [])).count() == 0


def test_archive_stores_a_payload_once_and_fails_on_damage(spark, tmp_path):
    path = archive.write(pages(spark, [(*p, "", "", "") for p in PAGES]), str(tmp_path / "a"))
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({p[2] or "" for p in PAGES})
    full = {r["page_id"]: bytes(r["payload"]).decode() for r in archive.read(spark, path).collect()}
    assert full == {i: html or "" for i, _, html in PAGES}
    archive.export(spark, path, str(tmp_path / "warc"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    assert written.count(b"WARC/1.1\r\n") == len(PAGES) and b"<p>same</p>\r\n\r\n" in written
    damaged = str(tmp_path / "b")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{damaged}/headers")
    stored.withColumn("payload", F.when(F.octet_length("payload") == 11, F.lit(b"<p>sane</p>")).otherwise(F.col("payload"))).write.parquet(f"{damaged}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        archive.read(spark, damaged).collect()


# ---- near duplicates


def near_copies(n, words, seed):
    rng = random.Random(seed)
    base = h.prose(seed, words).split()
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(1, max(2, words // 18))):
            own[rng.randrange(words)] = f"edit{k}x{rng.randrange(999)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_near_duplicates(spark, clash, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)  # so that clusters are cut into bands and blocks
    texts = h.edge_texts() + near_copies(60, 90, 5) + near_copies(25, 200, 6) + near_copies(12, 30, 7) + [h.prose(k + 50, 60) for k in range(20)]
    texts += [f"{h.prose(900, 40)} {h.prose(k + 800, 25 + k)}" for k in range(25)]  # one passage, different surroundings
    found = neardup.near_duplicates(h.documents(spark, texts, clash)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == h.brute_classes(list(enumerate(texts)))
    assert len(found) == len(texts)


def test_a_large_group_of_copies_moves_few_texts(spark):
    n = 20_000
    member = spark.range(n + 300).selectExpr("id as node", "100 + id % 7 as n_shingles", "900L as bytes")
    star = spark.range(1, n).selectExpr("id as a", "0L as b")
    assert neardup.beside_heads(member, star).count() < 2 * n
    # one class of n members and 300 single ones in one cluster: the large class is not compared with itself
    placed = neardup.place(member.selectExpr("*", f"if(node < {n}, 0L, node) as known", "0L as cluster"))
    assert placed.selectExpr("sum(size(places))").first()[0] < 8 * n
    assert placed.filter(f"node < {n}").selectExpr("max(size(places))").first()[0] <= 4


def test_clusters_of_several_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 6)
    base = h.prose(5, 90).split()
    steps = [" ".join([f"s{k}x{j}" for j in range(3 * k)] + base[3 * k :]) for k in range(16)]  # a chain of near copies
    texts = [*steps, *near_copies(40, 90, 5), *near_copies(25, 60, 6), *h.edge_texts()]
    random.Random(4).shuffle(texts)
    found = neardup.near_duplicates(h.documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == h.brute_classes(enumerate(texts))


def test_near_duplicates_repeated_ids_null_ids_and_no_rows(spark):
    text = h.prose(1, 50)
    frame = h.documents(spark, [text, text, text + " tail", "alone", "", None], ids=[3, 3, None, None, None, 8])
    found = neardup.near_duplicates(frame).collect()
    assert sorted(((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"]) for r in found)) == sorted(
        [("3", 46, "3", True), ("3", 46, "3", True), ("None", 47, "3", False), ("None", 1, "None", True), ("None", 0, "None", True), ("8", 0, "8", True)]
    )
    assert neardup.near_duplicates(h.documents(spark, [])).count() == 0
    kept = neardup.one_of_each(frame).collect()
    assert sorted(repr(r["text"]) for r in kept) == sorted(map(repr, [text, "alone", "", None]))


# ---- suffixes


def brute_removal(texts, window=suffixes.WINDOW):
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for b in data:
        for p in range(len(b) - window + 1):
            seen[b[p : p + window]] = seen.get(b[p : p + window], 0) + 1
    out = []
    for b in data:
        keep = [True] * len(b)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                keep[p : p + window] = [False] * window
        kept = bytes(c for c, k in zip(b, keep) if k)
        spans = sum(not keep[p] and (p == 0 or keep[p - 1]) for p in range(len(b)))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def repeating_texts():
    a, b = h.prose(11, 80), h.prose(12, 60)
    texts = h.edge_texts() + [a + b, b + " " + a, a[:199], a[:199], a[5:205], "é" * 150, "é" * 99, "ab" * 300, "q" * 200, "q" * 201, "q" * 199]
    rng = random.Random(3)
    for k in range(40):  # cuts at any byte, surroundings of any length, all inside one passage
        i, n = rng.randrange(len(a) - 260), rng.randrange(150, 260)
        texts.append(h.prose(200 + k, rng.randrange(1, 40)) + a[i : i + n] + h.prose(300 + k, rng.randrange(1, 40)))
    return [t[:9000] if t is not None else None for t in texts]


@pytest.mark.parametrize("clash", [False, True])
def test_repeats(spark, clash):
    texts = repeating_texts()
    found = suffixes.removal_report(h.documents(spark, texts, clash)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    expected = brute_removal(texts)
    assert got == {i: e[:4] for i, e in enumerate(expected)}
    cut = suffixes.without_repeats(h.documents(spark, texts, clash)).select("row.doc_id", "row.text", "removed").collect()
    for r in cut:
        e = expected[r["doc_id"]]
        assert r["removed"] == e[1] and (r["text"] or "") == e[4].decode("utf-8", "ignore")


@pytest.mark.parametrize("window, base", [(suffixes.WINDOW, doubling.BASE), (50, 25), (30, 8), (7, 25)])
def test_plain_doubling_ranks_the_repeated_windows(spark, window, base):
    texts = [(t or "")[:1500] if t is not None else None for t in repeating_texts()]
    frame = spark.createDataFrame(list(enumerate(texts)), "tid int, text string").selectExpr("*", "'c' as rank", "1 as pos", "2 as head")
    found = {(r["tid"], r["pos"]): r["rank"] for r in doubling.repeated_positions(frame, window, base).collect()}
    places: dict = {}
    for tid, text in enumerate(texts):
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            places.setdefault(b[p : p + window], []).append((tid, p))
    repeated = [own for own in places.values() if len(own) > 1]
    assert set(found) == {x for own in repeated for x in own}
    ranks = [{found[x] for x in own} for own in repeated]
    assert all(len(r) == 1 for r in ranks) and len(set.union(*ranks)) == len(ranks)
    assert doubling.repeated_positions(frame.limit(0), window, base).count() == 0


def test_sampled_positions_remove_what_plain_doubling_finds(spark, sf):
    documents = tables.read_table(spark, sf, "documents")
    found = doubling.repeated_positions(documents.withColumnRenamed("doc_id", "tid"))
    covered = {}
    for r in found.collect():
        covered.setdefault(r["tid"], set()).update(range(r["pos"], r["pos"] + suffixes.WINDOW))
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.removal_report(documents).collect()}
    assert got == {i: len(covered.get(i, ())) for i in got} and covered


def test_repeats_across_pieces_repeated_ids_and_no_rows(spark, monkeypatch):
    a = h.prose(21, 400)
    texts = [h.prose(22, 300) + a, a[100:1500] + h.prose(23, 300), a[:250], a[:250], "short"]
    expected = sorted(e[:4] for e in brute_removal(texts))
    for piece in (512, 700, 1 << 21):
        column = pa.array(texts)
        monkeypatch.setattr(suffixes, "PIECE", piece)
        found = suffixes.anchors(column)
        lengths = {r: sorted(zip(found.low[found.row == r], found.high[found.row == r])) for r in set(found.row.tolist())}
        for r, windows in lengths.items():  # every window belongs to exactly one anchor
            assert sum(b - a + 1 for a, b in windows) == len(texts[r].encode()) - suffixes.WINDOW + 1
    got = suffixes.removal_report(h.documents(spark, texts, ids=[1, 1, None, None, 2])).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expected
    assert suffixes.removal_report(h.documents(spark, [])).count() == 0


# ---- toxicity


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(1)
    texts, marks = [], []
    for k in range(600):
        words = h.prose(k, rng.randrange(5, 80)).split()
        toxic = k % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "grubling", "grubster", "grubmo"]))
        texts.append(" ".join(words))
        marks.append((k, int(not toxic), int(toxic)))
    found = toxicity.classify(h.documents(spark, texts, clash=True), labels(spark, marks)).collect()
    held = [r for r in found if r["held_out"]]
    assert 100 < len(held) < 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97


def test_toxicity_edges(spark):
    texts = h.edge_texts()
    marks = [(k, 1, k % 2) for k in range(len(texts))] + [(2, 1, 1), (None, 0, 1), (5, None, None), (999, 0, 1)]
    found = toxicity.classify(h.with_null_id(spark, texts), labels(spark, marks)).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    same = {r["score"] for r in found if r["doc_id"] in (0, 1, 2)}
    assert len(same) == 1 and [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert {r["score"] for r in toxicity.classify(h.documents(spark, texts), labels(spark, [])).collect()} == {0.0}
    assert toxicity.classify(h.documents(spark, []), labels(spark, marks)).count() == 0


def test_stage_decides_by_the_threshold_of_the_language(spark):
    texts = [h.prose(k, 5 + k % 40) + (" vile" if k % 4 == 0 else "") for k in range(400)] + [None, ""]
    docs = h.documents(spark, texts, clash=True)
    model = toxicity.fit(docs, labels(spark, [(k, 1, int(k % 4 == 0)) for k in range(400)]))
    scores = {r["doc_id"]: (r["lang"], r["score"]) for r in toxicity.score(docs, model).collect()}
    middle = float(np.median([s for _, s in scores.values()]))
    for own in ({}, {"en": 2.0}, {"en": middle, "de": 0.0}, {"": 2.0, "de": middle}):
        kept = {r["doc_id"] for r in toxicity.not_toxic(docs, model._replace(thresholds=own)).collect()}
        assert kept == {i for i, (lang, s) in scores.items() if s < own.get(lang or "", 0.3)}


# ---- licenses


def test_licenses(spark):
    texts = h.edge_texts() + [
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.", "licensed under the gnu public license",
        "mit. LICENSE mit\nlicense general public public license", "Licensed under CC BY-NC 4.0.", "xmit license",
        "SPDX-License-Identifier: MIT", "licensed under the GNU Lesser General Public License or any later version",
    ]
    found = {r["doc_id"]: r for r in licenses.scan(h.documents(spark, texts, clash=True)).collect()}
    for i, text in enumerate(texts):
        words = re.findall(ALNUM, h.lower(text or ""))
        places, names = [], set()
        for phrase, label in licenses.PHRASES.items():
            own = phrase.split()
            hits = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            places += hits
            names |= {label} if hits else set()
        r = found[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(names)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert names <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    n = len(h.edge_texts())
    assert [found[n + k]["labels"] for k in range(8)] == [
        "apache,apache-2.0-notice,mit,mit-notice", "gpl,gpl-notice", "", "mit", "cc-by-nc-notice", "", "spdx-tag", "gpl,gpl-notice",
    ]
    assert found[n]["score"] == 1.0


def test_license_automaton():
    made = licenses.compile_template("t", "a b [c [d] e] {1-2} f")
    for text, size in (("a b x f", 4), ("a b c e x f", 6), ("a b c d e x y f", 8), ("a b f", 0), ("a b c d x f", 0), ("a b c x y z f", 0), ("a b c e f f", 6)):
        assert licenses.longest_match(made, text.split()) == size
    for bad in ("[a] b", "a b [c"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", bad)
    assert licenses.scan_column(pa.array([], pa.string()), licenses.PHRASES, licenses.TEMPLATES)["labels"] == []


# ---- decontamination


def test_decontamination(spark):
    items = [(k, h.prose(k + 500, 14 + 5 * k)) for k in range(12)] + [(90, None), (91, ""), (92, "too few words"), (3, h.prose(503, 29))]
    rng, texts, expected = random.Random(2), list(h.edge_texts()), set()
    for k in range(60):
        words = h.prose(k, rng.randrange(20, 300)).split()
        item = k % 12
        own = items[item][1].split()
        if k % 3 == 0:  # whole
            expected.add((len(texts), item))
        elif k % 3 == 1:  # a paraphrase: every eighth word changed, answer kept
            own = [w if j % 8 != 3 or j > 0.7 * len(own) else f"new{j}" for j, w in enumerate(own)]
            expected.add((len(texts), item))
        else:  # a third of it only
            own = own[: len(own) // 3]
        at = rng.randrange(len(words))
        texts.append(" ".join(words[:at] + own + words[at:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = latent.find(h.documents(spark, texts, clash=True), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    clean = latent.without_items(h.documents(spark, texts, clash=True), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert latent.find(h.documents(spark, []), bench).count() == 0
    assert latent.find(h.documents(spark, texts), bench.filter("false")).count() == 0


def test_short_items_word_for_word(spark):
    """Items of 5 to 13 words inside longer documents, and the same with one of nine or more words changed."""
    rng, texts, items, expected = random.Random(6), [], [], set()
    for k in range(270):
        size = 5 + k % 9
        own, words = h.prose(20_000 + k, size).split(), h.prose(30_000 + k, rng.randrange(60, 160)).split()
        items.append((k, " ".join(own)))
        if k % 2 and size > 8:
            own[2] = "changed"
        at = rng.randrange(len(words))
        expected.add((k, k))
        texts.append(" ".join(words[:at] + own + words[at:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in latent.find(h.documents(spark, texts), bench).collect()}
    whole = {(k, k) for k in range(270) if not (k % 2 and 5 + k % 9 > 8)}
    assert whole <= set(found) and all(found[p]["common_words"] == found[p]["item_words"] for p in whole)
    assert set(found) <= expected and len(set(found) - whole) > 0.95 * len(expected - whole)
    assert latent.without_items(h.documents(spark, texts), bench).filter(~(F.col("doc_id") % 2 == 1)).count() == 0


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert latent.common_subsequence(np.array(a), np.array(b)) == table[-1][-1]


# ---- tokens


def test_token_counts(spark):
    texts = h.edge_texts()
    encode = tokens.encoder(tokens.VOCABULARY)
    found = h.rows(tokens.token_counts(h.documents(spark, texts, clash=True)), "doc_id", "n_tokens")
    assert found == sorted(((i, len(encode.encode_ordinary(t or ""))) for i, t in enumerate(texts)), key=repr)
    assert tokens.token_counts(h.documents(spark, [])).count() == 0


def test_separators_are_stitched_across_blocks(spark):
    rng, folder = random.Random(1), tables.shared_path(spark, "flat").removeprefix("file://")
    import os

    os.makedirs(folder)
    files, expected = [], []
    for f in range(3):
        lengths = [rng.choice([0, 0, 1, 5, 40, 200]) for _ in range(30)]
        flat = [x for n in lengths for x in [*(rng.randrange(50_000) for _ in range(n)), tokens.SEPARATOR]] + [7] * f
        name = f"{folder}/{f}.bin"
        np.array(flat, "<u2").tofile(name)
        files.append((name,))
        expected += [(name, k, n) for k, n in enumerate(lengths)]
    for block in (1, 7, 64, 1 << 20):
        found = tokens.count(spark, spark.createDataFrame(files, "file string"), block_tokens=block)
        assert h.rows(found, "file", "number", "n_tokens") == sorted(expected, key=repr)


# ---- top-k


def brute_top(vectors, k):
    out = []
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in sorted(ok):
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(-2, 2)).astype(np.float32).tolist()) for i in range(0, 1000, 5)]
    vectors += [(1001 + k, [0.5] * 6) for k in range(30)] + [(1100, [0.5] * 6), (1200, [0.0] * 6), (1300, [1.0, 2.0]), (1301, [3.0, 1.0]), (1400, [])]
    vectors += [(2000, None), (2001, [1.0, None] + [1.0] * 4), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [9.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, norm string")
    found = topk.top_k(frame, F.col("vec_id") % 100 == 0, 10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == brute_top(vectors, 10)


def test_top_k_without_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, F.col("vec_id") % 100 == 0, 10).count() == 0


def test_survivors_never_lose_a_result():
    rng = np.random.default_rng(8)
    for _ in range(200):
        vectors = (rng.standard_normal((60, 5)) * rng.choice([1, 3, 100])).round().astype(np.int64) + 1
        norms = np.sqrt((vectors**2).sum(1).astype(float))
        order = np.argsort(-norms)
        vectors, norms = vectors[order], norms[order]
        query = rng.integers(-50, 50, 5)
        scores = vectors @ query
        floor = float(np.sort(scores)[-8])
        kept = topk.survivors(query, float(np.sqrt((query**2).sum())), floor, vectors, norms)
        assert set(np.flatnonzero(scores >= floor)) <= set(kept.tolist())


# ---- quality


def test_importance_resampling(spark):
    good = [h.prose(k, 80, width=40) for k in range(300)]
    junk = [" ".join(f"{w}$$$ |" for w in h.prose(k, 60).split()) for k in range(100)]
    texts = [*good, *junk, *h.edge_texts()]
    marks = [(k, int(k < 300), 0) for k in range(0, 400, 2)]
    assert quality.good_share(labels(spark, marks)) == 0.75 and quality.good_share(labels(spark, [])) == quality.KEEP
    found = quality.resample(h.documents(spark, texts, clash=True), labels(spark, marks), keep=0.8).collect()
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert len(found) == len(texts) and len(kept) == int(np.ceil(0.8 * len(texts)))
    assert sum(k < 300 for k in kept) >= 295 and sum(300 <= k < 400 for k in kept) <= 45
    ratio = {r["doc_id"]: r["log_ratio"] for r in found}
    assert min(ratio[k] for k in range(300)) > max(ratio[k] for k in range(300, 400)) and ratio[400] == 0.0


def test_importance_resampling_edges(spark):
    texts = h.edge_texts()
    found = quality.resample(h.with_null_id(spark, texts), labels(spark, [])).collect()
    assert all(r["log_ratio"] == 0 for r in found) and len(found) == len(texts)
    assert quality.resample(h.documents(spark, []), labels(spark, [])).count() == 0


def test_kth_highest(spark):
    rng = random.Random(9)
    values = [rng.choice([rng.random(), 0.5, -1e9, 1e9]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 77, 400, 500):
        assert quality.kth_highest(frame, "v", k, ranges=7) == sorted(values, reverse=True)[k - 1]
