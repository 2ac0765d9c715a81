"""Fill-in-the-middle, Merkle manifests and SimHash classes against brute-force versions."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import helpers as h
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickerloom.llm import infill, merkle, pivots
from tickerloom.llm.queries import QUERIES


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle

UNIT = {"word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "point": r"(?s)."}
SIGNED = ["<P>", "has <S> inside", "ends <M>", "<", "> <P", "é<", "日本 語 text  \n", "ab\u0085cd", "𝔘𝔫𝔦 code 𝔭𝔬𝔦𝔫𝔱𝔰 ß end\t"]


def brute_infill(doc_id, text, unit="word"):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    n, digest = len(units), sha("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, one), (one, two), (two, n)))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["word", "point"])
@pytest.mark.parametrize("clash", [False, True])
def test_infill(spark, unit, clash):
    texts = h.edge_texts() + SIGNED + [h.prose(k, k % 30) + ("  é\n" * (k % 3)) for k in range(150)]
    made = infill.fill_in_middle(h.documents(spark, texts, clash), unit)
    found = made.withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(tuple(r)[:6] for r in found) == [brute_infill(k, t, unit) for k, t in enumerate(texts)]
    assert all(r["restored"] == (texts[r["doc_id"]] or "") for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_infill_null_and_repeated_ids_and_no_rows(spark):
    texts = [h.prose(k, 20) for k in range(12)]
    ids = [None, None, *[5] * 4, *range(6, 12)]
    found = infill.fill_in_middle(h.documents(spark, texts, ids=ids)).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(repr(brute_infill(i, t)) for i, t in zip(ids, texts))
    assert infill.fill_in_middle(h.documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="unit"):
        infill.fill_in_middle(h.documents(spark, []), "line")


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aé日𝔘 \n", max_size=40))
def test_exceptions_convert_both_ways(text):
    index = infill.Exceptions.of(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in points])
    assert index.bytes(points).tolist() == places.tolist() and index.points(places).tolist() == points.tolist()
    assert len(index.byte) == sum(len(c.encode()) > 1 for c in text)


# ---- Merkle manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return sha("".join(field(row[name]) for name in merkle.FIELDS))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    out = []
    for nodes in tree[:-1]:
        first = at // 8 * 8
        out += [v for k, v in enumerate(nodes[first : first + 8], first) if k != at]
        at //= 8
    return out


def fold(tree, at, value):
    for nodes in tree[:-1]:
        first = at // 8 * 8
        value = sha("".join(value if k == at else v for k, v in enumerate(nodes[first : first + 8], first)))
        at //= 8
    return value


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: levels([v[2] for v in sorted(by_lang[name], key=lambda v: v[:3])]) for name in order}
    top, out = levels([trees[name][-1][0] for name in order]), []
    for place, name in enumerate(order):
        for at, (known, number, leaf, r) in enumerate(sorted(by_lang[name], key=lambda v: v[:3])):
            other = r
            if known and zlib.crc32(str(number).encode()) % 3 == 0 and r["text"] is not None:
                other = {**r, "text": h.lower(r["text"])}
            proof = siblings(trees[name], at) + siblings(top, place)
            folded = fold(top, place, fold(trees[name], at, leaf_of(other)))
            out.append((r["doc_id"], leaf, trees[name][-1][0], top[-1][0], "".join(proof), folded))
    return sorted(out, key=repr)


def found_manifest(proofs):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"].hex(), r["folded_root"]) for r in proofs.collect()), key=repr)


def plain(frame):
    return [r.asDict() for r in frame.select(*merkle.FIELDS).collect()]


@pytest.mark.parametrize("clash", [False, True])
def test_manifest(spark, clash):
    texts = h.edge_texts() + [f"Text {k}" for k in range(3 * 65)]
    frame = h.documents(spark, texts, clash)
    proofs = merkle.prove(merkle.build(frame, claim=merkle.tampered()))
    assert found_manifest(proofs) == brute_manifest(plain(frame))
    verified = {r["doc_id"]: r["verified"] for r in proofs.collect()}
    changed = {k for k, t in enumerate(texts) if t is not None and zlib.crc32(str(k).encode()) % 3 == 0 and h.lower(t) != t}
    assert changed and {k for k, ok in verified.items() if not ok} == changed


@pytest.mark.parametrize("sizes", [(1,), (1, 8, 9, 64, 65), (4097, 1), (513,) * 9])
def test_manifest_of_trees_of_many_sizes(spark, sizes):
    langs = [f"l{k}" if k else None for k, n in enumerate(sizes) for _ in range(n)]
    rows = [(i, "T", lang, None, 1) for i, lang in enumerate(langs)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, h.SCHEMA)
    frame = frame.select("doc_id", "text", "lang", "source", "n_chars")
    assert found_manifest(merkle.prove(merkle.build(frame, claim=merkle.tampered()))) == brute_manifest(plain(frame))


def test_manifest_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "A", "x", "s", 1), (None, "B", "x", None, None), *[(7, "same", "x", "s", 4)] * 30, (7, "Other", "x", "s", 5), (1, None, None, None, None)]
    frame = spark.createDataFrame(rows, h.SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    assert found_manifest(merkle.prove(merkle.build(frame, claim=merkle.tampered()))) == brute_manifest(plain(frame))
    nothing = merkle.build(h.documents(spark, []))
    assert nothing.root is None and merkle.prove(nothing).count() == 0


def test_proofs_of_chosen_leaves_fetch_only_what_is_missing(spark):
    frame = spark.createDataFrame([(i, "T", "x" if i % 5 else "y", None, 1) for i in range(5000)], h.SCHEMA)
    frame = frame.select("doc_id", "text", "lang", "source", "n_chars")
    manifest = merkle.build(frame)
    chosen = {3, 4, 9, 250, 4999}
    proofs = merkle.prove(manifest, F.col("doc_id").isin(*chosen))
    expected = [r[:5] + (r[3],) for r in brute_manifest(plain(frame)) if r[0] in chosen]
    assert found_manifest(proofs) == expected and all(r["verified"] for r in proofs.collect())
    lacking = merkle.Manifest(manifest.leaves, manifest.nodes.filter("level <> 1"), manifest.roots, manifest.root, manifest.parts)
    with pytest.raises(Exception, match="lacks the node"):
        merkle.prove(lacking, F.col("doc_id").isin(*chosen)).collect()


def test_missing_coordinates():
    assert [(level, idx.tolist()) for level, idx in merkle.missing(np.arange(8), 8)] == [(0, [])]
    assert [(level, idx.tolist()) for level, idx in merkle.missing(np.array([1, 9]), 20)] == [(0, [0, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15]), (1, [2])]
    assert merkle.missing(np.array([0]), 1) == []


# ---- SimHash


def brute_fingerprint(text):
    words = h.split(text)
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(values, radius=4):
    """Index of the first of the component of each of the distinct values."""
    found = list(range(len(values)))

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = root(i), root(j)
            found[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def partition_of(values, labels):
    groups = {}
    for v, label in zip(values, labels):
        groups.setdefault(label, set()).add(v)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def linked_sets(values, pairs):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return partition_of(values, [root(v) for v in values])


def scattered(seed, groups=12, members=30, most=6):
    """Fingerprints in groups around centres, some pairs within the radius, chains among them."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(members):
            out.add(centre)
            turned = centre
            for bit in rng.sample(range(64), rng.randrange(1, most)):
                turned ^= 1 << bit
            out.add(turned)
            if rng.random() < 0.1:
                centre = turned
    return sorted(out)


def copies(n):
    rng, out = random.Random(8), []
    for k in range(n):
        words = h.prose(900 + k % 9, 150 + k % 9).split()
        if k >= 9:
            words[rng.randrange(len(words))] = f"changed{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_simhash_classes(spark, clash):
    texts = h.edge_texts() + copies(60) + ["<a>", " two  WORDS", "two words", "é  É"]
    found = pivots.near_duplicates(h.documents(spark, texts, clash)).collect()
    values = [brute_fingerprint(t) for t in texts]
    assert {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in found} == dict(enumerate(values))
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(brute_components(values)))
    assert len({r["component_id"] for r in found}) < len(texts)


def test_simhash_null_and_repeated_ids_and_no_rows(spark):
    texts = [None, "", "one two three", "one two three", "alone it stands here", "other words are there too"]
    found = h.rows(pivots.near_duplicates(h.documents(spark, texts, ids=[4, 2, None, 9, None, 9])), "doc_id", "component_id")
    assert sorted(map(repr, found)) == sorted(map(repr, [(4, 2), (2, 2), (None, 9), (9, 9), (None, None), (9, 9)]))
    assert pivots.near_duplicates(h.documents(spark, [])).count() == 0


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(pivots, "PIECE", 7)
    texts = [h.prose(1, 100), None, "a", h.prose(2, 31), "x y z", ""]
    assert pivots.simhashes(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]
    assert len(pivots.simhashes(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("crowded", [4096, 8])
@pytest.mark.parametrize("agree", [1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowded, agree):
    monkeypatch.setattr(pivots, "CROWDED", crowded)
    values = scattered(agree)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = pivots.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), agree).collect()
    assert linked_sets(signed, [(r["a"], r["b"]) for r in found]) == partition_of(signed, brute_components(values))


def test_forest_and_stars_equal_all_pairs():
    for seed in range(6):
        values = scattered(seed, groups=5)
        expected = partition_of(values, brute_components(values))
        array = np.array(values, np.uint64)
        a, b = pivots.forest(array)
        assert len(a) < len(values) and linked_sets(values, zip(a.tolist(), b.tolist())) == expected
        a, b = pivots.stars(array, np.array([0, len(values)]))
        assert linked_sets(values, zip(a.tolist(), b.tolist())) == expected
    cut = np.array([0, 3, 3, 40, len(values)])
    a, b = pivots.stars(array, cut)
    place = {v: int(np.searchsorted(cut, k, side="right")) for k, v in enumerate(values)}
    assert all(place[x] == place[y] for x, y in zip(a.tolist(), b.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4), st.sampled_from([1, 2, 3, 4]))
def test_linked_fingerprints_share_a_key_and_differ_little_in_every_coordinate(value, bits, agree):
    pair = np.array([value, value ^ sum(1 << b for b in bits)], np.uint64)
    keys = pivots.family_keys(pair, pivots.RADIUS + agree, agree)
    assert (keys[0] == keys[1]).any()
    table = pivots.distances(pair, pivots.FAR).astype(int)
    assert np.abs(table[0] - table[1]).max() <= len(bits)


def test_registered_queries_cover_all_documents(spark, sf):
    for name in ("op11_sparse_exception_infill", "op12_octopus_manifest", "op13_pivot_simhash"):
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
