"""Fixtures and brute-force versions shared by the tests of this folder."""

from __future__ import annotations

import random
import re

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names the operators use themselves
CLASH = ", row string, size string, node long, component string, digest string, kept string, text_ string"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def split(text: str | None) -> list[str]:
    return re.findall(WORD, lower(text or ""))


def prose(seed: int, n: int, width: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}w{rng.randrange(width)}" for _ in range(n))


def edge_texts() -> list[str | None]:
    """Null, empty, blank, one word, accents, repeated rows, near copies, and a very long text without blanks."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    return [
        None, "", " \t\n", "one", "UPPER lower Ünïcödé ß", "a b c d", "a b c d", base, base, near, base.upper(),
        "x" * 50_000, prose(2, 8_000), base + " " + prose(3, 100), prose(4, 30) + "\n" + base, "MIT License", "\x00\x01",
    ]


def documents(spark, texts, clash: bool = False, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, ("en", "de", None)[k % 3], (None, "a", "b")[k % 3], len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts))]
    if clash:
        return spark.createDataFrame([(*r, "r", "s", 1, "c", "d", "k", "t") for r in rows], SCHEMA + CLASH)
    return spark.createDataFrame(rows, SCHEMA)


def with_null_id(spark, texts):
    return documents(spark, texts, ids=[None if k == 7 else k for k in range(len(texts))])


def rows(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def shingle_set(text: str | None) -> frozenset:
    words = split(text)
    if len(words) >= 5:
        return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute_classes(pairs) -> dict:
    """doc_id -> (n_shingles, component, kept) for (doc_id, text) pairs, comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in pairs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for i in sorted(sets):
        seen = set()
        for s in sets[i]:
            seen.update(holders.get(s, ()))
            holders.setdefault(s, []).append(i)
        for j in seen:
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
