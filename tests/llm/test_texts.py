import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import helpers as h
from hypothesis import given, settings
from hypothesis import strategies as st

from tickerloom.llm import texts as T

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB z9\t\n.é-ß　", max_size=30)), max_size=8), st.sampled_from([4, 16, 1 << 20]))
def test_words_equal_regular_expressions(column, piece):
    array = pa.array(column, pa.string())
    for kind, pattern in (("space", h.WORD), ("alnum", ALNUM)):
        found = T.words(array, kind, piece=piece)
        data, _ = T.buffers(array)
        got = [(int(r), h.lower(bytes(data[a:b]).decode())) for r, a, b in zip(found.row, found.start, found.end)]
        assert got == [(i, w) for i, t in enumerate(column) for w in re.findall(pattern, h.lower(t or ""))]


def test_equal_words_have_equal_hashes_anywhere():
    array = pa.array(["Word other word", None, "x word", "WORD"])
    found = T.words(array)
    named = {}
    for r, a, b, v in zip(found.row, found.start, found.end, found.hash):
        named.setdefault(bytes(T.buffers(array)[0][a:b]).lower(), set()).add(int(v))
    assert all(len(v) == 1 for v in named.values()) and len({next(iter(v)) for v in named.values()}) == 3


def test_shingle_counts_equal_sets():
    texts = h.edge_texts()
    array = pa.array(texts, pa.string())
    row, value = T.shingles(T.words(array), len(texts))
    assert np.diff(T.row_spans(row, len(texts))).tolist() == [len(h.shingle_set(t)) for t in texts]


@pytest.mark.parametrize("limit", [1, 100, 1 << 30])
def test_slices_keep_every_row(limit):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(h.edge_texts(), pa.string())})
    parts = [r for s in T.slices(batch, limit=limit) for r in s.column(0).to_pylist()]
    assert parts == h.edge_texts()


def test_words_take_little_memory_besides_their_columns():
    column = pa.array([" ".join("x" * 1000 for _ in range(1000))])
    T.words(column)  # the powers are kept from here on
    tracemalloc.start()
    found = T.words(column)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(found.hash) == 1000 and most < 10 * T.SLICE_BYTES
