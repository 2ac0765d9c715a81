"""Groups that hold a third of all rows, and what is drawn, rounded or moved because of them."""

import time

import helpers as h
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import graph, mixing, neardup, tables, topk, toxicity

LABELS = "doc_id long, quality int, toxic int"


def brute_rounding(rows, rate_units, chunks):
    """Sorted (doc_id, size, copies) of one source's rows, rounded one by one in their chunks."""
    groups = {}
    for i, size in rows:
        groups.setdefault(((i or 0) % 1_000_003 * 7919 + size * 104_729) % chunks, []).append((i, size))
    out, (base, part) = [], divmod(rate_units, mixing.UNIT)
    for group in groups.values():
        behind = 0
        for i, size in sorted(group, key=lambda r: (-r[1], r[0] is None, r[0] or 0)):
            behind += part * size
            extra = size > 0 and part > 0 and 2 * behind >= mixing.UNIT * size
            behind -= mixing.UNIT * size * extra
            out.append((i, size, base + extra))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_rows", [4000, 60])
def test_mixing_where_one_id_holds_a_third(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk_rows)
    texts = [("w " * (k % 13)) for k in range(400)] + ["same size of five words"] * 500 + ["w " * (k % 40) for k in range(300)]
    ids = [None] * 400 + [7] * 500 + list(range(300))
    found = mixing.mix(h.documents(spark, texts, ids=ids)).collect()
    assert len(found) == len(texts)
    by_source = {}
    for k, (i, t) in enumerate(zip(ids, texts)):
        by_source.setdefault((None, "a", "b")[k % 3], []).append((i, len(t.split())))
    for source, rows in by_source.items():
        own = [r for r in found if r["source"] == source]
        rate = own[0]["target"] / own[0]["source_size"]
        expected = brute_rounding(rows, round(rate * mixing.UNIT), -(-len(rows) // chunk_rows))
        assert sorted(((r["doc_id"], r["size"], r["copies"]) for r in own), key=repr) == expected
        assert all(r["taken"] == r["copies"] * r["size"] for r in own)


def test_a_run_of_equal_documents_is_rounded_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    for _ in range(30):
        rows = [(int(i), int(s)) for i, s in zip(rng.integers(0, 9, 200), rng.integers(0, 6, 200))]
        units = int(rng.integers(0, 2 * mixing.UNIT + 1))
        import pandas as pd

        frame = pd.DataFrame(rows, columns=["doc_id", "size"]).groupby(["doc_id", "size"]).size().reset_index(name="times")
        frame = frame.assign(units=units, source="s", source_size=1, target=1.0)
        got = []
        for r in mixing._round(frame).itertuples():
            got += [(r.doc_id, r.size, r.base + 1)] * r.more + [(r.doc_id, r.size, r.base)] * (r.times - r.more)
        assert sorted(got, key=repr) == brute_rounding(rows, units, 1)


def test_labels_are_drawn_by_bytes_whatever_the_length(spark):
    held = {int(r[0]) for r in spark.range(600).filter(toxicity.held_out(F.col("id"))).collect()}
    usable = [k for k in range(600) if k not in held]
    hot = usable[0]
    texts = ["x" * 30_000 if k % 50 == 0 else h.prose(k, 20) for k in range(600)] + ["the same again"] * 300
    docs = h.documents(spark, texts, clash=True, ids=[*range(600), *[hot] * 300])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(700)] + [(hot, 1, 1)] * 50, LABELS)
    whole = toxicity.labelled_sample(docs, labels, 10_000, 1 << 30).collect()
    assert len(whole) == len(usable) + 1 and {r["doc_id"] for r in whole} == set(usable)
    assert sum(len(r["text"]) == 30_000 for r in whole) == sum(k % 50 == 0 for k in usable)
    few = toxicity.labelled_sample(docs, labels, 100, 1 << 30).collect()
    assert len(few) == 100 and sorted(map(tuple, few)) == sorted(map(tuple, toxicity.labelled_sample(docs, labels, 100, 1 << 30).collect()))
    small = toxicity.labelled_sample(docs, labels, 10_000, 50_000).collect()
    assert 0 < sum(len(r["text"]) for r in small) <= 50_000


def test_blocks_too_short_for_every_query_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    scale = np.r_[np.full(150, 1.0), np.full(1500, 0.01)]
    rows = [(k, [float(x) for x in rng.standard_normal(8) * s]) for k, s in enumerate(scale)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs = []
    whole = topk.useful_pairs
    monkeypatch.setattr(topk, "useful_pairs", lambda b, q: pairs.append((b.count(), whole(b, q).count())) or whole(b, q))
    found = topk.top_k(frame, F.col("vec_id") % 100 == 0, k=5).collect()
    vectors = np.floor(1024 * np.array([r[1] for r in rows])).astype(int)
    for q in range(0, 1650, 100):
        score = vectors @ vectors[q]
        best = sorted((k for k in range(1650) if k != q), key=lambda k: (-score[k], k))[:5]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == best
    assert pairs and pairs[0][1] < pairs[0][0] / 2


def test_written_steps_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set:
        return {name for k in range(disk.getAllFiles().size()) if (name := disk.getAllFiles().apply(k).getName()).endswith(".data")}

    before = shuffled()
    frame = spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    assert tables.settle(frame, "test-shuffles").agg(F.sum("n")).first()[0] == 50_000
    mine = spark.range(10).repartition(3, "id")
    assert mine.count() == 10 and frame.count() == 1000  # frames outside keep theirs, and may run again
    frames = [f"shuffle_{k}_" for k in {name.split("_")[1] for name in shuffled() - before}]
    end = time.time() + 20
    tables.settle(frame, "test-shuffles")
    while (left := {n for n in shuffled() - before if not n.startswith(tuple(frames))}) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(tables.SHUFFLES_GO, "false") == "false"


def test_rounds_of_components_build_no_tables_on_the_driver(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    edges = spark.createDataFrame(pairs, "a long, b long").filter("a > b")
    plan = graph._small_star(graph._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Union" not in plan
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a > b and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = {x for a, b in pairs if a > b for x in (a, b)}
    assert sorted(map(tuple, graph.components(edges).collect())) == sorted((x, root(x)) for x in nodes)


def test_settled_components_take_no_further_round(spark, monkeypatch):
    written = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda frame, name: written.append(name) or settle(frame, name))
    stars = spark.createDataFrame([(k, k % 3) for k in range(3, 40)], "a long, b long")
    assert sorted(map(tuple, graph.components(stars).collect())) == [(k, k % 3) for k in range(40)] and len(written) == 1
    for pairs, low in (([(2, 1), (1, 0)], {0: 0, 1: 0, 2: 0}), ([(2, 0), (2, 1)], {0: 0, 1: 0, 2: 0}), ([(5, 4), (4, 3), (8, 7)], {3: 3, 4: 3, 5: 3, 7: 7, 8: 7})):
        written.clear()
        assert dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long")).collect())) == low and len(written) > 1
    assert graph.components(stars.filter("a < 0")).count() == 0


def test_sample_is_held_in_16_bits():
    column = pa.array([*h.edge_texts(), *[f"word{k} other{k % 7}" for k in range(300)]], pa.string())
    ids, start, length = toxicity._sample_features(column)
    whole = toxicity.features(column)
    assert ids.dtype == np.uint16 and all(np.array_equal(a, b) for a, b in zip((ids, start, length), whole))
    parts = list(toxicity._stretches(ids, 100))
    assert all(np.shares_memory(p, ids) for p in parts) and np.array_equal(np.concatenate(parts, axis=1), ids)


def test_near_dedup_plans_no_step_many_times(spark, monkeypatch):
    joins, settle = {}, neardup.settle

    def counted(frame, name):
        joins[name] = frame._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString(), name
        return settle(frame, name)

    monkeypatch.setattr(neardup, "settle", counted)
    texts = [h.prose(k // 3, 60) + f" w{k} x{k}" for k in range(60)]
    kept = neardup.one_of_each(h.documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 60, 3))
    assert max(joins.values()) <= 4, joins
