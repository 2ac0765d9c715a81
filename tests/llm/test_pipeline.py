"""Stages of the pipeline against brute-force versions, each on its own input, and the registered contract."""

import corpus_pipeline
import helpers as h
import pytest

from tickerloom.llm import suffixes
from tickerloom.llm.oracle import ORACLES
from tickerloom.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """A folder of small tables with planted toxic documents, copies, repeats and benchmark items."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, h.prose(700 + k, 20 + k)) for k in range(6)]
    texts, plan = [], {"toxic": set(), "item": set(), "copies": []}
    for k in range(240):
        words = h.prose(k, 40 + k % 60).split()
        if k % 6 == 0:
            words[k % 30 : k % 30] = ["vile", "rotten", "vile"]
            plan["toxic"].add(k)
        if k % 10 == 3 and k % 6:
            words += items[k % len(items)][1].split()
            plan["item"].add(k)
        texts.append(" ".join(words))
    for k in (1, 7, 13):
        plan["copies"].append((k, len(texts), len(texts) + 1))
        near = texts[k].split()
        near[5] = "changed"
        texts += [texts[k], " ".join(near)]
    passage = h.prose(999, 60)
    texts += [h.prose(1000 + k, 90) + " " + passage + " " + h.prose(1100 + k, 90) for k in range(5)]
    texts += [None, "", "   ", texts[2].upper() + " tail"]
    h.documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(k, 1, int(k in plan["toxic"])) for k in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, plan


def test_stage_names_and_registration():
    import __spark_entry__ as contract

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing",
    ]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_stages_one_by_one(spark, inputs):
    folder, texts, plan = inputs
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, folder)
        if name == "mixing":
            rows = after.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            assert all(r["size"] == len(h.split(before[r["doc_id"]])) and r["taken"] <= 2 * r["size"] for r in rows)
            break
        assert after.columns == COLUMNS
        kept = {r["doc_id"]: r for r in after.collect()}
        gone = set(before) - set(kept)
        if name == "toxicity":
            assert gone == plan["toxic"]
        elif name == "minhash_near_dedup":
            classes = h.brute_classes(sorted(before.items()))
            assert gone == {i for i, (n, _, keep) in classes.items() if n and not keep}
        elif name == "suffix_array_dedup":
            removed = dict(zip(before, brute(list(before.values()))))
            for i, r in kept.items():
                assert (r["text"] or "") == removed[i] and (r["n_chars"] is None or r["n_chars"] == len(r["text"]))
            assert gone == {i for i, t in before.items() if t and t != removed[i] and not removed[i].strip()}
        else:
            holding = {i for i in plan["item"] if i in before}
            assert {i for i in holding if len(h.split(before[i])) > 60} <= gone | set()
            assert gone <= plan["item"]
        seen[name] = len(gone)
        path = f"{folder}/{name}.parquet"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
    assert all(seen[n] for n in ("toxicity", "minhash_near_dedup", "benchmark_decontamination"))


def brute(texts):
    """Texts without the bytes that a repeated string of the window's length covers."""
    window, data, count = suffixes.WINDOW, [(t or "").encode() for t in texts], {}
    for b in data:
        for p in range(len(b) - window + 1):
            count[b[p : p + window]] = count.get(b[p : p + window], 0) + 1
    out = []
    for b in data:
        keep = bytearray(b"\1") * len(b)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                keep[p : p + window] = bytes(window)
        out.append(bytes(c for c, k in zip(b, keep) if k).decode("utf-8", "ignore"))
    return out


def test_run_on_edge_tables(spark, tmp_path):
    for name, texts in (("empty", []), ("edges", h.edge_texts())):
        folder = str(tmp_path / name)
        h.documents(spark, texts, clash=True).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert {0, 1, 2} <= {r["doc_id"] for r in rows} if texts else rows == []
