"""Token counts by separator scan over flat token files.

``write_flat`` tokenises documents with a public byte-pair vocabulary and appends their ids, each document
followed by the end-of-document id, to flat files of 16-bit integers without any index. ``count`` reads such
files in blocks of ``BLOCK_TOKENS``, finds the separators of a block by one vectorised comparison, and
stitches blocks together by a prefix scan: for each block of a file the number of separators before it and
the place of the last one. A document's count is the distance between its separators, however many blocks
it spans. The documents' order in each file is kept in a table of its own, which gives counts their ids.

Files are written through the file system that the shared folder's address names, under a name that no
other attempt uses; only files that a finished task reports are read.

Defined results: null and empty texts have 0 tokens; repeated rows and null ids give rows of their own; other
columns are ignored; an empty table gives no files and no rows; tokens after a file's last separator belong
to no document.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.llm.tables import map_arrow, settle, shared_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50_256  # free in this vocabulary
BLOCK_TOKENS = 1 << 20
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _open(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def write_flat(documents: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Write flat files below ``folder``; gives doc_id, file and the document's number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, store, sink, name, number = encoder(vocabulary), None, None, "", 0
        for batch in batches:
            if sink is None and batch.num_rows:
                name = f"{folder}/{uuid.uuid4().hex}.bin"
                store, path = _open(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(path)
            for text in batch.column(1):
                ids = encode.encode_ordinary(text.as_py() or "")
                sink.write(np.array([*ids, separator], "<u2").tobytes())
            order = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows), pa.array(order)], ["doc_id", "file", "number"])
        if sink is not None:
            sink.close()

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, file string, number long")


def count(spark: SparkSession, files: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, number, first_token and n_tokens of every document in the files (a column ``file``)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = _open(name)
                n = -(-(store.get_file_info(path).size // 2) // block_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n))], ["file", "block"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _open(name)
                with store.open_input_file(path) as source:
                    source.seek(2 * block * block_tokens)
                    ids = np.frombuffer(source.read(2 * block_tokens), "<u2")
                ends = np.flatnonzero(ids == separator).astype(np.int64) + block * block_tokens
                last = int(ends[-1]) if len(ends) else None
                columns = [pa.array([name]), pa.array([block]), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([ends], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "separators", "last", "ends"])

    listed = map_arrow(files.select("file").distinct(), blocks, "file string, block long").repartition("file", "block")
    found = map_arrow(listed, scan, "file string, block long, separators long, last long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    thin = found.select("file", "block", "ends", F.coalesce(F.sum("separators").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    begins = F.transform(F.concat(F.array("previous"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda x: x + 1)
    return thin.select("file", "base", F.posexplode(F.arrays_zip(begins.alias("begin"), F.col("ends").alias("end"))).alias("at", "s")).select(
        "file", (F.col("base") + F.col("at")).alias("number"), F.col("s.begin").alias("first_token"), (F.col("s.end") - F.col("s.begin")).alias("n_tokens")
    ).filter("n_tokens is not null")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row, with the place of its tokens in the flat files."""
    spark = documents.sparkSession
    order = settle(write_flat(documents, shared_path(spark, "tokens"), vocabulary), "token-order")
    # file names compress so well that Spark would take the counts for small: both sides grow with the corpus
    return order.hint("merge").join(count(spark, order), ["file", "number"]).select("doc_id", "n_tokens", "file", "number", "first_token")
