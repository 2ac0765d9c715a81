"""Searches by an inverted index: terms in texts without a known company, and listings by the words of a name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.joins import salted_lookup
from tickerloom.session import shared_folder

GRAM = 3
PLACES = ("title", "description", "content")
SHORTER = (0, (1 << 24) + (1 << 16), 1 << 24, 0)  # where the numbers of runs of 1, 2 and 3 bytes begin
CODES = (1 << 24) + (1 << 16) + (1 << 8)  # runs there are at all, however many terms ask for them


def runs(texts: DataFrame, key: str, places: tuple[str, ...], wanted: np.ndarray | None = None, counted: bool = False) -> DataFrame:
    """(key, probe): the distinct runs of bytes of each row's texts, numbered from 1; no run spans two of the places.

    Runs of ``GRAM`` bytes, and shorter texts as they are; with ``wanted``, a bit for each number, only those that
    it names, of any length. ``counted`` gives (probe, n), how many rows hold a run, in part sums.
    """
    first, most, size, begins = GRAM, 1 << 20, CODES, SHORTER  # the task takes these by value: workers need no import of this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if wanted is None else np.unpackbits(wanted, bitorder="little")[:size].astype(bool)
        lengths = [n for n in range(1, first + 1) if asked is None or asked[begins[n] : begins[n] + (1 << 8 * n)].any()]
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for column in batch.columns[1:]:
                column = column.cast(pa.large_string())
                _, offsets, data = column.buffers()
                ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
                # long texts piece by piece: scratch memory does not follow the batch
                for at in range(int(ends[0]), int(ends[-1]), most):
                    for n in lengths:
                        piece = data[at : min(at + most + n - 1, int(ends[-1]))].astype(np.int32)
                        code = np.full(max(0, len(piece) - n + 1), begins[n], np.int32)
                        for k in range(n):
                            code += piece[k : k + len(code)] << 8 * (n - 1 - k)
                        hit = np.arange(len(code)) if asked is None else np.flatnonzero(asked[code])
                        row = np.searchsorted(ends, hit + at, side="right") - 1
                        inside = hit + at + n <= ends[row + 1]
                        if asked is None and n < first:
                            inside &= ends[row + 1] - ends[row] == n
                        found.append(np.unique(row[inside] * (1 << 25) + code[hit[inside]]))
            pairs = np.unique(np.concatenate(found))
            row, probe = pairs >> 25, (pairs & ((1 << 25) - 1)) + 1
            if counted:
                probe, n = np.unique(probe, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(n.astype(np.int64))], ["probe", "n"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(probe)], [key, "probe"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, *places).mapInArrow(run, "probe long, n long" if counted else f"{key} {kind}, probe long")


def named_bits(probes: DataFrame) -> np.ndarray:
    """A bit for each run, set where ``probes(probe)`` name it: 2 MB, however many there are."""
    bits = np.zeros(-(-CODES // 32768) * 4096, np.uint8)
    parts = probes.groupBy(F.bitmap_bucket_number("probe").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("probe")).alias("bits"))
    for part, own in parts.collect():
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(own), np.uint8)
    return bits


def rarest_key(own: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """Per owner the one of its keys (``own``, as ``probe``) that ``counts(probe, n)`` has the least for (ties by the key); if that is none: dropped."""
    ranked = own.join(counts, "probe", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy(*keep).agg(F.min(F.struct("n", "probe")).alias("best"))
    return best.filter("best.n > 0").select(*keep, "best.probe")


def mentions(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (article, term) where the lower-cased title, description or content holds the term, with the places.

    ``articles`` need no symbol and ``terms(term)`` are distinct. A term is indexed under its rarest run of three bytes (all of a
    shorter one), counted over all articles. Only runs that a term has are taken out of the articles, by a table of
    bits of fixed size; articles and terms meet by an equi-join on such a run, spread by salt where many articles have
    it, and only those pairs are searched. The index is written, as both passes over the articles need it.
    """
    spark = articles.sparkSession
    lowered = articles.select("doc_id", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in PLACES])
    own = runs(terms.filter("term <> ''").select("term", F.col("term").alias("text")), "term", ("text",))
    counts = runs(lowered, "doc_id", PLACES, named_bits(own), counted=True).groupBy("probe").agg(F.sum("n").alias("n"))
    path = shared_folder(spark, "term-index")
    rarest_key(own, counts, ["term"]).write.parquet(path)
    index = spark.read.schema("term string, probe long").parquet(path)
    near = runs(lowered, "doc_id", PLACES, named_bits(index))
    met = salted_lookup(near, index, ["probe"], ["doc_id"], how="inner").groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    # both sides grow with the articles; a text moves once, however many terms it is searched for
    pairs = lowered.join(met.hint("merge"), "doc_id").select("doc_id", F.explode("terms").alias("term"), *PLACES)
    places = [F.col(c).contains(F.col("term")).alias(f"in_{c}") for c in PLACES]
    return pairs.select("doc_id", "term", *places).filter(" or ".join(f"in_{c}" for c in PLACES))


def words_of(text: Column) -> Column:
    """The distinct upper-case words of letters and digits of a name."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("[A-Z0-9]+"), F.lit(0)))


def search_listings(queries: DataFrame, listings: DataFrame) -> DataFrame:
    """Search results of ``queries(query)`` in ``listings(listing, name, symbol, display_symbol)``.

    A listing is a result if its name holds every word of the query. Each distinct query is looked up once, under the word
    of it that the fewest listings have, so a word that many names share is rarely met and then spread by salt.
    ``extra`` counts the listing's further words; the fewer, the better, then the smaller listing: that order
    is ``result_pos`` as one number.
    """
    asked = queries.select(F.upper("query").alias("query")).distinct().withColumn("query_words", words_of(F.col("query")))
    listed = listings.withColumn("words", words_of(F.col("name")))
    by_word = listed.select("listing", F.explode("words").alias("word"))
    own = asked.select("query", "query_words", F.explode("query_words").alias("probe"))
    wanted = own.select("probe").distinct()
    counts = by_word.join(wanted, F.col("word") == F.col("probe")).groupBy("probe").agg(F.count("*").alias("n"))
    probes = rarest_key(own, counts, ["query", "query_words"])
    hits = salted_lookup(by_word.withColumnRenamed("word", "probe"), probes, ["probe"], ["listing"], how="inner")
    found = hits.join(listed, "listing").filter(F.size(F.array_except("query_words", "words")) == 0)
    extra = F.size("words") - F.size("query_words")
    return found.select("query", "listing", (F.least(extra, F.lit(15)).cast("long") * (1 << 36) + F.col("listing")).alias("result_pos"), "symbol", "display_symbol")
