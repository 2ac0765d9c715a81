"""Headline sentiment: classification model and aggregate features per company."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numeric import rounded
from tickerloom.functions.text import stripped
from tickerloom.operators.joins import salted_lookup

CLASSES = ["negative", "neutral", "positive"]


def normalize_sentiment(label: Column) -> Column:
    """``positive`` and ``negative`` pass, anything else (also nothing) is neutral."""
    cleaned = F.lower(stripped(label))
    return F.when(cleaned.isin("positive", "negative"), cleaned).otherwise(F.lit("neutral"))


def sentiment_features(symbols: DataFrame, classified: DataFrame) -> DataFrame:
    """Counts, ratios, score and overall label per symbol; symbols without articles get a zero row.

    Counting combines before the shuffle, so one symbol's many articles are no hot spot.
    """
    label = normalize_sentiment(F.col("sentiment"))
    counts = classified.groupBy("symbol").agg(
        F.count("*").alias("article_count"),
        *[F.count_if(label == c).alias(f"{c}_count") for c in CLASSES],
    )
    score = "try_divide(positive_count - negative_count, article_count)"
    return (
        symbols.select("symbol")
        .join(counts, "symbol", "left")
        .fillna(0, ["article_count", *[f"{c}_count" for c in CLASSES]])
        .selectExpr(
            "*",
            *[
                f"coalesce({rounded(f'try_divide({c}_count, article_count)', 4)}, 0D) as {c}_ratio"
                for c in CLASSES
            ],
            f"coalesce({rounded(score, 4)}, 0D) as sentiment_score",
            f"case when {score} > 0.2D then 'POSITIVE' when {score} < -0.2D then 'NEGATIVE'"
            " else 'NEUTRAL' end as overall_sentiment",
        )
    )


def _words(articles: DataFrame, with_empty: bool = False) -> DataFrame:
    """Each distinct word of a headline once, and the empty word if it is asked for."""
    found = "array_distinct(regexp_extract_all(lower(coalesce(headline, '')), '[a-z0-9]+', 0))"
    return articles.selectExpr("*", f"explode({f'array_append({found}, {chr(39)*2})' if with_empty else found}) as word")


def _micro(probability: Column) -> Column:
    """Log probability in millionths, so that sums are exact."""
    return F.round(F.ln(probability) * 1000000).cast("bigint")


class Model(NamedTuple):
    """Naive Bayes: a weight per word and class, and one row with the counts of classes."""

    words: DataFrame
    classes: DataFrame


def train(labelled: DataFrame) -> Model:
    """Count-based naive Bayes on ``headline, sentiment`` rows: in how many headlines of a class a word is.

    All labelled rows count, in one aggregate that combines before the shuffle: each headline also counts
    under the empty word, which gives the size of its class.
    """
    label = normalize_sentiment(F.col("sentiment"))
    rows = labelled.filter(stripped(F.col("headline")) != "").select("headline", label.alias("label"))
    counts = _words(rows, with_empty=True).groupBy("word").agg(
        *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES]
    )
    real = F.col("word") != ""
    sums = [F.coalesce(F.sum(F.when(real, F.col(f"n_{c}"))), F.lit(0)) + F.count_if(real) for c in CLASSES]
    sizes = [F.coalesce(F.max(F.when(~real, F.col(f"n_{c}"))), F.lit(0)) for c in CLASSES]
    classes = counts.agg(*[x.alias(f"d_{c}") for x, c in zip(sums, CLASSES)], *[x.alias(f"n_{c}") for x, c in zip(sizes, CLASSES)])
    # one scalar subquery, kept in a column of its own so that it stands in the plan once
    total = classes.select(F.struct("*")).scalar()
    words = counts.filter(real).withColumn("total", total).select(
        "word", *[_micro((F.col(f"n_{c}") + 1.0) / F.col(f"total.d_{c}")).alias(f"w_{c}") for c in CLASSES]
    )
    return Model(words, classes)


def predict(model: Model, articles: DataFrame) -> DataFrame:
    """Adds ``sentiment``; ties go to the earlier class, and a blank headline is neutral whatever the model says.

    Words of all headlines meet the model by an equi-join on the word, spread by salt where one is frequent.
    """
    found = salted_lookup(_words(articles.select("doc_id", "headline")), model.words, ["word"], ["doc_id"], salts=16, how="inner")
    sums = found.groupBy("doc_id").agg(*[F.sum(f"w_{c}").alias(f"s_{c}") for c in CLASSES])
    scored = articles.join(sums, "doc_id", "left").withColumn("class_sizes", model.classes.select(F.struct("*")).scalar())
    everything = sum((F.col(f"class_sizes.n_{c}") for c in CLASSES), F.lit(0.0))
    scored = scored.select(
        *articles.columns,
        *[
            (
                F.coalesce(f"s_{c}", F.lit(0)) + _micro((F.col(f"class_sizes.n_{c}") + 1.0) / (everything + float(len(CLASSES))))
            ).alias(f"t_{c}")
            for c in CLASSES
        ],
    )
    best = F.greatest(*[f"t_{c}" for c in CLASSES])
    label = F.when(stripped(F.coalesce("headline", F.lit(""))) == "", F.lit("neutral"))
    for c in CLASSES:
        label = label.when(F.col(f"t_{c}") == best, F.lit(c))
    return scored.select(*articles.columns, label.alias("sentiment"))
