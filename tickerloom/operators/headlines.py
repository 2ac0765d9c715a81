"""Headline classifier over TF-IDF features, fitted once, stored, and loaded by what uses it."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.text import stripped
from tickerloom.operators.sentiment import CLASSES, normalize_sentiment

VOCABULARY = 1 << 16  # words of the model, the most frequent ones; more do not enter
HELD_OUT_EVERY = 5


def _prepared(headlines: DataFrame) -> DataFrame:
    return headlines.withColumn("headline", F.coalesce("headline", F.lit("")))


def labelled_rows(labelled: DataFrame) -> DataFrame:
    """``headline, sentiment`` rows with the number of their class, blank headlines left out."""
    number = F.array_position(F.lit(CLASSES), normalize_sentiment(F.col("sentiment"))) - 1
    return _prepared(labelled).filter(stripped(F.col("headline")) != "").withColumn("label", number.cast("double"))


def fit(labelled: DataFrame) -> PipelineModel:
    """Words, their weights by inverse document frequency, and a multinomial logistic regression on them."""
    stages = [
        RegexTokenizer(inputCol="headline", outputCol="words", pattern="[a-z0-9]+", gaps=False),
        CountVectorizer(inputCol="words", outputCol="counts", vocabSize=VOCABULARY),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(family="multinomial", regParam=0.01, maxIter=40),
    ]
    return Pipeline(stages=stages).fit(labelled_rows(labelled))


def held_out() -> Column:
    """Which labelled rows a measured fit leaves out."""
    return F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_EVERY == 0


def accuracy(model: PipelineModel, labelled: DataFrame) -> float:
    """Share of labelled rows whose class the model finds."""
    scored = model.transform(labelled_rows(labelled))
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def predict(model: PipelineModel, articles: DataFrame) -> DataFrame:
    """Adds ``sentiment``; a blank headline is neutral."""
    scored = model.transform(_prepared(articles))
    found = F.get(F.lit(CLASSES), F.col("prediction").cast("int"))
    blank = stripped(F.col("headline")) == ""
    return scored.withColumn("sentiment", F.when(blank, F.lit("neutral")).otherwise(found)).select(*articles.columns, "sentiment")


def weights(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The stored features: word, in how many headlines it is, inverse document frequency."""
    vocabulary, idf = model.stages[1].vocabulary, model.stages[2]
    rows = list(zip(vocabulary, (int(n) for n in idf.docFreq), (float(w) for w in idf.idf.toArray())))
    return spark.createDataFrame(rows, "word string, headlines long, idf double")
