"""Company news: search names and terms, candidates, relevance, de-duplication, top stories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.text import is_blocked_headline, stripped
from tickerloom.operators.joins import salted_lookup
from tickerloom.operators.linked import connected_components, placed_in_order, settled

# Provider page size, points per match, the least relevant score kept,
# and how many stories are given.
CANDIDATES_PER_SYMBOL = 100
TITLE_POINTS, DESCRIPTION_POINTS, CONTENT_POINTS = 10, 4, 1
MIN_RELEVANCE = 8
DEFAULT_LIMIT, MAX_LIMIT = 5, 20
DEDUP_ROUNDS = 2  # before what is left is folded by component


def company_terms(companies: DataFrame, overrides: DataFrame) -> DataFrame:
    """Search name and lower-case matching terms: override, else company name, else the symbol."""
    name = "nullif(btrim(company_name, ' \\t\\r\\n'), '')"
    return companies.join(F.broadcast(overrides), "symbol", "left").selectExpr(
        "symbol",
        f"coalesce(override_name, {name}, symbol) as search_name",
        f"coalesce(override_terms, array(lower(coalesce({name}, symbol)))) as terms",
    )


def newest_first() -> list[Column]:
    """Order of a symbol's articles on a provider's result page."""
    return [F.col("published_at").desc(), F.col("doc_id").asc()]


def candidate_cap(articles: DataFrame, limit: int = CANDIDATES_PER_SYMBOL) -> DataFrame:
    """The provider's result page: the newest ``limit`` articles per symbol, with their ``position``.

    Spark applies the limit per partition before the shuffle, so however many articles one symbol
    has, no more than ``limit`` per map task travel, and everything later is bounded per symbol.
    """
    newest = Window.partitionBy("symbol").orderBy(*newest_first())
    return articles.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= limit
    )


def headline_filter(articles: DataFrame) -> DataFrame:
    """Drops empty and list-style headlines; the headline is the trimmed title."""
    headline = stripped(F.coalesce("title", F.lit("")))
    return articles.withColumn("headline", headline).filter(
        (F.col("headline") != "") & ~is_blocked_headline(F.col("headline"))
    )


def _lowered(articles: DataFrame) -> DataFrame:
    return articles.withColumns(
        {f"{c}_lower": F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "description", "content")}
    )


def term_article_join(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (article, term of its symbol) with where the term occurs as a substring.

    The terms of a symbol are few; articles of a much-covered symbol are spread by salt.
    """
    matched = salted_lookup(
        _lowered(articles),
        terms.select("symbol", F.explode("terms").alias("term")),
        ["symbol"],
        ["doc_id"],
        how="inner",
    )
    return matched.select(
        "symbol",
        "doc_id",
        "term",
        *[F.col(f"{c}_lower").contains(F.col("term")).alias(f"in_{c}") for c in ("title", "description", "content")],
    )


def relevance_score(articles: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds the summed points of all terms of the article's symbol, computed inside the row.

    A much-covered symbol is spread by salt.
    """

    def points(term: Column) -> Column:
        def hit(column: str, worth: int) -> Column:
            return F.when(F.col(column).contains(F.lower(term)), F.lit(worth)).otherwise(F.lit(0))

        return (
            hit("title_lower", TITLE_POINTS)
            + hit("description_lower", DESCRIPTION_POINTS)
            + hit("content_lower", CONTENT_POINTS)
        )

    joined = salted_lookup(_lowered(articles), terms.select("symbol", "terms"), ["symbol"], ["doc_id"], how="inner")
    score = F.aggregate("terms", F.lit(0), lambda total, term: total + points(term))
    kept = [c for c in joined.columns if c != "terms" and not c.endswith("_lower")]
    # The texts are searched in a generator, so that a filter on the score reads it, not recomputes it.
    return joined.select(*kept, F.explode(F.array(score)).alias("relevance_score"))


def relevant(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("relevance_score") >= MIN_RELEVANCE)


def _best() -> list[Column]:
    return [F.col("relevance_score").desc(), F.col("published_at").desc(), F.col("doc_id")]


def _keyed(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {"title_key": F.lower("headline"), "url_key": stripped(F.coalesce("url", F.lit("")))}
    )


def contenders(scored: DataFrame, limit: int) -> DataFrame:
    """Articles among which the first ``limit`` accepted of the greedy pass are found; the rest cannot matter.

    Of equal titles and urls only the best article can be accepted. An accepted article rules out at most
    its own title and its own url, so among articles of one title (or one url) only the best ``limit`` can
    ever be reached; and with no more than ``limit - 1`` accepted before it, each ruling out at most
    ``limit - 1`` further articles by title and by url, the last one taken is among the best
    ``limit + 2 (limit - 1) ** 2`` that are left. Spark applies each limit before its shuffle, so however
    many articles one symbol has, a bounded number of them leaves a task.
    """
    frame = scored.filter(F.col("url_key") != "")
    for keys, most in (
        (["symbol", "title_key", "url_key"], 1),
        (["symbol", "title_key"], limit),
        (["symbol", "url_key"], limit),
        (["symbol"], limit + 2 * (limit - 1) ** 2),
    ):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*_best()))
        frame = frame.withColumn("position", place).filter(F.col("position") <= most)
    return frame


def news_dedup(scored: DataFrame, limit: int = MAX_LIMIT) -> DataFrame:
    """Greedy de-duplication in order of relevance, recency and id: an article without a url, or whose
    title or url an *accepted* article already has, is skipped; the first ``limit`` accepted are given.
    Accepting depends on what was accepted before, so this is a fold over each symbol's
    :func:`contenders`, whose number the limit bounds.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"the number of stories must be 1 to {MAX_LIMIT}")
    item = F.struct(
        "position",
        "title_key",
        F.col("url_key").alias("url"),
        "headline",
        stripped(F.coalesce("description", F.lit(""))).alias("description"),
        F.col("source.name").alias("source"),
        "published_at",
        "relevance_score",
        "doc_id",
    )
    grouped = contenders(_keyed(scored), limit).groupBy("symbol").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def accept(kept: Column, article: Column) -> Column:
        seen = F.exists(
            kept, lambda k: (k["title_key"] == article["title_key"]) | (k["url"] == article["url"])
        )
        return F.when((F.size(kept) >= limit) | seen, kept).otherwise(F.concat(kept, F.array(article)))

    kept = F.aggregate("items", F.filter("items", lambda _: F.lit(False)), accept)
    return (
        grouped.select("symbol", F.posexplode(kept).alias("rank", "article"))
        .withColumn("rank", F.col("rank") + 1)
        .select("symbol", "rank", "article.*")
        .drop("position", "title_key")
    )


def news_dedup_all(scored: DataFrame) -> DataFrame:
    """The greedy de-duplication of :func:`news_dedup` without a limit: every accepted story of each symbol.

    In a few rounds, an article that is the best left of its title and of its url is accepted, since no better one can rule
    it out, and what shares a title or url with it goes. That settles all but chains of articles that rule each other
    out in turn. What is left falls into components of titles and urls, which cannot affect each other: each is folded
    from the best article to the worst as a sorted stream, holding only the titles and urls accepted in it. So the number
    of rounds does not follow the length of a chain. The rounds are written to the shared folder: this runs jobs when it
    is called.
    """

    def first(frame: DataFrame, *keys: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("symbol", *keys).orderBy(*order))
        return frame.withColumn("position", place).filter("position = 1").drop("position")

    order = [*_best(), F.col("title_key"), F.col("url_key")]
    keys = ["symbol", "title_key", "url_key"]
    left = _keyed(scored).filter("url_key <> '' and symbol is not null and title_key is not null").select(
        *keys,
        "headline",
        stripped(F.coalesce("description", F.lit(""))).alias("description"),
        F.col("source.name").alias("source"),
        "published_at",
        "relevance_score",
        "doc_id",
    )
    left, accepted = settled(first(left, "title_key", "url_key"), "news-left"), []
    for _ in range(DEDUP_ROUNDS):
        if left.isEmpty():
            break
        accepted.append(settled(first(left, "title_key").join(first(left, "url_key").select(*keys), keys), "news-accepted"))
        for key in ("title_key", "url_key"):
            left = left.join(accepted[-1].select("symbol", key), ["symbol", key], "left_anti")
        left = settled(left, "news-left")
    if not left.isEmpty():
        accepted.append(_folded(left, order))
    stories = reduce(DataFrame.unionByName, accepted, left.filter("false"))
    ranked = placed_in_order(stories, "symbol", order, "news-ranked").withColumn("rank", (F.col("position") + 1).cast("int"))
    return ranked.select("symbol", "rank", F.col("url_key").alias("url"), "headline", "description", "source", "published_at", "relevance_score", "doc_id")


def _folded(left: DataFrame, order: list[Column]) -> DataFrame:
    """The greedy pass over each component of titles and urls."""

    def accept(batches):
        component, titles, urls = None, set(), set()
        for batch in batches:
            taken = []
            for own, title, url in zip(*(batch.column(n).to_pylist() for n in ("component", "title_key", "url_key"))):
                if own != component:
                    component, titles, urls = own, set(), set()
                fresh = title not in titles and url not in urls
                if fresh:
                    titles.add(title)
                    urls.add(url)
                taken.append(fresh)
            yield batch.filter(taken_mask(taken))

    def taken_mask(taken):
        import pyarrow as pa

        return pa.array(taken, pa.bool_())

    title, url = (F.xxhash64("symbol", F.lit(key), key) for key in ("title_key", "url_key"))
    named = connected_components(left.select(title.alias("a"), url.alias("b")))
    found = left.withColumn("node", title).join(named, "node").drop("node")
    in_order = found.repartition("component").sortWithinPartitions("component", "symbol", *order)
    return in_order.mapInArrow(accept, in_order.schema).drop("component")


def news_topk(articles: DataFrame, terms: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Relevant, de-duplicated news per symbol, out of all its articles: at most ``limit`` stories, best first."""
    return news_dedup(relevant(relevance_score(headline_filter(articles), terms)), limit)
