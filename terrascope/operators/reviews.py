"""Review text: words, sentiment, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.metrics import java_round
from .paging import PAGE_SIZE, page
from .ranking import top_in_groups
from .sales import given

TOP_WORDS = 12


def _of_city(reviews: DataFrame, city: str | None) -> DataFrame:
    return reviews.filter(F.col("city_insee_code") == city) if given(city) else reviews


def reviews_page(reviews: DataFrame, city: str, number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Newest first."""
    rows = page(_of_city(reviews, city), [F.desc("published_at"), "id"], number, size)
    columns = ["id", "content", "sentiment_score", "sentiment_label", "published_at", "author", "rating"]
    return rows.select(*[c for c in columns if c in rows.columns])


def score_reviews(reviews: DataFrame) -> DataFrame:
    """Adds sentiment_score and sentiment_label; the text is cut into words once."""
    words = reviews.withColumn("_words", X.tokens(F.col("content"), X.MIN_SENTIMENT_LENGTH))
    scored = words.withColumn("_score", X.score_words(F.col("_words")))
    return scored.withColumns(
        {"sentiment_score": java_round(F.col("_score"), 3), "sentiment_label": X.label_score(F.col("_score"))}
    ).drop("_words", "_score")


def word_frequencies(reviews: DataFrame, city: str | None = None) -> DataFrame:
    """Words of at least four letters per city. Counts combine before the shuffle, so hot cities stay cheap."""
    words = _of_city(reviews, city).select(
        "city_insee_code", F.explode(X.tokens(F.col("content"), X.MIN_CLOUD_LENGTH)).alias("word")
    )
    return words.groupBy("city_insee_code", "word").agg(F.count(F.lit(1)).alias("n"))


def sentiment_stats_by_city(reviews: DataFrame) -> DataFrame:
    """Mean score and label counts per city; missing scores are 0, unknown labels are neutral."""
    return reviews.groupBy("city_insee_code").agg(*_sentiment())


def _sentiment():
    total = F.count(F.lit(1))
    positive = F.count_if(F.col("sentiment_label") == "POSITIVE")
    negative = F.count_if(F.col("sentiment_label") == "NEGATIVE")
    mean = java_round(F.avg(F.coalesce(F.col("sentiment_score"), F.lit(0.0))), 3)
    return [
        F.coalesce(mean, F.lit(0.0)).alias("average_score"),
        positive.alias("positive_count"),
        negative.alias("negative_count"),
        (total - positive - negative).alias("neutral_count"),
        total.alias("total_reviews"),
    ]


def sentiment_stats(reviews: DataFrame, city: str | None = None) -> DataFrame:
    """One row for a city (zeros when it has no reviews), or one row per city."""
    if not given(city):
        return sentiment_stats_by_city(reviews)
    return _of_city(reviews, city).agg(*_sentiment()).select(F.lit(city).alias("city_insee_code"), "*")


def positive_ratio(reviews: DataFrame) -> DataFrame:
    """Percentage of positive reviews per city, rounded half up."""
    share = F.floor(F.col("positive_count") * 100.0 / F.col("total_reviews") + 0.5).cast("bigint")
    return sentiment_stats_by_city(reviews).select(
        "city_insee_code", F.col("total_reviews"), share.alias("positive_ratio")
    )


def top_words(freq: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """Most frequent words of each city."""
    return top_in_groups(freq, "city_insee_code", [F.desc("n"), F.asc("word")], n)


def word_weights(freq: DataFrame) -> DataFrame:
    """Rank and min-max weight of every word in its city, for vocabularies of any size.

    A word's rank is the number of words of its city with a greater count, or the same count and a smaller start, plus
    its place among those of the same count and start. The first comes from a histogram of (count, first letters), so
    that only words of one histogram bar are ordered against one another, and words are dealt by bar, not by city.
    """
    barred = freq.withColumn("_start", F.substring("word", 1, 3))
    bars = barred.groupBy("city_insee_code", "n", "_start").agg(F.count(F.lit(1)).alias("_words"))
    city = W.partitionBy("city_insee_code")
    ahead = F.sum("_words").over(city.orderBy(F.desc("n"), "_start").rowsBetween(W.unboundedPreceding, -1))
    placed = bars.select(
        F.col("city_insee_code").alias("_city"), F.col("n").alias("_n"), F.col("_start").alias("_s"),
        F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.min("n").over(city).alias("_lo"), F.max("n").over(city).alias("_hi"))
    within = F.row_number().over(W.partitionBy("city_insee_code", "n", "_start").orderBy("word"))
    spread = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.col("_hi") - F.col("_lo"))
    same = (F.col("city_insee_code").eqNullSafe(F.col("_city")) & F.col("n").eqNullSafe(F.col("_n"))
            & F.col("_start").eqNullSafe(F.col("_s")))
    return barred.withColumn("_within", within).join(placed, same).select(
        "city_insee_code", "word", "n", (F.col("_ahead") + F.col("_within")).cast("bigint").alias("rank"),
        ((F.col("n") - F.col("_lo")).cast("double") / spread.cast("double")).alias("weight"))
