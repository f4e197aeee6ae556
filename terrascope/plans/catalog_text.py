"""Registered queries: reviews and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import reviews as R
from .fixtures import view
from .registry import plain, query

SOURCE = "src3"


def scored_reviews(spark, sf):
    return R.score_reviews(view(spark, sf, "reviews"))


@query("score_reviews", ["scored"], "SELECT id, sentiment_score, sentiment_label FROM scored")
def _(spark, sf):
    return scored_reviews(spark, sf).select("id", "sentiment_score", "sentiment_label")


@query("word_frequencies", ["words"], "SELECT city_insee_code, word, n FROM words")
def _(spark, sf):
    return R.word_frequencies(view(spark, sf, "reviews"))


@query("word_frequencies_of_city", ["words"],
       f"SELECT city_insee_code, word, n FROM words WHERE city_insee_code = '{SOURCE}'")
def _(spark, sf):
    return R.word_frequencies(view(spark, sf, "reviews"), SOURCE)


@query("top_words", ["words"], """
    SELECT city_insee_code, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY city_insee_code
      ORDER BY n DESC, word) AS INT) AS rank FROM words) AS w WHERE rank <= 12""")
def _(spark, sf):
    return R.top_words(R.word_frequencies(view(spark, sf, "reviews")))


@query("word_weights", ["words"], """
    SELECT city_insee_code, word, n,
      row_number() OVER (PARTITION BY city_insee_code ORDER BY n DESC, word) AS rank,
      CAST(n - min(n) OVER c AS DOUBLE) / CASE WHEN max(n) OVER c = min(n) OVER c THEN 1
        ELSE max(n) OVER c - min(n) OVER c END AS weight
    FROM words WINDOW c AS (PARTITION BY city_insee_code)""")
def _(spark, sf):
    return R.word_weights(R.word_frequencies(view(spark, sf, "reviews")))


_SENTIMENT = """
    SELECT city_insee_code, floor(avg(sentiment_score) * 1000 + 0.5) / 1000 AS average_score,
      count_if(sentiment_label = 'POSITIVE') AS positive_count, count_if(sentiment_label = 'NEGATIVE') AS negative_count,
      count_if(sentiment_label = 'NEUTRAL') AS neutral_count, count(*) AS total_reviews
    FROM scored GROUP BY city_insee_code"""


@query("sentiment_stats", ["scored"], f"""
    WITH s AS ({_SENTIMENT}) SELECT city_insee_code, average_score, CAST(positive_count AS BIGINT) AS positive_count,
      CAST(negative_count AS BIGINT) AS negative_count, CAST(neutral_count AS BIGINT) AS neutral_count,
      total_reviews FROM s""")
def _(spark, sf):
    return R.sentiment_stats(scored_reviews(spark, sf))


@query("positive_ratio", ["scored"], f"""
    WITH s AS ({_SENTIMENT}) SELECT city_insee_code, total_reviews,
      CAST(floor(positive_count * 100.0 / total_reviews + 0.5) AS BIGINT) AS positive_ratio FROM s""")
def _(spark, sf):
    return R.positive_ratio(scored_reviews(spark, sf))


@query("reviews_page", ["scored", "reviews"], f"""
    SELECT r.id, r.content, s.sentiment_score, s.sentiment_label, CAST(r.published_at AS STRING) AS published_at,
      r.author, r.rating
    FROM reviews r JOIN scored s ON s.id = r.id WHERE r.city_insee_code = '{SOURCE}'
    ORDER BY r.published_at DESC, r.id LIMIT 20""")
def _(spark, sf):
    return plain(R.reviews_page(scored_reviews(spark, sf), SOURCE))


ENERGY_SQL = """
    SELECT 'CITY' AS geographic_level, e.code_insee AS geographic_code, 'ENERGY' AS category,
      concat('DPE label ', l.label) AS label, floor(count_if(e.label = l.label) * 100.0 / count(*) * 1000 + 0.2718281) / 1000 AS value,
      '%' AS unit, CAST(NULL AS INT) AS year
    FROM energy e, (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F'), ('G')) AS l(label)
    WHERE e.label <> '' GROUP BY e.code_insee, l.label"""
HEALTH_SQL = """
    SELECT 'DEPARTMENT' AS geographic_level, dept AS geographic_code, 'HEALTH' AS category,
      concat('Pathology: ', pathology) AS label, floor(avg(CAST(replace(prevalence, ',', '.') AS DOUBLE)) * 1000 + 0.2718281) / 1000 AS value,
      '%' AS unit, CAST(year AS INT) AS year
    FROM health WHERE trim(pathology) <> '' AND prevalence <> 'n/a' GROUP BY dept, pathology, year"""


def energy_rows(spark, sf):
    return view(spark, sf, "energy").filter("label <> ''")


def health_rows(spark, sf):
    from ..functions import cleaning as C

    raw = view(spark, sf, "health")
    return raw.select(
        C.parse_int(F.col("year")).alias("year"), C.blank_to_null(F.col("pathology")).alias("pathology"), "dept",
        C.parse_double(F.col("prevalence")).alias("prevalence"),
    ).dropna()


@query("energy_distribution", ["energy"], ENERGY_SQL)
def _(spark, sf):
    return plain(I.energy_distribution(energy_rows(spark, sf)), gridded=["value"])


@query("health_prevalence", ["health"], HEALTH_SQL)
def _(spark, sf):
    return plain(I.health_prevalence(health_rows(spark, sf)), gridded=["value"])


@query("indicators_for", ["health"], f"""
    WITH h AS ({HEALTH_SQL}) SELECT category, label, value, unit, year FROM h WHERE geographic_code = '03'""")
def _(spark, sf):
    facts = I.health_prevalence(health_rows(spark, sf)).unionByName(I.energy_distribution(energy_rows(spark, sf)))
    return plain(I.indicators_for(facts, "DEPARTMENT", "03", "HEALTH"), gridded=["value"])
