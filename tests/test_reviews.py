from terrascope.operators import indicators as I
from terrascope.operators import reviews as R


def reviews(spark, texts, city="c"):
    return spark.createDataFrame([(str(i), city, t) for i, t in enumerate(texts)], "id STRING, city_insee_code STRING, content STRING")


def words(spark, texts):
    return {r["word"]: r["n"] for r in R.word_frequencies(reviews(spark, texts)).collect()}


def test_word_counts(spark):
    assert words(spark, ["Belle ville avec beaucoup de charme", "Très belle ville calme"]) == {
        "belle": 2, "ville": 2, "beaucoup": 1, "charme": 1, "calme": 1, "avec": 1, "tres": 1}


def test_blank_text(spark):
    assert words(spark, ["", None, "magnifique endroit"]) == {"magnifique": 1, "endroit": 1}


def test_accents(spark):
    assert set(words(spark, ["résidentiel éloigné général"])) == {"residentiel", "eloigne", "general"}


def scored(spark, pairs):
    return spark.createDataFrame([("c", s, l) for s, l in pairs], "city_insee_code STRING, sentiment_score DOUBLE, sentiment_label STRING")


def sentiment(spark, pairs):
    return tuple(R.sentiment_stats(scored(spark, pairs), "c").first())[1:]


def test_sentiment_stats(spark):
    assert sentiment(spark, [(0.8, "POSITIVE"), (-0.5, "NEGATIVE"), (0.1, "NEUTRAL")]) == (0.133, 1, 1, 1, 3)
    assert sentiment(spark, [(None, "NEUTRAL")]) == (0.0, 0, 0, 1, 1)
    assert sentiment(spark, [(0.3, "UNKNOWN")]) == (0.3, 0, 0, 1, 1)
    assert sentiment(spark, []) == (0.0, 0, 0, 0, 0)


def test_null_labels_are_neutral(spark):
    assert sentiment(spark, [(0.3, None), (0.3, "POSITIVE")]) == (0.3, 1, 0, 1, 2)


def test_positive_ratio_rounds_half_up(spark):
    rows = scored(spark, [(1.0, "POSITIVE")] + [(0.0, "NEUTRAL")] * 7)
    assert R.positive_ratio(rows).first()["positive_ratio"] == 13


def test_top_words_and_weights(spark):
    freq = spark.createDataFrame([("c", f"word{i:02d}", 20 - i) for i in range(15)] + [("d", "seul", 3)],
                                 "city_insee_code STRING, word STRING, n BIGINT")
    top = R.top_words(freq).collect()
    assert sorted((r["rank"], r["word"]) for r in top if r["city_insee_code"] == "c") == [
        (i + 1, f"word{i:02d}") for i in range(12)]
    weights = {r["word"]: (r["rank"], r["weight"]) for r in R.word_weights(freq).collect()}
    assert weights["word00"] == (1, 1.0) and weights["word14"] == (15, 0.0) and weights["seul"] == (1, 0.0)


def test_energy_keeps_unknown_labels_in_the_denominator(spark):
    rows = spark.createDataFrame([("c", "A"), ("c", "A"), ("c", "X"), ("c", "G")], "code_insee STRING, label STRING")
    got = {r["label"]: r["value"] for r in I.energy_distribution(rows).collect()}
    assert len(got) == 7 and got["DPE label A"] == 50.0 and got["DPE label G"] == 25.0 and got["DPE label B"] == 0.0


def test_health_mean_is_unweighted(spark):
    rows = spark.createDataFrame([("01", "p", 2020, 1.0), ("01", "p", 2020, 4.0), ("01", "p", 2021, 9.0)],
                                 "dept STRING, pathology STRING, year INT, prevalence DOUBLE")
    got = {(r["label"], r["year"]): r["value"] for r in I.health_prevalence(rows).collect()}
    assert got == {("Pathology: p", 2020): 2.5, ("Pathology: p", 2021): 9.0}
