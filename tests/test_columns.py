import unicodedata

import pytest
from pyspark.sql import functions as F

from terrascope.functions import cleaning as C
from terrascope.functions import codes, text as X
from terrascope.functions import metrics as M


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t")).alias("v")).collect()]


def test_clean_text(spark):
    assert values(spark, [' "a"b ', "", "  ", '""', None, "x"], C.clean_text) == ["ab", None, None, None, None, "x"]


def test_parse_int(spark):
    assert values(spark, [" 12 ", "3.7", "abc", "", None, "-4", "99999999999"], C.parse_int) == [
        12, None, None, None, None, -4, None]


def test_parse_double(spark):
    assert values(spark, ["1,5", " 2.5 ", "n/a", "", None], C.parse_double) == [1.5, 2.5, None, None, None]


def test_strip_quotes(spark):
    assert values(spark, ['"a"', '"', 'a"', ' "b" ', '""', None], C.strip_quotes) == ["a", '"', 'a"', "b", "", None]


def test_parse_money(spark):
    got = values(spark, ['"1234,56"', "10", "abc", None], C.parse_money)
    assert [None if v is None else float(v) for v in got] == [1234.56, 10.0, None, None]


def test_parse_sale_date(spark):
    got = values(spark, ["2019-02-28", "2019-02-30", "31/12/2019", "2019-2-3", "2019-01-01 10:00", None], C.parse_sale_date)
    assert [str(v) if v else None for v in got] == ["2019-02-28", None, None, None, None, None]


def test_split_parcel(spark):
    got = values(spark, ["75101000AB0012", "12345678", "1234567", "AB0012", "12", None], C.split_parcel)
    assert [(v["section"], v["plan_number"]) for v in got] == [
        ("00AB", "0012"), ("1234", "5678"), (None, None), (None, None), (None, None), (None, None)]
    assert values(spark, ["1234567", "AB0012", "12", "12345678", None], C.parcel_rejected) == [
        True, True, False, False, False]


def test_property_type(spark):
    texts = ["MAISON", "Appartement", "Dépendance", "dependance", "Local industriel. commercial ou assimilé", "x", None]
    assert values(spark, texts, C.map_property_type) == [
        "MAISON", "APPARTEMENT", "DEPENDANCE", "DEPENDANCE", "LOCAL", None, None]


@pytest.mark.parametrize("commune, dept, expected", [
    ("75101", "75", "75101"), ("1", "1", "01001"), ("12", "2A", "2A012"), ("123", "75", "75123"),
    ("1234", "75", "751234"), ("123", None, None), (None, "75", None), ("12", "971", "971012")])
def test_full_insee_code(spark, commune, dept, expected):
    df = spark.createDataFrame([(commune, dept)], "c STRING, d STRING")
    assert df.select(C.full_insee_code(F.col("c"), F.col("d"))).first()[0] == expected


@pytest.mark.parametrize("parts, expected", [
    (("12", "rue", "75001", "Paris"), "12 rue, 75001 Paris"), ((None, "rue", None, "Paris"), "rue, Paris"),
    ((None, None, "75001", "Paris"), "75001 Paris"), (("", "", "", "Paris"), "Paris")])
def test_address_line(spark, parts, expected):
    df = spark.createDataFrame([parts], "n STRING, t STRING, p STRING, c STRING")
    assert df.select(C.address_line(*[F.col(c) for c in "ntpc"])).first()[0] == expected


@pytest.mark.parametrize("price, surface, expected", [
    (250000, 80, 3125.0), (150000, 60, 2500.0), (0, 50, 0.0), (99999999, 1, 99999999.0), (100000, 0.5, 200000.0),
    (100000, 0, None), (100000, -3, None), (100000, None, None), (None, 50, None)])
def test_price_per_sqm(spark, price, surface, expected):
    df = spark.createDataFrame([(None if price is None else float(price), None if surface is None else float(surface))],
                               "p DOUBLE, s DOUBLE")
    assert df.select(M.price_per_sqm(F.col("p"), F.col("s"))).first()[0] == expected


def test_density_and_gdp(spark):
    df = spark.createDataFrame([(100, 4.0), (0, 4.0), (100, 0.0), (None, 4.0)], "p BIGINT, a DOUBLE")
    assert [r[0] for r in df.select(M.density(F.col("p"), F.col("a"))).collect()] == [25.0, None, None, None]
    assert df.select(M.density(F.col("p"), F.col("a"), "ha")).first()[0] == 2500.0
    assert [r[0] for r in df.select(M.gdp_per_capita(F.col("a"), F.col("p"))).collect()] == [40000.0, None, None, None]


def test_java_round_is_half_up(spark):
    df = spark.createDataFrame([(0.1335,), (-0.0005,), (-0.5,), (2.5,)], "v DOUBLE")
    assert [r[0] for r in df.select(M.java_round(F.col("v"), 3)).collect()][1] == 0.0
    assert [r[0] for r in df.select(M.java_round(F.col("v"), 0)).collect()][2:] == [0.0, 3.0]


def test_country_code(spark):
    df = spark.createDataFrame([("FRA", "x", "y"), ("-99", "NOR", "y"), ("-99", "-99", "KOS"), ("-99", None, "-99")],
                               "a STRING, b STRING, c STRING")
    assert [r[0] for r in df.select(M.country_code(F.col("a"), F.col("b"), F.col("c"))).collect()] == [
        "FRA", "NOR", "KOS", None]


def folded(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) < 0x370)


def test_fold_accents_equals_unicode(spark):
    every = ["".join(chr(cp) for cp in range(lo, lo + 64)) for lo in [*range(0x20, 0x370, 64), *range(0x1E00, 0x1F00, 64)]]
    texts = every + ["Très agréable", "ÉLOIGNÉ", "œuvre ø ß", "été", "naïve façade", "plain", "ά й"]
    assert values(spark, texts, X.fold_accents) == [folded(t) for t in texts]


def test_tokens(spark):
    assert values(spark, ["L'été à Paris, 3e!"], lambda c: X.tokens(c)) == [["l", "ete", "a", "paris", "e"]]
    assert values(spark, ["L'été à Paris, 3e!"], lambda c: X.tokens(c, 4)) == [["paris"]]


@pytest.mark.parametrize("text, score, label", [
    ("Très agréable et calme", 1.0, "POSITIVE"), ("Sale, bruyant !", -1.0, "NEGATIVE"), ("", 0.0, "NEUTRAL"),
    (None, 0.0, "NEUTRAL"), ("12 ab !", 0.0, "NEUTRAL"), ("calme sale", 0.0, "NEUTRAL"),
    # one positive among 100 words is exactly 0.1: not above the threshold
    (" ".join(["calme"] + ["mot"] * 99), 0.1, "NEUTRAL"),
    # 0.1 after rounding, but above it before
    (" ".join(["calme", "calme"] + ["mot"] * 197), 0.101, "POSITIVE"),
    (" ".join(["sale"] + ["mot"] * 59), -0.167, "NEGATIVE")])
def test_sentiment(spark, text, score, label):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert tuple(df.select(X.sentiment_score(F.col("t")), X.sentiment_label(F.col("t"))).first()) == (score, label)


def test_codes_keep_order_and_come_back(spark):
    texts = ["2A004", "75101", "01", "1", "97401", "2B", "", "1234567"]
    numbers = values(spark, texts + [None], lambda c: codes.code_number(c))
    assert numbers[-1] is None
    assert [t for _, t in sorted(zip(numbers, texts))] == sorted(texts)
    assert values(spark, texts + [None], lambda c: codes.code_text(codes.code_number(c))) == texts + [None]
    assert values(spark, ["12345678", "é123456"], lambda c: codes.code_number(c)) == [None, None]
