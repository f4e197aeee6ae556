import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terrascope import sinks
from terrascope.operators import geo as G
from terrascope.operators import sales as S

NOW = dt.datetime(2024, 1, 1)


def sales(spark, rows):
    return spark.createDataFrame(
        [(i, f"m{i}", dt.date(y, 6, 1), y, "Vente", Decimal(v), "MAISON", 50.0, "c1") for i, y, v in rows],
        "id BIGINT, mutation_id STRING, mutation_date DATE, year INT, mutation_nature STRING, "
        "property_value DECIMAL(15,2), property_type STRING, built_surface DOUBLE, city_insee_code STRING")


def content(spark, path):
    return sorted((r["id"], r["year"]) for r in sinks.read_sales(spark, path).collect())


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "tx")
    rows = sales(spark, [(1, 2018, 100000), (2, 2019, 100000), (3, 2019, 100000)])
    sinks.YearStore(spark, path).replace("lots", rows, [2018, 2019])
    return path


def test_replacing_a_year_leaves_the_others(spark, table):
    incoming = sales(spark, [(9, 2019, 100000), (8, 2020, 100000)])
    for _ in range(2):
        assert sinks.replace_sales_year(incoming, table, 2019) == 1
        assert content(spark, table) == [(1, 2018), (9, 2019)]


def test_replacing_by_nothing_empties_the_year(spark, table):
    assert sinks.replace_sales_year(sales(spark, [(8, 2020, 1)]), table, 2019) == 0
    assert content(spark, table) == [(1, 2018)]


def test_truncate(spark, table):
    assert sinks.truncate_year(spark, table, 2019) and not sinks.truncate_year(spark, table, 2030)
    assert content(spark, table) == [(1, 2018)]
    assert not sinks.truncate_year(spark, table, 2019)


@pytest.mark.parametrize("year", [2013, 2031, dt.date.today().year + 1])
def test_year_guard(spark, table, year):
    with pytest.raises(ValueError):
        sinks.replace_sales_year(sales(spark, [(1, 2019, 1)]), table, year)


def test_refresh_is_repeatable_and_can_empty(spark, tmp_path):
    path = str(tmp_path / "stats")
    tx = sales(spark, [(1, 2018, 100000), (2, 2019, 100000)])
    for year in (2018, 2019, 2019):
        sinks.refresh_city_year(tx, path, year, NOW)
    assert sorted(r["year"] for r in sinks.read_city_stats(spark, path).collect()) == [2018, 2019]
    assert sinks.refresh_city_year(tx.filter("year = 2018"), path, 2019, NOW) == 0
    assert [r["year"] for r in sinks.read_city_stats(spark, path).collect()] == [2018]


def test_city_upsert_keeps_the_department(spark):
    columns = ("insee_code STRING, name STRING, postal_code STRING, department_code STRING, population BIGINT, "
               "area DOUBLE, latitude DOUBLE, longitude DOUBLE")
    known = spark.createDataFrame([("a", "Old", "1", "01", 5, 1.0, 1.0, 1.0), ("b", "Kept", "2", "01", 6, 1.0, 1.0, 1.0)], columns)
    new = spark.createDataFrame([("a", "New", None, "99", None, 2.0, None, 3.0), ("c", "Added", "3", "02", 7, 1.0, 1.0, 1.0)], columns)
    rows = {r["insee_code"]: tuple(r)[1:] for r in sinks.upsert_cities(known, new).collect()}
    assert rows == {"a": ("New", None, "01", None, 2.0, None, 3.0), "b": ("Kept", "2", "01", 6, 1.0, 1.0, 1.0),
                    "c": ("Added", "3", "02", 7, 1.0, 1.0, 1.0)}


def test_a_key_given_twice_is_inserted_once(spark):
    columns = "code STRING, name STRING"
    known = spark.createDataFrame([("1", "a")], columns)
    twice = spark.createDataFrame([("1", "b"), ("1", "c"), ("2", "x"), ("2", "x")], columns)
    assert sorted(tuple(r) for r in sinks.upsert_names(known, twice).collect()) == [("1", "c"), ("2", "x")]


def test_name_and_boundary_upsert(spark):
    known = spark.createDataFrame([("1", "Old", "r1", 5)], "code STRING, name STRING, region_code STRING, population BIGINT")
    new = spark.createDataFrame([("1", "New", "r2"), ("2", "Added", "r2")], "code STRING, name STRING, region_code STRING")
    assert {tuple(r) for r in sinks.upsert_names(known, new).collect()} == {("1", "New", "r1", 5), ("2", "Added", "r2", None)}
    columns = "geographic_level STRING, geographic_code STRING, name STRING, geometry STRING"
    b = sinks.upsert_boundaries(spark.createDataFrame([("CITY", "1", "a", "g"), ("REGION", "1", "r", "g")], columns),
                                spark.createDataFrame([("CITY", "1", "b", "h")], columns))
    assert {tuple(r) for r in b.collect()} == {("CITY", "1", "b", "h"), ("REGION", "1", "r", "g")}


def test_the_last_row_of_a_feed_wins(spark):
    known = spark.createDataFrame([("1", "Old", "r1")], "code STRING, name STRING, region_code STRING")
    new = spark.createDataFrame([("1", "Z", 1), ("1", "A", 2)], "code STRING, name STRING, at INT")
    assert [tuple(r) for r in sinks.upsert(known, new, ["code"], ["name"], order="at").collect()] == [("1", "A", "r1")]


def test_indicator_rerun_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "indicators")
    def facts(category, value):
        return spark.createDataFrame([("CITY", "1", category, "l", value, "%", 2020)],
                                     "geographic_level STRING, geographic_code STRING, category STRING, label STRING, "
                                     "value DOUBLE, unit STRING, year INT")
    sinks.append_indicators(facts("ENERGY", 1.0).withColumn("year", F.lit(2019)), path)
    sinks.append_indicators(facts("ENERGY", 1.0), path)
    sinks.append_indicators(facts("HEALTH", 2.0), path)
    sinks.append_indicators(facts("ENERGY", 3.0), path)
    assert sorted((r["category"], r["year"], r["value"]) for r in spark.read.parquet(path).collect()) == [
        ("ENERGY", 2019, 1.0), ("ENERGY", 2020, 3.0), ("HEALTH", 2020, 2.0)]


def test_geocodes_touch_only_tried_rows(spark, tmp_path):
    path = str(tmp_path / "tx")
    base = sales(spark, [(1, 2018, 1), (2, 2018, 1), (3, 2019, 1), (4, 2019, 1)]).withColumns(
        {"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double"),
         "geocoded_at": F.lit(None).cast("timestamp")})
    sinks.YearStore(spark, path).replace("lots", base, [2018, 2019])
    matches = spark.createDataFrame(
        [(1, 2018, 45.0, 2.0, True), (2, 2018, 46.0, 3.0, False), (1, 2018, None, None, False)],
        "id BIGINT, year INT, latitude DOUBLE, longitude DOUBLE, resolved BOOLEAN")
    assert sinks.write_geocodes(spark, path, matches, NOW) == 2
    rows = {r["id"]: (r["latitude"], r["geocoded_at"] is not None) for r in sinks.read_sales(spark, path).collect()}
    assert rows == {1: (45.0, True), 2: (None, True), 3: (None, False), 4: (None, False)}
    assert S.geocode_backlog_size(sinks.read_sales(spark, path)).first()["backlog"] == 2


def test_department_statistics_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([("01", 1)], "department_code STRING, transaction_count BIGINT")
    for _ in range(2):
        sinks.write_dept_stats(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1


def test_boundaries_keep_their_boxes(spark, tmp_path):
    def shape(x):
        return '{"type":"Polygon","coordinates":[[[%d,0],[%d,0],[%d,1],[%d,0]]]}' % (x, x + 1, x + 1, x)

    columns = "geographic_level STRING, geographic_code STRING, name STRING, geometry STRING"
    known = spark.createDataFrame([("CITY", "1", "a", shape(0))], columns)
    feed = spark.createDataFrame(
        [("CITY", "1", "new", shape(3), 2), ("CITY", "1", "older", shape(9), 1), ("CITY", "2", "b", shape(5), 3)], columns + ", at INT")
    merged = sinks.upsert_boundaries(known, feed, order="at")
    assert {(r["geographic_code"], r["name"]) for r in merged.collect()} == {("1", "new"), ("2", "b")}
    twice = feed.drop("at").unionByName(feed.drop("at"))
    assert sinks.upsert_boundaries(known, twice).count() == 2
    path = str(tmp_path / "b")
    sinks.write_boundaries(merged, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    seen = G.features_in_view(spark.read.parquet(path), 0.0, 3.5, 1.0, 4.5)
    assert [r["geographic_code"] for r in seen.collect()] == ["1"]
    text = seen._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(max_x,3.5)" in text and "from_json" not in text
