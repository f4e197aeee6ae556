"""What the plans must look like at size."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terrascope import sinks
from terrascope.operators import geo as G
from terrascope.operators import hierarchy as H
from terrascope.operators import paging as P
from terrascope.operators import reviews as R
from terrascope.operators import sales as S
from terrascope.plans.catalog import QUERIES
from terrascope.plans.fixtures import view

SF = "/root/testdata/sf0.001"
LAZY = [
    "dept_sales_stats", "region_stats", "department_stats", "city_stats", "transaction_stats_by", "hierarchy",
    "tag_points", "choropleth_classes", "heat_weights", "log_ratio", "feature_centers", "outline_points",
    "match_geocodes", "resolve_city", "partition_status", "swap_layer", "word_frequencies", "top_words",
]


@pytest.fixture(autouse=True, scope="module")
def long_descriptions(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", LAZY)
def test_nothing_needs_a_cross_join_or_a_broadcast(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "BroadcastExchange" not in text
    assert "Python" not in text and "Pandas" not in text


def test_no_broadcast_hints_in_the_library():
    import pathlib

    import terrascope

    root = pathlib.Path(terrascope.__file__).parent
    for source in root.rglob("*.py"):
        if source.relative_to(root).parts[0] == "llm":
            continue  # bounded tables are sent to tasks there
        text = source.read_text()
        for banned in ("broadcast(", "crossJoin", "localCheckpoint", ".toPandas(", "F.udf", "collect_list"):
            assert banned not in text, (source, banned)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "tx")
    sinks.overwrite_years(view(spark, SF, "tx"), path, ["mutation_date"])
    return spark.read.parquet(path)


def test_year_filter_prunes_partitions_and_columns(spark, table):
    text = plan(S.city_year_stats(table, 2019))
    assert "PartitionFilters: [isnotnull(year" in text
    pushed = text[text.index("PushedFilters"):]
    for name in ("mutation_id", "mutation_nature", "property_value", "mutation_date"):
        assert name in pushed[: pushed.index("ReadSchema")]
    assert "latitude" not in text and "postal_code" not in text


def test_sales_are_aggregated_in_hash_tables(spark, table):
    text = plan(S.city_year_stats(table))
    assert "SortAggregate" not in text and text.count("HashAggregate") >= 4


def test_viewport_reaches_the_scan(spark, table):
    text = plan(S.heat_points(table, (41.0, -5.0, 45.0, 0.0), "AVERAGE_PRICE"))
    assert "GreaterThanOrEqual(latitude,41.0)" in text and "LessThanOrEqual(longitude,0.0)" in text
    assert "TakeOrderedAndProject" not in text  # all cells; with a number of rows, the densest only
    assert "TakeOrderedAndProject" in plan(S.heat_points(table, (41.0, -5.0, 45.0, 0.0), "AVERAGE_PRICE", rows=5000))


def test_the_next_page_is_pushed_to_the_scan(spark, table):
    day = dt.date(2019, 3, 1)
    text = plan(P.page_after(table, ["mutation_date", "id"], [day, "x"]))
    assert "GreaterThanOrEqual(mutation_date,2019-03-01)" in text and "TakeOrderedAndProject" in text


def test_department_counts_are_made_once(spark):
    view(spark, SF, "cities").count()
    done = QUERIES["dept_sales_stats"](spark, SF)
    done.collect()
    assert "ReusedExchange" in plan(done)


def test_pages_and_top_words_limit_before_the_shuffle(spark, table):
    cities = view(spark, SF, "cities")
    assert "TakeOrderedAndProject" in plan(S.search_transactions(table, cities, year=2019))
    text = plan(R.top_words(R.word_frequencies(view(spark, SF, "reviews"))))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_group_counts_are_reused(spark):
    df = view(spark, SF, "tx")
    done = S.transaction_stats_by(df, ["city_insee_code"])
    done.collect()
    assert "ReusedExchange" in plan(done)


def test_hot_commune_and_hot_sale(spark):
    """One sale holds a third of all lots and one commune most sales: counts stay exact."""
    day = dt.date(2020, 1, 1)
    lots = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("mutation_id"),
        F.lit(day).alias("mutation_date"), F.lit("Vente").alias("mutation_nature"),
        F.lit(Decimal("100000.00")).cast("decimal(15,2)").alias("property_value"), F.lit("MAISON").alias("property_type"),
        F.lit(10.0).alias("built_surface"),
        F.when(F.col("id") % 10 == 1, F.lit("00002")).otherwise(F.lit("00001")).alias("city_insee_code"))
    rows = {r["insee_code"]: (r["transaction_count"], float(r["total_residential_surface"])) for r in
            S.city_year_stats(lots, 2020).collect()}
    # the hot sale belongs to the larger of its two codes
    assert rows == {"00001": (18_000, 180_000.0), "00002": (2_001, 20_000.0 + 100_000.0)}
    assert H.distinct_codes(lots.select(F.col("city_insee_code").alias("code"))).count() == 2
