"""Headline operators at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The tables a user keeps (sales by year, places, commune statistics, reviews, a raw sales file) are written once,
untimed. Each operator then runs once to warm up and three times for the median. Results go to the noop sink, so
every row is computed and none is collected.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import time

from pyspark.sql import functions as F

from terrascope import sinks, sources
from terrascope.operators import geo, hierarchy, indicators, reviews, sales
from terrascope.plans import catalog_tables, jobs
from terrascope.plans.catalog import QUERIES
from terrascope.plans.fixtures import view
from terrascope.session import build_session, fresh_path

RUNS = 3
YEAR, DEPT = 2019, "03"
BOX = (41.0, -5.0, 45.0, 0.0)
NOW = dt.datetime(2024, 1, 1)


def tables(spark, sf_dir: str) -> dict[str, str]:
    paths = {name: fresh_path(spark, f"bench-{name}") for name in (
        "tx", "cities", "departments", "regions", "city_stats", "reviews", "energy", "boundaries", "city_boundaries")}
    sinks.overwrite_years(view(spark, sf_dir, "tx"), paths["tx"], ["mutation_date"])
    for name in ("cities", "departments", "regions", "reviews", "energy", "boundaries", "city_boundaries"):
        view(spark, sf_dir, name).write.parquet(paths[name])
    stats = sales.city_year_stats(spark.read.parquet(paths["tx"])).withColumn("updated_at", F.lit(NOW))
    sinks.overwrite_years(stats, paths["city_stats"])
    return paths


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    paths = tables(spark, sf_dir)
    raw_sales = catalog_tables.sales_file(spark, sf_dir)
    aggregate = catalog_tables.aggregate_paths(spark, sf_dir)
    refreshed = fresh_path(spark, "bench-refreshed")
    setup = time.perf_counter() - start

    t = {name: spark.read.parquet(path) for name, path in paths.items()}
    priced = t["tx"].select(
        F.col("city_insee_code").alias("insee_code"), F.col("property_value").cast("double").alias("price"),
        F.col("built_surface").alias("surface"))
    lots, texts, sums = t["tx"].count(), t["reviews"].count(), t["city_stats"].count()
    with_dept = t["tx"].withColumnRenamed("city_insee_code", "insee_code")
    metric = t["city_stats"].groupBy(F.col("insee_code").alias("code")).agg(
        (F.sum("total_price").cast("double") / F.sum("transaction_count")).alias("value"))

    runs = {
        "job_dept_aggregate": (lots, lambda: jobs.job_dept_aggregate(spark, aggregate)),
        "import_sales": (lots, lambda: sources.import_sales(spark, raw_sales, YEAR, t["cities"])),
        "dept_sales_stats": (lots, lambda: sales.dept_sales_stats(priced, t["cities"])),
        "city_year_stats": (lots, lambda: sales.city_year_stats(t["tx"])),
        "refresh_city_year": (lots, lambda: sinks.refresh_city_year(t["tx"], refreshed, YEAR, NOW)),
        "region_stats": (sums, lambda: hierarchy.region_stats(
            t["regions"], t["departments"], t["cities"], t["city_stats"])),
        "department_stats": (sums, lambda: hierarchy.department_stats(t["departments"], t["cities"], t["city_stats"])),
        "transaction_stats": (lots, lambda: sales.transaction_stats(t["tx"], t["cities"], dept=DEPT, year=YEAR)),
        "transaction_stats_by_department": (lots, lambda: sales.transaction_stats_by(
            sales.attach_department(with_dept, t["cities"]), ["department_code"])),
        "search_transactions": (lots, lambda: sales.search_transactions(
            t["tx"], t["cities"], dept=DEPT, year=YEAR, min_price=50_000)),
        "heat_points": (lots, lambda: sales.heat_points(t["tx"], BOX, "AVERAGE_PRICE")),
        "tag_points": (lots, lambda: geo.tag_points(t["tx"], t["boundaries"])),
        "tag_points_communes": (lots, lambda: geo.tag_points(t["tx"], t["city_boundaries"], tile=0.25)),
        "choropleth_classes": (sums, lambda: geo.choropleth_classes(metric)),
        "word_frequencies": (texts, lambda: reviews.word_frequencies(t["reviews"])),
        "top_words": (texts, lambda: reviews.top_words(reviews.word_frequencies(t["reviews"]))),
        "score_reviews": (texts, lambda: reviews.score_reviews(t["reviews"])),
        "energy_distribution": (t["energy"].count(), lambda: indicators.energy_distribution(
            t["energy"].filter("label <> ''"))),
    }
    # keys that write their own inputs and tables, as registered: one run to warm up, one measured
    whole = {name: (lots, lambda q=QUERIES[name]: q(spark, sf_dir)) for name in (
        "word_weights", "drain_geocoding", "apply_geocodes", "sales_refresh_stream", "import_sales_zip",
        "job_import_year", "outline_points", "dept_sales_stats_rollup", "transaction_stats_by_department_rollup",
        "heat_points_average_price_stored", "in_viewport_stored", "page_after", "job_state_changes")}

    seconds, rate = {}, {}
    for name, (rows, run) in {**runs, **whole}.items():
        times = []
        for _ in range(2 if name in whole else RUNS + 1):
            start = time.perf_counter()
            result = run()
            if not isinstance(result, int):
                result.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rate[name] = round(rows / seconds[name])

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "rows_per_sec": rate, "setup_sec": round(setup, 1),
    }))


if __name__ == "__main__":
    main()
