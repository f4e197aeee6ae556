"""End-to-end jobs: source, operators, table. `paths` names the inputs and outputs of a job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .. import sinks, sources
from ..operators import hierarchy as H
from ..operators import indicators as I
from ..operators import reviews as R
from ..operators import sales as S


def job_dept_aggregate(spark: SparkSession, paths: dict) -> DataFrame:
    """Raw sales file and commune mapping to department statistics."""
    sales = sources.scan_sales_csv(spark, paths["sales"])
    stats = S.dept_sales_stats(sales, sources.scan_city_mapping(spark, paths["cities"]))
    sinks.write_dept_stats(stats, paths["dept_stats"])
    return spark.read.parquet(paths["dept_stats"])


def job_import_year(spark: SparkSession, paths: dict, year: int, now: dt.datetime | None = None) -> DataFrame:
    """Replace one year of sales from its raw file, with all its statistics, in one switch of `paths["store"]`."""
    sinks.check_year(year)
    cities = spark.read.parquet(paths["cities"])
    importer = sources.import_sales_zip if paths["sales"].endswith(".zip") else sources.import_sales
    sinks.publish_years(sinks.YearStore(spark, paths["store"]), importer(spark, paths["sales"], year, cities), [year], now)
    return sinks.read_city_stats(spark, paths["store"])


def job_reference_data(
    spark: SparkSession, paths: dict, multi_line: bool = True
) -> dict[str, DataFrame]:
    """Regions, departments and communes from their feeds, merged into the known ones, with fresh totals.

    The merged tables go to `paths["out"]`: a table cannot be overwritten while it is read.
    """
    known = {name: spark.read.parquet(paths[name]) for name in ("regions", "departments", "cities")}
    regions = sinks.upsert_names(
        known["regions"], sources.scan_regions_json(spark, paths["regions_json"], multi_line)
    )
    departments = sinks.upsert_names(
        known["departments"],
        sources.scan_departments_json(spark, paths["departments_json"], regions, multi_line),
    )
    communes = sources.scan_communes_json(spark, paths["communes_json"], departments, multi_line)
    out = {name: f"{paths['out']}/{name}" for name in known}
    sinks.upsert_cities(known["cities"], communes).write.mode("overwrite").parquet(out["cities"])
    cities = spark.read.parquet(out["cities"])
    H.recompute_departments(departments, cities).write.mode("overwrite").parquet(out["departments"])
    renewed = spark.read.parquet(out["departments"])
    H.recompute_regions(regions, renewed).write.mode("overwrite").parquet(out["regions"])
    return {name: spark.read.parquet(path) for name, path in out.items()}


def job_score_reviews(spark: SparkSession, reviews: DataFrame, target: str) -> DataFrame:
    sinks.append_reviews(R.score_reviews(reviews), target)
    return spark.read.parquet(target)


def job_energy(spark: SparkSession, path: str, target: str) -> DataFrame:
    sinks.append_indicators(I.energy_distribution(sources.scan_energy(spark, path)), target)
    return spark.read.parquet(target)


def job_health(spark: SparkSession, path: str, target: str) -> DataFrame:
    sinks.append_indicators(I.health_prevalence(sources.scan_health(spark, path)), target)
    return spark.read.parquet(target)


def job_recompute_stats(spark: SparkSession, paths: dict, now: dt.datetime) -> dict[str, DataFrame]:
    """The statistics of every year in one pass, then the rollups and the department aggregate."""
    sinks.rebuild_statistics(sinks.YearStore(spark, paths["store"]), now)
    fresh = sinks.read_city_stats(spark, paths["store"])
    regions, departments, cities = (spark.read.parquet(paths[n]) for n in ("regions", "departments", "cities"))
    return {
        "regions": H.region_stats(regions, departments, cities, fresh),
        "departments": H.department_stats(departments, cities, fresh),
        "dept_stats": job_dept_aggregate(spark, paths),
    }
