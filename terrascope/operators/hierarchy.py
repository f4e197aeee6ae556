"""Regions, departments and communes: searches, rollups, consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import density, gdp_per_capita, ha_to_km2
from ..sources.layers import union_layers
from .paging import PAGE_SIZE, page
from .sales import given

SEARCH_ROWS = 8
_SUMS = ("transaction_count", "total_price", "total_residential_surface")


# --- searches -------------------------------------------------------------------------------------------------


def _contains(name: str, query: str) -> Column:
    return F.lower(F.col(name)).contains(query.lower())


def search_cities(
    cities: DataFrame, dept: str | None = None, query: str | None = None, number: int = 0, size: int = PAGE_SIZE
) -> DataFrame:
    """By name part; else by department; else all. A name query wins over the department."""
    rows = cities
    if given(query):
        rows = rows.filter(_contains("name", query))
    elif given(dept):
        rows = rows.filter(F.col("department_code") == dept)
    return page(rows, ["insee_code"], number, size)


def _with_name(rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(parents.select(F.col("code").alias(key), F.col("name").alias(name)), key, "left")


def city_detail(cities: DataFrame, departments: DataFrame, code: str) -> DataFrame:
    rows = cities.filter(F.col("insee_code") == code)
    columns = [
        "insee_code", "name", "postal_code", "department_code", "department_name", "population", "latitude",
        "longitude",
    ]
    joined = _with_name(rows, departments, "department_code", "department_name")
    return joined.select(*[c for c in columns if c in joined.columns])


def list_departments(
    departments: DataFrame, regions: DataFrame, region: str | None = None, code: str | None = None
) -> DataFrame:
    rows = departments
    if given(region):
        rows = rows.filter(F.col("region_code") == region)
    if given(code):
        rows = rows.filter(F.col("code") == code)
    columns = ["code", "name", "region_code", "region_name", "population", "area"]
    joined = _with_name(rows, regions, "region_code", "region_name")
    return joined.select(*[c for c in columns if c in joined.columns])


def list_regions(regions: DataFrame, code: str | None = None) -> DataFrame:
    return regions.filter(F.col("code") == code) if given(code) else regions


def search_regions(regions: DataFrame, query: str, limit: int = SEARCH_ROWS) -> DataFrame:
    if not given(query):
        return regions.limit(0)
    return regions.filter(_contains("name", query.strip())).orderBy("code").limit(limit)


def search_places(
    regions: DataFrame, departments: DataFrame, query: str, limit: int = SEARCH_ROWS
) -> DataFrame:
    """Regions by name, then departments by name or code."""
    text = query.strip() if query else ""

    def tagged(df, level, rank):
        return df.select("code", "name", F.lit(level).alias("level"), F.lit(rank).alias("_rank"))

    found = tagged(regions.filter(_contains("name", text)), "REGION", 0).unionByName(
        tagged(departments.filter(_contains("name", text) | F.col("code").contains(text.lower())), "DEPARTMENT", 1)
    )
    if not text:
        found = found.limit(0)
    return found.orderBy("_rank", "code").limit(limit).drop("_rank")


# --- rollups --------------------------------------------------------------------------------------------------


def hierarchy(regions: DataFrame, departments: DataFrame, cities: DataFrame, stats: DataFrame) -> DataFrame:
    """Region, department, commune and statistics side by side; empty parents are kept.

    The large side is always the one that streams: communes look up their parents, and the parents that no
    commune has named are added. Joined from the top, a department of many communes could not be split.
    """
    r = regions.select(F.col("code").alias("region_code"), F.col("name").alias("region_name"))
    d = departments.select(
        F.col("code").alias("department_code"), F.col("name").alias("department_name"), "region_code"
    ).join(r, "region_code")
    c = cities.select("insee_code", F.col("name").alias("city_name"), "department_code")
    s = stats.select("insee_code", "year", *_SUMS)
    placed = c.join(d, "department_code").join(s, "insee_code", "left")
    no_cities = d.join(c.select("department_code").distinct(), "department_code", "left_anti")
    no_departments = r.join(d.select("region_code").distinct(), "region_code", "left_anti")
    rows = union_layers(placed, no_cities, no_departments)
    return rows.select(
        "region_code", "region_name", "department_code", "department_name", "insee_code", "city_name", "year", *_SUMS
    )


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("transaction_count").alias("transaction_count"),
        F.sum("total_price").cast("decimal(30,2)").alias("total_price"),
        F.sum("total_residential_surface").alias("total_residential_surface"),
    )


def _averages(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    count = F.coalesce(F.col("transaction_count"), F.lit(0)).cast("bigint")
    price = F.col("total_price").cast("double")
    surface = F.col("total_residential_surface")
    return rows.select(
        *columns,
        count.alias("transaction_count"),
        F.when(count > 0, price / count.cast("double")).alias("average_price"),
        F.when(surface > 0, price / surface).alias("average_price_per_sqm"),
    )


def _present(df: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c in df.columns]


def department_sums(cities: DataFrame, stats: DataFrame) -> DataFrame:
    """Yearly commune sums reduced to communes, then to departments: each step shrinks before the next join."""
    per_city = _sums(stats, "insee_code")
    return _sums(per_city.join(cities.select("insee_code", "department_code"), "insee_code"), "department_code")


def region_stats(
    regions: DataFrame, departments: DataFrame, cities: DataFrame, stats: DataFrame
) -> DataFrame:
    """Weighted averages per region; regions without sales have a zero count and NULL averages."""
    by_dept = department_sums(cities, stats).withColumnRenamed("department_code", "code")
    by_region = _sums(departments.select("code", "region_code").join(by_dept, "code"), "region_code")
    rows = regions.join(by_region.withColumnRenamed("region_code", "code"), "code", "left")
    return _averages(rows, _present(regions, "code", "name", "population", "area")).orderBy("code")


def department_stats(
    departments: DataFrame, cities: DataFrame, stats: DataFrame, region: str | None = None
) -> DataFrame:
    wanted = departments.filter(F.col("region_code") == region) if region is not None else departments
    by_dept = department_sums(cities, stats).withColumnRenamed("department_code", "code")
    rows = wanted.join(by_dept, "code", "left")
    return _averages(rows, _present(departments, "code", "name", "region_code", "population", "area")).orderBy("code")


def distinct_codes(df: DataFrame, n: int | None = None, column: str = "code") -> DataFrame:
    """Distinct codes; with `n` the first ones."""
    codes = df.select(column).distinct()
    return codes if n is None else codes.orderBy(column).limit(n)


def city_stats(
    cities: DataFrame, stats: DataFrame, codes: DataFrame, max_codes: int | None = None
) -> DataFrame:
    """Rollup of the communes named in `codes`, or in the first `max_codes` of them."""
    wanted = distinct_codes(codes, max_codes).withColumnRenamed("code", "insee_code")
    chosen = cities.join(wanted, "insee_code", "left_semi")
    per_city = _sums(stats.join(wanted, "insee_code", "left_semi"), "insee_code")
    rows = chosen.join(per_city, "insee_code", "left").withColumnRenamed("insee_code", "code")
    return _averages(rows, _present(rows, "code", "name", "department_code", "population", "area")).orderBy("code")


def _recompute(parents: DataFrame, children: DataFrame, link: str) -> DataFrame:
    sums = children.groupBy(F.col(link).alias("code")).agg(
        F.sum("population").alias("population"), F.sum("area").alias("area")
    )
    kept = [c for c in parents.columns if c not in ("population", "area")]
    return parents.select(*kept).join(sums, "code", "left").select(*kept, "population", "area")


def recompute_departments(departments: DataFrame, cities: DataFrame) -> DataFrame:
    """Population and area from the communes; NULL without communes."""
    return _recompute(departments, cities, "department_code")


def recompute_regions(regions: DataFrame, departments: DataFrame) -> DataFrame:
    return _recompute(regions, departments, "region_code")


def national_totals(regions: DataFrame) -> DataFrame:
    return regions.agg(
        F.count(F.lit(1)).alias("region_count"),
        F.coalesce(F.sum("population"), F.lit(0)).cast("bigint").alias("population"),
        F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"),
    )


def child_counts(parents: DataFrame, children: DataFrame, link: str) -> DataFrame:
    """Children of every parent, 0 included."""
    counts = children.groupBy(F.col(link).alias("code")).agg(F.count(F.lit(1)).alias("_n"))
    return parents.join(counts, "code", "left").select(
        "code", "name", F.coalesce(F.col("_n"), F.lit(0)).alias("child_count")
    )


def drop_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children whose parent is known."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_semi").select(child.columns)


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """The rejected side of `drop_orphans`."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti").select(child.columns)


def precomputed_dept_stats(stats: DataFrame, code: str | None = None) -> DataFrame:
    rows = stats.filter(F.col("department_code") == code) if given(code) else stats
    return rows.orderBy("department_code")


def place_metrics(places: DataFrame, code: str = "code", area_unit: str = "km2") -> DataFrame:
    """Density and GDP per capita of every place."""
    area = ha_to_km2(F.col("area")) if area_unit == "ha" else F.col("area")
    return places.select(
        F.col(code).alias("code"),
        area.alias("area_km2"),
        density(F.col("population"), F.col("area"), area_unit).alias("density"),
        gdp_per_capita(F.col("gdp"), F.col("population")).alias("gdp_per_capita"),
    )
