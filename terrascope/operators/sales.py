"""Searches, joins and statistics over sales."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import code_number, code_text
from ..functions.metrics import GRID_STEP, grid_cell, price_per_sqm
from .paging import PAGE_SIZE, page
from .ranking import is_finite, median_over_places, upper_median

# Which sales count, and the bounds of a plausible sale.
SALE_NATURES = ["Vente", "Vente en l'état futur d'achèvement"]
RESIDENTIAL = ["MAISON", "APPARTEMENT"]
MIN_PRICE, MAX_PRICE = 10_000, 5_000_000
MIN_SURFACE, MAX_SURFACE = 9, 1000
_PLACE = "_place"
PLACES = 64  # of one code, in one row beside its lots
HEAT_METRICS = ("AVERAGE_PRICE", "AVERAGE_PRICE_PER_SQM", "TRANSACTION_COUNT")


def given(value) -> bool:
    """Blank text filters nothing."""
    return value is not None and str(value).strip() != ""


def in_year(year: int, date: str = "mutation_date") -> Column:
    """Half-open date range: prunes row groups, unlike year(date) = y."""
    return (F.col(date) >= F.lit(dt.date(year, 1, 1))) & (F.col(date) < F.lit(dt.date(year + 1, 1, 1)))


def of_year(tx: DataFrame, year: int | None) -> DataFrame:
    """Filter on the partition column too, where the table has one."""
    if year is None:
        return tx
    rows = tx.filter(in_year(year))
    return rows.filter(F.col("year") == year) if "year" in tx.columns else rows


def attach_department(sales: DataFrame, mapping: DataFrame) -> DataFrame:
    """Department of every sale; sales of unknown communes are dropped. Of `department_places` it keeps the number too."""
    if "_times" in mapping.columns:  # one row for each department
        return sales.join(mapping.select("insee_code", "department_code", "_times"), "insee_code")
    return with_places(sales, mapping.select("insee_code", "department_code"), "insee_code", "inner")


def with_places(lots: DataFrame, places: DataFrame, key: str, how: str) -> DataFrame:
    """The join (`inner` or `left`) of lots with the places of their code, for codes that stand for many of them.

    Lots meet blocks of up to `PLACES` places of one code and are multiplied behind the join: columns of a lot are computed
    once for a block, while a join computes them for each of its rows. Blocks are cut where rows of a code follow one another
    in a task, so any order gives the same join.
    """
    given_places = places.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)
    place = F.struct(*[c for c in places.columns if c != key])
    # a place of a block has a number of its own below PLACES, so a block cannot grow over it
    slots = [F.max(F.when(F.col("_at") % PLACES == k, place)) for k in range(PLACES)]
    blocks = given_places.withColumn("_at", F.monotonically_increasing_id()).groupBy(
        key, F.floor(F.col("_at") / PLACES).alias("_block")).agg(F.array_compact(F.array(*slots)).alias("_places")).drop("_block")
    spread = F.inline("_places") if how == "inner" else F.inline_outer("_places")
    return lots.join(blocks, key, how).select(key, *[c for c in lots.columns if c != key], spread)


def department_places(mapping: DataFrame) -> DataFrame:
    """(insee_code, department_code, _times): a code may stand for several communes, also of several departments, and
    `attach_department` gives a sale once for each. Sums over counted lots need each department once, with their number."""
    return mapping.groupBy("insee_code", "department_code").agg(F.count(F.lit(1)).alias("_times"))


# --- searches -------------------------------------------------------------------------------------------------


def filter_transactions(
    tx: DataFrame, cities: DataFrame | None = None, *, city=None, dept=None, year=None, min_price=None,
    max_price=None, property_type=None, region=None, min_rooms=None, min_surface=None,
    departments: DataFrame | None = None,
) -> DataFrame:
    """Sales matching every given condition."""
    rows = of_year(tx, year)
    if given(city):
        rows = rows.filter(F.col("city_insee_code") == city)
    for column, low in (("property_value", min_price), ("room_count", min_rooms), ("built_surface", min_surface)):
        if low is not None:
            rows = rows.filter(F.col(column) >= low)
    if max_price is not None:
        rows = rows.filter(F.col("property_value") <= max_price)
    if given(property_type):
        rows = rows.filter(F.col("property_type") == property_type)
    if given(dept) or given(region):
        places = cities
        if given(dept):
            places = places.filter(F.col("department_code") == dept)
        if given(region):
            wanted = departments.filter(F.col("region_code") == region)
            places = places.join(wanted.select(F.col("code").alias("department_code")), "department_code", "left_semi")
        places = places.select(F.col("insee_code").alias("city_insee_code"))
        rows = rows.join(places, "city_insee_code", "left_semi")
    return rows


def transaction_summary(tx: DataFrame, cities: DataFrame) -> DataFrame:
    """Summary columns with the commune name."""
    return _summary_columns(with_places(tx, _city_names(cities), "city_insee_code", "left"))


def _city_names(cities: DataFrame) -> DataFrame:
    return cities.select(F.col("insee_code").alias("city_insee_code"), F.col("name").alias("city_name"))


def _summary_columns(joined: DataFrame) -> DataFrame:
    columns = [
        "id", "mutation_date", "mutation_nature", "property_value", "postal_code", "city_name", "city_insee_code",
        "property_type", "built_surface", "room_count", "land_surface",
    ]
    return joined.select(*[c for c in [*columns, _PLACE] if c in joined.columns])


def search_transactions(
    tx: DataFrame, cities: DataFrame, *, number: int = 0, size: int = PAGE_SIZE,
    sort: Sequence[str | Column] = ("id",), **filters,
) -> DataFrame:
    """One page of matching sales; only the page is joined to the commune names, and it keeps its order."""
    order = [*sort, "id"]
    rows = page(filter_transactions(tx, cities, **filters), order, number, size)
    placed = rows.withColumn(_PLACE, F.row_number().over(W.orderBy(*order)))  # at most `size` rows
    named = placed.join(_city_names(cities), "city_insee_code", "left")  # too few lots for blocks of communes
    return _summary_columns(named).orderBy(_PLACE).drop(_PLACE)


def transaction_detail(tx: DataFrame, cities: DataFrame, id) -> DataFrame:
    places = cities.select(
        F.col("insee_code").alias("city_insee_code"), F.col("name").alias("city_name"), "department_code"
    )
    columns = [
        "id", "mutation_date", "mutation_nature", "property_value", "street_number", "street_type", "postal_code",
        "city_name", "city_insee_code", "department_code", "property_type", "built_surface", "room_count",
        "land_surface", "section", "plan_number", "lot_count", "price_per_sqm",
    ]
    ratio = price_per_sqm(F.col("property_value"), F.col("built_surface"))
    rows = tx.filter(F.col("id") == id).join(places, "city_insee_code", "left").withColumn("price_per_sqm", ratio)
    return rows.select(*[c for c in columns if c in rows.columns])


# --- statistics -----------------------------------------------------------------------------------------------


def dept_sales_stats(sales: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per department over priced lots: count, mean price, mean €/m², exact lower median. Prices that are no finite
    positive number do not count; others are taken as they are, whatever their size and their digits.

    Lots are counted once per (commune, price), before they meet their departments; counts, sums and median all come
    from that.
    """
    priced = sales.filter((F.col("price") > 0) & is_finite(F.col("price")) & F.col("insee_code").isNotNull())
    ratio = price_per_sqm(F.col("price"), F.col("surface"))
    return dept_stats_of_counts(priced.groupBy("insee_code", F.col("price").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(ratio).alias("_r"), F.count(ratio).alias("_rn")), mapping)


def dept_stats_of_counts(counted: DataFrame, mapping: DataFrame) -> DataFrame:
    """`dept_sales_stats` from lots counted by commune and price: (insee_code, _v, _n), sum `_r` and number `_rn` of ratios."""
    times = F.col("_times")
    found = median_over_places(counted, department_places(mapping), "insee_code", ["department_code"], lower=True, sums=[
        F.sum(F.col("_n") * times).alias("transaction_count"),
        F.sum(F.col("_v").cast("double") * F.col("_n") * times).alias("_price"),
        F.sum(F.col("_r") * times).alias("_ratio"), F.sum(F.col("_rn") * times).alias("_ratios")])
    return found.select(
        "department_code", "transaction_count",
        (F.col("_price") / F.col("transaction_count")).alias("avg_price"),
        F.when(F.col("_ratios") > 0, F.col("_ratio") / F.col("_ratios")).alias("avg_price_per_sqm"),
        F.col("median").cast("double").alias("median_price"))


def dedup_mutations(tx: DataFrame, year: int | None = None) -> DataFrame:
    """One row per sale: its price, its residential surface, its commune, its year.

    Lots of one sale repeat the price of the whole sale, so it must be counted once. Partial aggregation
    combines the lots before the shuffle, also when one id holds a large share of them.
    """
    home = F.col("property_type").isin(RESIDENTIAL)
    plausible = F.col("built_surface").between(MIN_SURFACE, MAX_SURFACE)
    return (
        of_year(tx, year)
        .filter(
            F.col("mutation_id").isNotNull()
            & F.col("mutation_nature").isin(SALE_NATURES)
            & F.col("property_value").between(MIN_PRICE, MAX_PRICE)
        )
        .groupBy("mutation_id", F.year("mutation_date").alias("year"))
        .agg(
            F.max("property_value").alias("price"),
            F.sum(F.when(home & plausible, F.col("built_surface"))).alias("surface"),
            F.max(F.when(home, code_number(F.col("city_insee_code")))).alias("_code"),
        )
        .filter(F.col("surface").isNotNull() & F.col("_code").isNotNull())
        .select("mutation_id", "year", "price", "surface", code_text(F.col("_code")).alias("city_insee_code"))
    )


def city_year_stats(tx: DataFrame, year: int | None = None) -> DataFrame:
    """Additive commune statistics per year."""
    return (
        dedup_mutations(tx, year)
        .groupBy(F.col("city_insee_code").alias("insee_code"), "year")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.sum("price").cast("decimal(20,2)").alias("total_price"),
            F.sum("surface").alias("total_residential_surface"),
        )
    )


def transaction_stats_by(tx: DataFrame, keys: Sequence[str], mapping: DataFrame | None = None) -> DataFrame:
    """Price and surface statistics of every group; a group without a valid price is all zeros.

    With `mapping` the keys are columns that it gives the lots by their insee_code, as `attach_department` would; lots are
    counted by (commune, price) first and only the counts meet it.
    """
    price = F.when(F.col("property_value") > 0, F.col("property_value").cast("decimal(15,2)"))
    surface = F.when(F.col("built_surface") > 0, F.col("built_surface"))
    rows = tx.withColumns({"_price": price, "_surface": surface})
    if mapping is not None:
        ratio = F.col("_price").cast("double") / F.col("_surface")
        counted = rows.filter(F.col("insee_code").isNotNull()).groupBy("insee_code", F.col("_price").alias("_v")).agg(
            F.count("_price").alias("_n"), F.count(F.lit(1)).alias("_lots"), F.count("_surface").alias("_surfaces"),
            F.sum("_surface").alias("_surface_sum"), F.count(ratio).alias("_ratios"), F.sum(ratio).alias("_ratio_sum"))
        return stats_of_counts(counted, mapping, keys)
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("_price").alias("_priced"),
        F.sum("_price").alias("_sum"),
        F.min("_price").alias("_min"),
        F.max("_price").alias("_max"),
        F.avg("_surface").alias("_mean_surface"),
        F.avg(F.col("_price").cast("double") / F.col("_surface")).alias("_mean_ratio"),
    )
    return stats_columns(totals, upper_median(rows, keys, "_price"), keys)


def stats_of_counts(counted: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`transaction_stats_by` from lots counted by commune and price: (insee_code, _v, _n, _lots) with the number and sum of
    surfaces and ratios. `_v` is NULL and `_n` 0 for lots without a valid price, so they hold no rank."""
    times, places = F.col("_times"), department_places(mapping)

    def weighed(c: str) -> Column:
        return F.sum(F.col(c) * times)

    totals = attach_department(counted, places).groupBy(*keys).agg(
        F.coalesce(weighed("_lots"), F.lit(0)).alias("_rows"), F.coalesce(weighed("_n"), F.lit(0)).alias("_priced"),
        F.sum(F.col("_v") * (F.col("_n") * times).cast("decimal(18,0)")).cast("decimal(25,2)").alias("_sum"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        (weighed("_surface_sum") / F.nullif(weighed("_surfaces"), F.lit(0))).alias("_mean_surface"),
        (weighed("_ratio_sum") / F.nullif(weighed("_ratios"), F.lit(0))).alias("_mean_ratio"))
    return stats_columns(totals, median_over_places(counted, places, "insee_code", keys), keys)


def stats_columns(totals: DataFrame, medians: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The published columns from the totals and the median of every group."""
    if keys:
        medians = medians.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "median")
        same = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]
        totals = totals.join(medians, same, "left")
    else:
        totals = totals.withColumn("median", medians.select("median").scalar())

    def money(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)).cast("decimal(15,2)")

    def number(c: Column) -> Column:
        return F.when(F.col("_priced") > 0, F.coalesce(c, F.lit(0.0))).otherwise(0.0)

    mean = F.round(F.col("_sum") / F.col("_priced").cast("decimal(18,0)"), 2)
    return totals.select(
        *keys,
        F.when(F.col("_priced") > 0, F.col("_rows")).otherwise(F.lit(0)).cast("bigint").alias("total_transactions"),
        money(F.when(F.col("_priced") > 0, mean)).alias("average_price"),
        money(F.col("median")).alias("median_price"),
        money(F.col("_min")).alias("min_price"),
        money(F.col("_max")).alias("max_price"),
        number(F.col("_mean_surface")).alias("average_surface"),
        number(F.col("_mean_ratio")).alias("average_price_per_sqm"),
    )


def transaction_stats(
    tx: DataFrame, cities: DataFrame, city=None, dept=None, year=None, region=None,
    departments: DataFrame | None = None,
) -> DataFrame:
    """The same for one scope, always one row. Without any scope it is the whole table."""
    rows = filter_transactions(tx, cities, city=city, dept=dept, year=year, region=region, departments=departments)
    return transaction_stats_by(rows, [])


def price_overview(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(label, value) rows of scopes that have sales."""
    def entry(label, column):
        return F.struct(F.lit(label).alias("label"), F.col(column).alias("value"))

    entries = F.array(
        entry("Average", "average_price"), entry("Median", "median_price"),
        entry("Min", "min_price"), entry("Max", "max_price"),
    )
    return stats.filter(F.col("total_transactions") > 0).select(*keys, F.inline(entries))


def rows_per_year(tx: DataFrame) -> DataFrame:
    return tx.groupBy("year").agg(F.count(F.lit(1)).alias("row_count"))


def in_viewport(
    df: DataFrame, south: float, west: float, north: float, east: float, max_degrees: float | None = None
) -> DataFrame:
    """Rows inside the box, borders included; inverted boxes, and those over `max_degrees` where it is given, hold
    nothing."""
    large = max_degrees is not None and max(north - south, east - west) > max_degrees
    if north <= south or east <= west or large:
        return df.limit(0)
    return df.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def heat_points(
    tx: DataFrame, box: tuple[float, float, float, float], metric: str, step: float = GRID_STEP,
    rows: int | None = None,
) -> DataFrame:
    """Grid cells of the viewport with a mean price, mean €/m² or count; with `rows` the densest cells only."""
    if metric not in HEAT_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    seen = in_viewport(tx, *box).filter(F.col("property_value") > 0)
    if metric == "AVERAGE_PRICE_PER_SQM":
        seen = seen.filter(F.col("built_surface") > 0)
    price = F.col("property_value").cast("double")
    value = {
        "AVERAGE_PRICE": F.avg(price),
        "AVERAGE_PRICE_PER_SQM": F.avg(price / F.col("built_surface")),
        "TRANSACTION_COUNT": F.count(F.lit(1)).cast("double"),
    }[metric]
    cells = (
        seen.groupBy(
            grid_cell(F.col("latitude"), step).alias("latitude"), grid_cell(F.col("longitude"), step).alias("longitude")
        )
        .agg(value.alias("value"), F.count(F.lit(1)).alias("samples"))
        .filter(F.col("value").isNotNull())
    )
    if rows is None:
        return cells
    return cells.orderBy(F.desc("samples"), "latitude", "longitude").limit(rows)


# --- geocoding ------------------------------------------------------------------------------------------------


def _waiting(tx: DataFrame) -> DataFrame:
    rows = tx.filter(F.col("latitude").isNull())
    return rows.filter(F.col("geocoded_at").isNull()) if "geocoded_at" in tx.columns else rows


def geocode_backlog(tx: DataFrame, cities: DataFrame, limit: int | None = None) -> DataFrame:
    """Addresses never tried; with `limit` those of the lowest ids."""
    names = cities.filter(F.col("name").isNotNull()).select(
        F.col("insee_code").alias("city_insee_code"), F.col("name").alias("city_name")
    )
    rows = _waiting(tx).filter(F.col("postal_code").isNotNull()).join(names, "city_insee_code")
    columns = ["id", "year", "street_number", "street_type", "postal_code", "city_name"]
    waiting = rows.select(*[c for c in columns if c in rows.columns])
    return waiting if limit is None else waiting.orderBy("id").limit(limit)


def geocode_backlog_size(tx: DataFrame) -> DataFrame:
    return _waiting(tx).agg(F.count(F.lit(1)).alias("backlog"))


def match_geocodes(inputs: DataFrame, geocodes: DataFrame, min_score: float = 0.4) -> DataFrame:
    """Answer of every input, NULL when there is none; `resolved` when it has coordinates and a fair score.

    Should an id be answered twice, its best answer is used, so that inputs are never multiplied.
    """
    best = geocodes.groupBy("id").agg(F.max(F.struct("score", "latitude", "longitude")).alias("_a"))
    kept = F.col("score").isNull() | (F.col("score") >= min_score)
    complete = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return (
        inputs.join(best, "id", "left")
        .select(inputs["*"], "_a.latitude", "_a.longitude", "_a.score")
        .withColumn("resolved", complete & kept)
    )


def price_per_sqm_rows(tx: DataFrame) -> DataFrame:
    return tx.select("id", price_per_sqm(F.col("property_value"), F.col("built_surface")).alias("price_per_sqm"))


def import_audit(parsed: DataFrame) -> DataFrame:
    """Accepted and skipped rows of a parsed import, in one pass."""
    return parsed.agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("skipped")
    )


