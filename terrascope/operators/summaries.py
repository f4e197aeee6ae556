"""Additive summaries of sales: prices by commune, heat-map cells, and contributions of single sales.

All three are sums, so rows of several deliveries lie next to one another and are added when they are read: nothing that
was summed before is read again when a year grows, and any scope of communes and years is added up from the summary
alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import code_number, code_text
from ..functions.metrics import GRID_STEP, grid_cell, price_per_sqm
from .ranking import median_of_counts
from .sales import (
    HEAT_METRICS, MAX_PRICE, MAX_SURFACE, MIN_PRICE, MIN_SURFACE, RESIDENTIAL, SALE_NATURES, dept_stats_of_counts, in_viewport,
    stats_columns, stats_of_counts,
)

# --- prices by commune and year -------------------------------------------------------------------------------


def price_summary(tx: DataFrame) -> DataFrame:
    """Lots counted by (commune, year, price), with the sums that means need. `price` is NULL for lots without a valid
    one. Exact: medians of any scope come from these counts."""
    price = F.when(F.col("property_value") > 0, F.col("property_value"))
    surface = F.when(F.col("built_surface") > 0, F.col("built_surface"))
    ratio = price.cast("double") / surface
    return tx.groupBy(F.col("city_insee_code").alias("insee_code"), "year", price.alias("price")).agg(
        F.count(F.lit(1)).alias("lots"), F.count(surface).alias("surfaces"), F.sum(surface).alias("surface_sum"),
        F.count(ratio).alias("ratios"), F.sum(ratio).alias("ratio_sum"))


def summary_scope(
    summary: DataFrame, cities: DataFrame | None = None, *, city: str | None = None, dept: str | None = None,
    region: str | None = None, year: int | None = None, departments: DataFrame | None = None,
) -> DataFrame:
    """The summary's rows of one scope."""
    rows = summary if year is None else summary.filter(F.col("year") == year)
    if city is not None:
        rows = rows.filter(F.col("insee_code") == city)
    if dept is not None or region is not None:
        places = cities if dept is None else cities.filter(F.col("department_code") == dept)
        if region is not None:
            wanted = departments.filter(F.col("region_code") == region).select(F.col("code").alias("department_code"))
            places = places.join(wanted, "department_code", "left_semi")
        rows = rows.join(places.select("insee_code"), "insee_code", "left_semi")
    return rows


def stats_of_summary(summary: DataFrame, keys: Sequence[str], mapping: DataFrame | None = None) -> DataFrame:
    """`transaction_stats_by` from a summary that has the keys: communes, years, or what was joined to them; with `mapping`
    the keys are columns that it gives the summary's communes."""
    priced = F.col("price").isNotNull()
    if mapping is not None:
        counted = summary.filter(F.col("insee_code").isNotNull()).groupBy("insee_code", F.col("price").alias("_v")).agg(
            F.coalesce(F.sum(F.when(priced, F.col("lots"))), F.lit(0)).alias("_n"), F.sum("lots").alias("_lots"),
            F.sum("surfaces").alias("_surfaces"), F.sum("surface_sum").alias("_surface_sum"),
            F.sum("ratios").alias("_ratios"), F.sum("ratio_sum").alias("_ratio_sum"))
        return stats_of_counts(counted, mapping, keys)
    totals = summary.groupBy(*keys).agg(
        F.coalesce(F.sum("lots"), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.when(priced, F.col("lots"))), F.lit(0)).alias("_priced"),
        F.sum(F.col("price") * F.col("lots").cast("decimal(18,0)")).cast("decimal(25,2)").alias("_sum"), F.min("price").alias("_min"),
        F.max("price").alias("_max"), (F.sum("surface_sum") / F.nullif(F.sum("surfaces"), F.lit(0))).alias("_mean_surface"),
        (F.sum("ratio_sum") / F.nullif(F.sum("ratios"), F.lit(0))).alias("_mean_ratio"))
    counted = summary.filter(priced).groupBy(*keys, F.col("price").alias("_v")).agg(F.sum("lots").alias("_n"))
    return stats_columns(totals, median_of_counts(counted, keys), keys)


def dept_stats_of_summary(summary: DataFrame, mapping: DataFrame) -> DataFrame:
    """`dept_sales_stats` from the summary."""
    rows = summary.filter("price IS NOT NULL AND insee_code IS NOT NULL")
    return dept_stats_of_counts(rows.groupBy("insee_code", F.col("price").alias("_v")).agg(
        F.sum("lots").alias("_n"), F.sum("ratio_sum").alias("_r"), F.sum("ratios").alias("_rn")), mapping)


# --- heat-map cells -------------------------------------------------------------------------------------------

LEVELS = (0, 1, 2, 3)  # cells of 1, 0.1, 0.01 and 0.001 degrees


def _step(level: int) -> float:
    return GRID_STEP if level == 3 else float(f"1e-{level}")


def heat_cells(tx: DataFrame) -> DataFrame:
    """Priced lots with a place, summed by (year, level, cell): one pass over the lots, combined map-side.

    Beside the sums stands the box of the lots themselves, which tells whether a cell lies in a viewport as a whole.
    """
    seen = tx.filter((F.col("property_value") > 0) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    ratio = F.when(F.col("built_surface") > 0, F.col("property_value").cast("double") / F.col("built_surface"))
    cells = F.array(*[F.struct(
        F.lit(k).alias("level"), grid_cell(F.col("latitude"), _step(k)).alias("y"), grid_cell(F.col("longitude"), _step(k)).alias("x"),
    ) for k in LEVELS])
    rows = seen.select(
        "year", "property_value", "latitude", "longitude", ratio.alias("ratio"), F.inline(cells))
    return rows.groupBy("year", "level", "y", "x").agg(
        F.count(F.lit(1)).alias("lots"), F.sum("property_value").alias("price_sum"), F.count("ratio").alias("ratios"),
        F.sum("ratio").alias("ratio_sum"), F.min("latitude").alias("south"), F.max("latitude").alias("north"),
        F.min("longitude").alias("west"), F.max("longitude").alias("east"))


def _cell_value(metric: str) -> tuple[Column, str]:
    if metric not in HEAT_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    samples = "ratios" if metric == "AVERAGE_PRICE_PER_SQM" else "lots"
    value = {"AVERAGE_PRICE": F.col("price_sum").cast("double") / F.col("lots"),
             "AVERAGE_PRICE_PER_SQM": F.col("ratio_sum") / F.col("ratios"),
             "TRANSACTION_COUNT": F.col("lots").cast("double")}[metric]
    return value, samples


def heat_points_of_cells(
    cells: DataFrame, box: tuple[float, float, float, float], metric: str, level: int = 3, rows: int | None = None,
    lots: DataFrame | None = None,
) -> DataFrame:
    """`heat_points` from stored cells of one level. The filter on level and box reaches the scan.

    Lots are read only for cells that cross the border of the viewport, and only those near the border; where `lots` is
    not given, such a cell counts as a whole.
    """
    value, samples = _cell_value(metric)
    south, west, north, east = box
    if north <= south or east <= west:
        found = cells.limit(0)
    else:
        found = cells.filter((F.col("level") == level) & (F.col("north") >= south) & (F.col("south") <= north)
                             & (F.col("east") >= west) & (F.col("west") <= east))
    inside = (F.col("south") >= south) & (F.col("north") <= north) & (F.col("west") >= west) & (F.col("east") <= east)
    if lots is not None:
        crossing = found.filter(~inside).select("y", "x").distinct()
        if crossing.limit(1).count():
            step = _step(level)
            strip = ((F.col("latitude") <= south + step) | (F.col("latitude") >= north - step)
                     | (F.col("longitude") <= west + step) | (F.col("longitude") >= east - step))
            near = heat_cells(in_viewport(lots, *box).filter(strip)).filter(F.col("level") == level)
            # cells of one delivery may cross where those of another do not: the lots of all replace them all
            found = found.join(crossing, ["y", "x"], "left_anti").unionByName(near.join(crossing, ["y", "x"], "left_semi"))
        else:
            found = found.filter(inside)
    sums = found.groupBy("y", "x").agg(*[F.sum(c).alias(c) for c in ("lots", "price_sum", "ratios", "ratio_sum")])
    points = sums.filter(F.col(samples) > 0).select(
        F.col("y").alias("latitude"), F.col("x").alias("longitude"), value.alias("value"), F.col(samples).alias("samples"))
    return points if rows is None else points.orderBy(F.desc("samples"), "latitude", "longitude").limit(rows)


# --- what a single sale contributes ---------------------------------------------------------------------------

SLOTS = 16


def sale_states(tx: DataFrame) -> DataFrame:
    """(year, slot, mutation_id) with greatest price, residential surface and greatest commune of its lots, as
    `dedup_mutations` takes them; states of one sale are merged by maximum, sum and maximum."""
    home = F.col("property_type").isin(RESIDENTIAL)
    plausible = F.col("built_surface").between(MIN_SURFACE, MAX_SURFACE)
    counted = tx.filter(
        F.col("mutation_id").isNotNull() & F.col("mutation_nature").isin(SALE_NATURES)
        & F.col("property_value").between(MIN_PRICE, MAX_PRICE) & (F.year("mutation_date") == F.col("year")))
    return counted.groupBy("year", "mutation_id").agg(
        F.max("property_value").alias("price"), F.sum(F.when(home & plausible, F.col("built_surface"))).alias("surface"),
        F.max(F.when(home, code_number(F.col("city_insee_code")))).alias("code"),
    ).withColumn("slot", F.pmod(F.hash("mutation_id"), F.lit(SLOTS)))


def merged_states(states: DataFrame) -> DataFrame:
    return states.groupBy("year", "mutation_id").agg(
        F.max("price").alias("price"), F.sum("surface").alias("surface"), F.max("code").alias("code"))


def contributions(states: DataFrame, sign: int = 1) -> DataFrame:
    """(insee_code, year, transaction_count, total_price, total_residential_surface) of merged states, before adding."""
    return states.filter("surface IS NOT NULL AND code IS NOT NULL").select(
        code_text(F.col("code")).alias("insee_code"), "year", F.lit(sign).cast("bigint").alias("transaction_count"),
        (F.col("price") * sign).cast("decimal(20,2)").alias("total_price"),
        (F.col("surface") * sign).alias("total_residential_surface"))


def added(parts: DataFrame) -> DataFrame:
    """City-year statistics from contributions or from statistics of several deliveries."""
    more = [F.max("updated_at").alias("updated_at")] if "updated_at" in parts.columns else []
    return parts.groupBy("insee_code", "year").agg(
        F.sum("transaction_count").alias("transaction_count"), F.sum("total_price").cast("decimal(20,2)").alias("total_price"),
        F.sum("total_residential_surface").alias("total_residential_surface"), *more)
