"""Sales by year and the statistics kept with them, in a `YearStore`.

Parts of a year: `lots`, and what is derived from them: `city_stats` (additive commune statistics), `prices` (lots counted
by commune and price), `cells` (heat-map cells) and `sales` (the state of every sale, by slot). A year and its statistics
change in one switch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import z_order
from ..operators import summaries as U
from .releases import YearStore
from .tables import apply_geocodes, check_year

DERIVED = ("city_stats", "prices", "cells", "sales")
CITY_STATS = T.StructType([
    T.StructField("insee_code", T.StringType()), T.StructField("transaction_count", T.LongType()),
    T.StructField("total_price", T.DecimalType(20, 2)), T.StructField("total_residential_surface", T.DoubleType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("year", T.IntegerType())])


def _place(lots: DataFrame) -> list[Column]:
    """The order of lots inside a year: along the space-filling curve where they have a place, else by date."""
    if "latitude" in lots.columns and "longitude" in lots.columns:
        return [z_order(F.col("latitude"), F.col("longitude"))]
    return [F.col("mutation_date")] if "mutation_date" in lots.columns else []


def write_lots(store: YearStore, lots: DataFrame, folder: str) -> int:
    """Lots in ranges of the curve, so that files and row groups cover small boxes and others are skipped.

    The place is a column of its own while lots are sorted, or every comparison would compute it anew. A hash of the lot
    stands behind it in the ranges, or all lots without a place would be one range, sorted and written by one task.
    """
    place = _place(lots)
    if not place:
        return store.write("lots", lots, folder)
    keyed = lots.withColumns({"_place": place[0], "_lot": F.xxhash64(*lots.columns)})
    return store.write("lots", keyed, folder, sort=["_place"], by=["_place", "_lot"], aside=["_place", "_lot"])


def write_derived(store: YearStore, lots: DataFrame, folder: str, stamp: Column, years: Iterable[int]) -> None:
    """The derived parts of the lots of `years`. `lots` should be read back from the store, not recomputed; so are the states
    of sales, which commune statistics are made from."""
    store.write("sales", U.sale_states(lots), folder, inner=["slot"])
    touched = store.written_years("sales", folder, years)
    if touched:
        states = store.read("sales", folders={y: [folder] for y in touched})
        store.write("city_stats", U.added(U.contributions(states)).withColumn("updated_at", stamp), folder)
    store.write("prices", U.price_summary(lots), folder, sort=["insee_code"])
    if "latitude" in lots.columns:
        store.write("cells", U.heat_cells(lots), folder, sort=["level", "y", "x"], by=["level", "y"])


def _stamp(now: dt.datetime | None) -> Column:
    return F.lit(now) if now else F.current_timestamp()


def _named(store: YearStore, folder: str, year: int, parts: Iterable[str]) -> dict[str, list[str]]:
    return {p: [folder] if store.written_years(p, folder, [year]) else [] for p in parts}


def publish_years(store: YearStore, lots: DataFrame, years: Iterable[int], now: dt.datetime | None = None,
                  notes: dict | None = None) -> int:
    """Replace whole years, lots and statistics, each year in one switch. Returns the lots written."""
    years, folder = list(years), store.new_folder()
    rows = write_lots(store, lots.filter(F.col("year").isin(years)), folder)
    full = store.written_years("lots", folder, years)
    if full:
        written = store.read("lots", folders={y: [folder] for y in full})
        write_derived(store, written, folder, _stamp(now), full)
    for year in years:
        store.switch(year, _named(store, folder, year, ("lots", *DERIVED)), notes)
    return rows


def rebuild_statistics(store: YearStore, now: dt.datetime | None = None) -> None:
    """All derived parts from the lots of every year, which stay as they are."""
    years, folder = store.years(), store.new_folder()
    if not store.is_empty("lots"):
        write_derived(store, store.read("lots", years), folder, _stamp(now), years)
    for year in years:
        store.switch(year, _named(store, folder, year, DERIVED))


def compact_year(store: YearStore, year: int, now: dt.datetime | None = None) -> int:
    """The deliveries of a year written anew as one; notes stay. Returns the lots."""
    return publish_years(store, store.read("lots", [year]), [year], now)


def add_delivery(store: YearStore, lots: DataFrame, years: Iterable[int], key: str, now: dt.datetime | None = None) -> None:
    """Lots that come on top of what their years hold. Only the delivery is read, and of the years the states of sales in
    the slots that the delivery touches: old contributions of its sales are taken off, the new ones added.

    `key` names the delivery; one that a year has already is not added again.
    """
    years = [y for y in years if key not in store.head(y)["notes"].get("deliveries", [])]
    if not years:
        return
    folder = store.new_folder()
    write_lots(store, lots.filter(F.col("year").isin(years)), folder)
    full = store.written_years("lots", folder, years)
    heads = {y: store.head(y) for y in full}
    if full:
        written = store.read("lots", folders={y: [folder] for y in full})
        store.write("sales", U.sale_states(written), folder, inner=["slot"])
        touched = store.written_years("sales", folder, full)
        states = store.read("sales", folders={y: [folder] for y in touched}) if touched else None
        if states is not None:
            new = U.contributions(U.merged_states(states))
            known = {y: heads[y]["parts"].get("sales", []) for y in touched}
            if any(known.values()):
                slots = [r["slot"] for r in states.select("slot").distinct().collect()]  # SLOTS rows at most
                old = store.read("sales", folders=known).filter(F.col("slot").isin(slots)).join(
                    states.select("year", "mutation_id"), ["year", "mutation_id"], "left_semi")
                after = U.merged_states(old.unionByName(states))
                new = U.contributions(after).unionByName(U.contributions(U.merged_states(old), -1))
            store.write("city_stats", U.added(new).withColumn("updated_at", _stamp(now)), folder)
        store.write("prices", U.price_summary(written), folder, sort=["insee_code"])
        if "latitude" in written.columns:
            store.write("cells", U.heat_cells(written), folder, sort=["level", "y", "x"], by=["level", "y"])
    for year in years:
        held = store.head(year)
        new_parts = _named(store, folder, year, ("lots", *DERIVED))
        store.switch(
            year, {p: [*held["parts"].get(p, []), *f] for p, f in new_parts.items()},
            {"deliveries": [*held["notes"].get("deliveries", []), key]})


def read_sales(spark: SparkSession, root: str, years: Iterable[int] | None = None, schema: T.StructType | None = None) -> DataFrame:
    return YearStore(spark, root).read("lots", years, schema)


def read_city_stats(spark: SparkSession, root: str, years: Iterable[int] | None = None) -> DataFrame:
    """Commune statistics, the deliveries of a year added up; communes that no sale is left in are gone."""
    rows = YearStore(spark, root).read("city_stats", years, CITY_STATS)
    return U.added(rows).filter("transaction_count > 0")


def read_prices(spark: SparkSession, root: str, years: Iterable[int] | None = None) -> DataFrame:
    return YearStore(spark, root).read("prices", years)


def read_cells(spark: SparkSession, root: str, years: Iterable[int] | None = None) -> DataFrame:
    return YearStore(spark, root).read("cells", years)


def replace_sales_year(df: DataFrame, root: str, year: int) -> int:
    """Replace one year of lots in one switch; rows of other years are dropped first; no rows means an emptied year."""
    check_year(year)
    store = YearStore(df.sparkSession, root)
    folder = store.new_folder()
    rows = write_lots(store, df.filter(F.col("year") == year), folder)
    store.switch(year, {"lots": [folder] if rows else []})
    return rows


def truncate_year(spark: SparkSession, root: str, year: int) -> bool:
    """Empty one year, all its parts in one switch; other years are untouched. Returns whether it held anything."""
    store = YearStore(spark, root)
    parts = store.head(check_year(year, allow_future=True))["parts"]
    if not any(parts.values()):
        return False
    store.switch(year, {p: [] for p in parts}, {"deliveries": []})
    return True


def refresh_city_year(tx: DataFrame, root: str, year: int, now: dt.datetime | None = None) -> int:
    """Recompute one year of commune statistics from given lots and switch to them."""
    from ..operators.sales import city_year_stats

    check_year(year)
    stats = city_year_stats(tx, year).withColumn("updated_at", _stamp(now))
    return YearStore(tx.sparkSession, root).replace("city_stats", stats, [year])


def write_geocodes(spark: SparkSession, root: str, matches: DataFrame, now: dt.datetime) -> int:
    """Fold answers into the lots: the years that hold attempted rows are written anew, with their cells, and switched.
    Meant for years that are rewritten anyway; between those, `with_geocodes` merges on reading."""
    store = YearStore(spark, root)
    known = set(store.years())
    years = [r["year"] for r in matches.select("year").distinct().collect() if r["year"] in known]  # one row per year
    if not years:
        return 0
    folder = store.new_folder()
    rows = write_lots(store, apply_geocodes(store.read("lots", years), matches.drop("year"), now), folder)
    full = store.written_years("lots", folder, years)
    parts = ["lots"]
    written = store.read("lots", folders={y: [folder] for y in full})
    if not store.is_empty("cells"):
        store.write("cells", U.heat_cells(written), folder, sort=["level", "y", "x"], by=["level", "y"])
        parts.append("cells")
    for year in years:
        store.switch(year, _named(store, folder, year, parts))
    return rows
