"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_STEP = 0.001


def price_per_sqm(price: Column, surface: Column) -> Column:
    return F.when(surface > 0, price.cast("double") / surface)


def ha_to_km2(c: Column) -> Column:
    return c / F.lit(100.0)


def density(population: Column, area: Column, unit: str = "km2") -> Column:
    """People per km²; a missing or zero population or area gives NULL."""
    km2 = ha_to_km2(area) if unit == "ha" else area
    return F.when((population != 0) & (area != 0), population.cast("double") / km2)


def gdp_per_capita(gdp_millions: Column, population: Column) -> Column:
    return F.when(
        (gdp_millions != 0) & (population != 0), gdp_millions * F.lit(1_000_000.0) / population.cast("double")
    )


def country_code(iso: Column, iso_alt: Column, admin: Column) -> Column:
    """First code that is present; -99 marks a missing one."""
    missing = F.lit("-99")
    return F.coalesce(F.nullif(iso, missing), F.nullif(iso_alt, missing), F.nullif(admin, missing))


def java_round(c: Column, digits: int = 0) -> Column:
    """Round half towards +infinity."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)).cast("double") / scale


def grid_cell(c: Column, step: float = GRID_STEP) -> Column:
    return F.round(c / F.lit(step), 0) * F.lit(step)
