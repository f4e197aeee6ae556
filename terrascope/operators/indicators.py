"""Indicator facts from energy and health rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sales import given

# Energy classes.
ENERGY_LABELS = ["A", "B", "C", "D", "E", "F", "G"]


def energy_distribution(energy: DataFrame) -> DataFrame:
    """Share of each energy class per commune, always seven rows; other labels count in the denominator only.

    The counts of all classes come from one aggregation, so absent classes need no second join.
    """
    counts = energy.groupBy("code_insee").agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col("label") == label).alias(f"_n_{label}") for label in ENERGY_LABELS],
    )
    shares = F.array(
        *[
            F.struct(
                F.lit(f"DPE label {label}").alias("label"),
                (F.col(f"_n_{label}") * F.lit(100.0) / F.col("_total")).alias("value"),
            )
            for label in ENERGY_LABELS
        ]
    )
    return counts.select(
        F.lit("CITY").alias("geographic_level"),
        F.col("code_insee").alias("geographic_code"),
        F.lit("ENERGY").alias("category"),
        F.inline(shares),
    ).select(
        "geographic_level", "geographic_code", "category", "label", "value", F.lit("%").alias("unit"),
        F.lit(None).cast("int").alias("year"),
    )


def health_prevalence(health: DataFrame) -> DataFrame:
    """Unweighted mean prevalence per department, pathology and year."""
    means = health.groupBy("dept", "pathology", "year").agg(F.avg("prevalence").alias("value"))
    return means.select(
        F.lit("DEPARTMENT").alias("geographic_level"),
        F.col("dept").alias("geographic_code"),
        F.lit("HEALTH").alias("category"),
        F.concat(F.lit("Pathology: "), F.col("pathology")).alias("label"),
        "value",
        F.lit("%").alias("unit"),
        "year",
    )


def indicators_for(indicators: DataFrame, level: str, code: str, category: str | None = None) -> DataFrame:
    rows = indicators.filter((F.col("geographic_level") == level) & (F.col("geographic_code") == code))
    if given(category):
        rows = rows.filter(F.col("category") == category)
    columns = ["id", "category", "label", "value", "unit", "year"]
    return rows.select(*[c for c in columns if c in rows.columns])
