"""Energy, health and generic indicator files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..schemas import CATEGORIES
from .delimited import read_positional


def _text(name: str):
    return C.strip_quotes(C.blank_to_null(F.col(name)))


def scan_energy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Energy diagnoses: commune code, energy label, emission label, year. Rows without code or label are dropped."""
    rows = read_positional(spark, path, width=4, min_fields=3).select(
        _text("c0").alias("code_insee"),
        _text("c1").alias("label"),
        _text("c2").alias("ges_label"),
        C.parse_int(C.strip_quotes(F.col("c3"))).alias("year"),
    )
    return rows.filter(~C.is_blank(F.col("code_insee")) & ~C.is_blank(F.col("label")))


def scan_energy_pages(spark: SparkSession, directory: str) -> DataFrame:
    """The same feed cut into page files; each file carries its own header."""
    return scan_energy(spark, directory)


def scan_health(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = read_positional(spark, path, width=12, min_fields=12, sep=";").select(
        C.parse_int(F.col("c0")).alias("year"),
        C.blank_to_null(F.col("c1")).alias("pathology"),
        C.blank_to_null(F.col("c8")).alias("dept"),
        C.parse_double(F.col("c11")).alias("prevalence"),
    )
    return rows.dropna()


def parse_indicators(spark: SparkSession, path: str | list[str], category: str) -> DataFrame:
    """Every line of a generic indicator file, typed, with `accepted`."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown indicator category {category!r}")
    rows = read_positional(spark, path, width=5, min_fields=0).select(
        F.lit("CITY").alias("geographic_level"),
        _text("c0").alias("geographic_code"),
        F.lit(category).alias("category"),
        _text("c3").alias("label"),
        C.parse_double(C.strip_quotes(F.col("c2"))).alias("value"),
        _text("c4").alias("unit"),
        C.parse_int(C.strip_quotes(F.col("c1"))).alias("year"),
    )
    accepted = (
        ~C.is_blank(F.col("geographic_code")) & F.col("value").isNotNull() & ~C.is_blank(F.col("label"))
    )
    return rows.withColumn("accepted", accepted)


def import_indicators(spark: SparkSession, path: str | list[str], category: str) -> DataFrame:
    """City-level facts; a row needs a code, a readable value and a label."""
    return parse_indicators(spark, path, category).filter("accepted").drop("accepted")
