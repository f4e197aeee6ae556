"""Regions, departments, communes, geocoder answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from .json_arrays import read_json_records

_COMMUNE = (
    "code STRING, nom STRING, codesPostaux ARRAY<STRING>, codeDepartement STRING, population BIGINT, "
    "surface DOUBLE, centre STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>"
)


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool, position: str | None = None) -> DataFrame:
    if multi_line:
        rows = read_json_records(spark, path, schema, position=position)
    else:
        rows = spark.read.schema(schema).json(path)
    return rows.filter(~C.is_blank(F.col("code")) & ~C.is_blank(F.col("nom")))


def scan_regions_json(
    spark: SparkSession, path: str, multi_line: bool = True, position: str | None = None
) -> DataFrame:
    """`multi_line=True` reads files of one JSON array each, in splits; `False` reads JSON lines. `position` names a
    column with the place in an array feed, for `upsert(order=...)`."""
    rows = _json(spark, path, "code STRING, nom STRING", multi_line, position)
    return rows.select("code", F.col("nom").alias("name"), *([position] if position else []))


def scan_departments_json(
    spark: SparkSession, path: str, regions: DataFrame, multi_line: bool = True
) -> DataFrame:
    """Departments whose region is known."""
    rows = _json(spark, path, "code STRING, nom STRING, codeRegion STRING", multi_line).select(
        "code", F.col("nom").alias("name"), F.col("codeRegion").alias("region_code")
    )
    return rows.join(regions.select(F.col("code").alias("region_code")), "region_code", "left_semi").select(
        "code", "name", "region_code"
    )


def scan_communes_json(
    spark: SparkSession, path: str, departments: DataFrame, multi_line: bool = True
) -> DataFrame:
    """Communes of known departments; the first postal code; coordinates only when both are given."""
    point = F.col("centre.coordinates")
    complete = F.size(point) >= 2
    rows = _json(spark, path, _COMMUNE, multi_line).select(
        F.col("code").alias("insee_code"),
        F.col("nom").alias("name"),
        F.get("codesPostaux", F.lit(0)).alias("postal_code"),
        F.col("codeDepartement").alias("department_code"),
        "population",
        F.col("surface").alias("area"),
        F.when(complete, F.get(point, F.lit(1))).alias("latitude"),
        F.when(complete, F.get(point, F.lit(0))).alias("longitude"),
    )
    known = departments.select(F.col("code").alias("department_code"))
    return rows.join(known, "department_code", "left_semi").select(rows.columns)


def scan_city_mapping(spark: SparkSession, source: str | dict) -> DataFrame:
    """(insee_code, department_code) from Parquet, or from a database given as JDBC options."""
    if isinstance(source, dict):
        query = "(SELECT insee_code, department_code FROM cities) c"
        return spark.read.format("jdbc").options(**source).option("dbtable", query).load()
    return spark.read.parquet(source).select("insee_code", "department_code")


def scan_geocodes(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Geocoder answers; rows without a readable id are skipped, unreadable numbers are NULL."""
    raw = spark.read.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    rows = raw.select(
        F.trim(F.col("id")).try_cast(id_type).alias("id"),
        F.trim(F.col("latitude")).try_cast("double").alias("latitude"),
        F.trim(F.col("longitude")).try_cast("double").alias("longitude"),
        F.trim(F.col("result_score")).try_cast("double").alias("score"),
    )
    return rows.filter(F.col("id").isNotNull() & (F.col("id").cast("string") != ""))
