"""GeoJSON layers. Geometry stays JSON text until an operator needs its coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import geometry as G
from ..functions import metrics as M
from ..schemas import LEVELS
from .json_arrays import read_json_records

# Country properties that are kept.
KEPT_PROPERTIES = {
    "ISO_A3": "STRING", "ISO_A2": "STRING", "NAME": "STRING", "NAME_LONG": "STRING", "POP_EST": "DOUBLE",
    "GDP_MD": "DOUBLE", "CONTINENT": "STRING", "REGION_UN": "STRING", "SUBREGION": "STRING",
}


def _features(spark: SparkSession, path: str, properties: str, multi_line: bool) -> DataFrame:
    """Features of FeatureCollections: one collection per file, read in splits, or with `multi_line=False` one per line."""
    feature = f"properties: STRUCT<{properties}>, geometry: STRING"
    if multi_line:
        return read_json_records(spark, path, feature, features=True).select("properties.*", "geometry")
    documents = spark.read.schema(f"features ARRAY<STRUCT<{feature}>>").json(path)
    return documents.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")


def scan_boundaries(spark: SparkSession, path: str, level: str, multi_line: bool = True) -> DataFrame:
    """(geographic_level, geographic_code, name, geometry); features without code or name are dropped."""
    if level not in LEVELS:
        raise ValueError(f"unknown geographic level {level!r}")
    rows = _features(spark, path, "code: STRING, nom: STRING", multi_line)
    return rows.filter(~C.is_blank(F.col("code")) & ~C.is_blank(F.col("nom"))).select(
        F.lit(level).alias("geographic_level"),
        F.col("code").alias("geographic_code"),
        F.col("nom").alias("name"),
        "geometry",
    )


def scan_countries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Countries with nine kept properties plus code, name, population, gdp and spherical area."""
    wanted = {**KEPT_PROPERTIES, "ISO_A3_EH": "STRING", "ADM0_A3": "STRING"}
    rows = _features(spark, path, ", ".join(f"{k}: {v}" for k, v in wanted.items()), multi_line)
    area = G.geometry_area_km2(G.parse_geometry_column(F.col("geometry")))
    return rows.withColumn("_area", area).select(
        M.country_code(F.col("ISO_A3"), F.col("ISO_A3_EH"), F.col("ADM0_A3")).alias("code"),
        *[F.col(k).alias(k.lower()) for k in KEPT_PROPERTIES],
        F.col("POP_EST").cast("bigint").alias("population"),
        F.col("GDP_MD").alias("gdp"),
        F.when(F.col("_area") > 0, F.col("_area")).alias("area"),
        "geometry",
    )


def union_layers(*layers: DataFrame) -> DataFrame:
    """Stitch layers into one; columns missing in a layer are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
