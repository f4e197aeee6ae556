"""Table maintenance on Parquet tables partitioned by year or category."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import z_order
from ..operators.geo import BOX_COLUMNS, feature_bbox
from ..session import folder_names, fresh_path

FIRST_YEAR, LAST_YEAR = 2014, 2030


def check_year(year: int, allow_future: bool = False) -> int:
    """Refuse years without a partition, and years that have not begun."""
    if not FIRST_YEAR <= year <= LAST_YEAR:
        raise ValueError(f"year {year} is outside {FIRST_YEAR}..{LAST_YEAR}")
    if not allow_future and year > dt.date.today().year:
        raise ValueError(f"year {year} is in the future")
    return year


def _overwrite_partitions(df: DataFrame, path: str, key: str, sort: Sequence[str] = ()) -> int:
    """Replace only the partitions present in `df`; returns the rows written, counted while writing.

    The rebalance hint lets AQE cut a partition value that holds most rows into files of the advisory size.
    """
    written = Observation()
    spread = df.hint("rebalance", key)
    if sort:
        spread = spread.sortWithinPartitions(key, *sort)
    (
        spread.observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )
    return written.get["rows"]


def overwrite_years(df: DataFrame, table_path: str, sort: Sequence[str] = ()) -> int:
    """Replace every year present in a plain partitioned table; the other years keep their files."""
    return _overwrite_partitions(df, table_path, "year", sort)


def write_dept_stats(df: DataFrame, target: str | dict) -> None:
    """Overwrite the department statistics: Parquet path, or JDBC options (truncated, so keys survive)."""
    if isinstance(target, dict):
        options = {"dbtable": "dept_dvf_stats", "truncate": "true", **target}
        df.write.format("jdbc").options(**options).mode("overwrite").save()
    else:
        df.write.mode("overwrite").parquet(target)


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], overwrite: Sequence[str],
    order: str | None = None,
) -> DataFrame:
    """Insert new keys; on existing ones replace the `overwrite` columns (also by NULL), keep the rest.

    A key that comes twice counts once: the row with the greatest `order` (a position in the feed, or a load time), or
    without one the greatest row, since files have no order across tasks. The grouping and the join share one shuffle.
    """
    old = existing.select(*keys, F.struct(*existing.columns).alias("_old"))
    row = F.struct(*[c for c in incoming.columns if c != order])
    last = F.max_by(row, order) if order else F.max(row)
    new = incoming.groupBy(*keys).agg(last.alias("_new"))
    joined = old.join(new, list(keys), "full")

    def pick(column: str) -> Column:
        before = F.col(f"_old.{column}")
        if column not in incoming.columns:
            return before
        after = F.col(f"_new.{column}")
        takes_new = F.col("_new").isNotNull() if column in overwrite else F.col("_old").isNull()
        return F.when(takes_new, after).otherwise(before)

    rest = [c for c in existing.columns if c not in keys]
    return joined.select(*keys, *[pick(c).alias(c) for c in rest]).select(existing.columns)


def upsert_cities(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Communes: everything is renewed except the department of a known commune."""
    columns = ["name", "postal_code", "population", "area", "latitude", "longitude"]
    return upsert(existing, incoming, ["insee_code"], columns, order)


def upsert_names(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Regions and departments: known rows get the new name only."""
    return upsert(existing, incoming, ["code"], ["name"], order)


BOUNDARY_KEY = ("geographic_level", "geographic_code")


def upsert_boundaries(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Known boundaries get the new name and geometry. Of a boundary that comes twice the one with the greatest `order`
    wins, or without one the greatest digest; only digests are compared and sorted, not geometries."""
    row = [c for c in incoming.columns if c != order]
    ranked = incoming.withColumn("_rank", F.col(order) if order else F.sha2(F.to_json(F.struct(*row)), 256))
    winners = ranked.groupBy(*[F.col(k).alias(f"_{k}") for k in BOUNDARY_KEY]).agg(F.max("_rank").alias("_most"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in BOUNDARY_KEY]
    # rows that are alike throughout share their rank; they are counted once
    chosen = ranked.join(winners, [*same, F.col("_rank") == F.col("_most")]).select(*row).dropDuplicates(list(BOUNDARY_KEY))
    return upsert(existing, chosen, BOUNDARY_KEY, [c for c in ("name", "geometry", *BOX_COLUMNS) if c in existing.columns])


def write_boundaries(boundaries: DataFrame, path: str) -> None:
    """Store boundaries with the boxes of their geometries, in the order of the boxes' middles along the space-filling
    curve, so that a viewport skips row groups and parses no geometry."""
    boxed = feature_bbox(boundaries)
    place = z_order((F.col("min_y") + F.col("max_y")) / 2, (F.col("min_x") + F.col("max_x")) / 2)
    spread = boxed.repartitionByRange("geographic_level", place).sortWithinPartitions("geographic_level", place)
    spread.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


FACT_KEY = ("geographic_level", "geographic_code", "category", "label", "year")


def append_indicators(df: DataFrame, path: str) -> int:
    """Add facts; one that is there already (same level, code, category, label and year) is replaced, so a second run
    adds nothing. Only the categories present in `df` are rewritten. Returns the rows of those categories."""
    spark = df.sparkSession
    if not folder_names(spark, path):
        return _overwrite_partitions(df, path, "category")
    known = spark.read.parquet(path)
    touched = known.join(df.select("category").distinct(), "category", "left_semi").select(df.columns)
    new = df.select(*[F.col(c).alias(f"_{c}") for c in FACT_KEY])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FACT_KEY]
    merged = touched.join(new, same, "left_anti").unionByName(df)
    aside = fresh_path(spark, "indicators")  # a partition cannot be overwritten while it is read
    merged.write.parquet(aside)
    return _overwrite_partitions(spark.read.schema(merged.schema).parquet(aside), path, "category")


def append_reviews(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def apply_geocodes(tx: DataFrame, matches: DataFrame, now: dt.datetime) -> DataFrame:
    """Attempted rows get the time; those with a kept match also get coordinates. One answer per id is used."""
    answer = F.max(F.struct("resolved", "latitude", "longitude")).alias("_a")
    found = matches.groupBy("id").agg(answer).select(
        "id",
        F.col("_a.latitude").alias("_lat"),
        F.col("_a.longitude").alias("_lon"),
        F.col("_a.resolved").alias("_resolved"),
        F.lit(True).alias("_tried"),
    )
    stamp = F.col("geocoded_at") if "geocoded_at" in tx.columns else F.lit(None)
    return (
        tx.join(found, "id", "left")
        .withColumns(
            {
                "latitude": F.when(F.col("_resolved"), F.col("_lat")).otherwise(F.col("latitude")),
                "longitude": F.when(F.col("_resolved"), F.col("_lon")).otherwise(F.col("longitude")),
                "geocoded_at": F.when(F.col("_tried"), F.lit(now)).otherwise(stamp).cast("timestamp"),
            }
        )
        .select(*tx.columns, *([] if "geocoded_at" in tx.columns else ["geocoded_at"]))
    )


GEOCODE_COLUMNS = ("id", "year", "latitude", "longitude", "resolved", "geocoded_at")


def record_geocodes(matches: DataFrame, path: str, now: dt.datetime) -> int:
    """Append attempts to the table of answers, partitioned by year; sales files are not touched. Returns the rows."""
    answers = matches.withColumn("geocoded_at", F.lit(now).cast("timestamp")).select(*GEOCODE_COLUMNS)
    written = Observation()
    counted = answers.observe(written, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").partitionBy("year").parquet(path)
    return written.get["rows"]


def read_geocodes(spark: SparkSession, path: str) -> DataFrame:
    """The table of answers; empty before the first run."""
    schema = "id {}, latitude double, longitude double, resolved boolean, geocoded_at timestamp, year int"
    if not folder_names(spark, path):
        return spark.createDataFrame([], schema.format("bigint"))
    return spark.read.parquet(path)


def with_geocodes(tx: DataFrame, answers: DataFrame) -> DataFrame:
    """Sales with the answers merged in: attempted rows have the time, those with a kept match also coordinates.

    Where sales have a year they meet the answers by id and year, so that a filter on the year of the sales also picks
    the folders of answers that are read; a sale without its year has no answer then.
    """
    keys = ["id", *(["year"] if "year" in tx.columns else [])]
    best = F.max(F.struct("resolved", "latitude", "longitude", "geocoded_at")).alias("_a")
    found = answers.groupBy(*keys).agg(best).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_a.latitude").alias("_lat"), F.col("_a.longitude").alias("_lon"),
        F.col("_a.resolved").alias("_resolved"), F.col("_a.geocoded_at").alias("_at"))
    stamp = F.col("geocoded_at") if "geocoded_at" in tx.columns else F.lit(None).cast("timestamp")
    return tx.join(found, [F.col(k) == F.col(f"_{k}") for k in keys], "left").withColumns({
        "latitude": F.when(F.col("_resolved"), F.col("_lat")).otherwise(F.col("latitude")),
        "longitude": F.when(F.col("_resolved"), F.col("_lon")).otherwise(F.col("longitude")),
        "geocoded_at": F.coalesce("_at", stamp),
    }).select(*tx.columns, *([] if "geocoded_at" in tx.columns else ["geocoded_at"]))
