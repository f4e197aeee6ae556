"""Incremental table maintenance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sales import geocode_backlog, match_geocodes
from ..sinks.releases import YearStore
from ..sinks.sales_store import add_delivery, publish_years
from ..sinks.tables import FIRST_YEAR, LAST_YEAR, read_geocodes, record_geocodes, with_geocodes

GROUP_BYTES = 128 << 20  # landed files of several small years that are written together


def sales_refresh_stream(
    spark: SparkSession, landing: str, tables: dict[str, str], checkpoint: str, now: dt.datetime | None = None,
    keep_replaced: bool = True,
) -> None:
    """Keep the lots and statistics of every year in the store `tables["store"]` up to what has landed.

    Files land under `landing/year=YYYY/release=N/`, or under `landing/year=YYYY/` where there are no releases. The
    newest release of a year is the year: the first file of a newer one replaces it, later files of it are added, late
    ones of an older release are passed over. Only the batch's files are read; lots, statistics and the release are
    switched together, and the batch is noted with them, so a repeated batch changes nothing. Rows of years without a
    partition, or of years to come, are counted in `tables["rejected"]` where it is given.

    Small years are written together, others one after the other, so that no more than `GROUP_BYTES` or one year is shuffled
    at a time. What a newer release replaced stays for its readers; without `keep_replaced` it goes once its year is switched.
    """
    schema = spark.read.parquet(landing).schema
    last = min(LAST_YEAR, dt.date.today().year)
    release = F.col("release").cast("bigint") if "release" in schema.names else F.lit(0).cast("bigint")

    def refresh(batch: DataFrame, batch_id: int) -> None:
        session, key = batch.sparkSession, f"{checkpoint}#{batch_id}"
        counted = batch.groupBy("year", "release", "file").agg(
            F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")).collect()  # some rows per file
        found, refused = {}, {}

        def landed(number: int, years: list[int]) -> DataFrame:
            files = {r["file"] for r in counted if r["release"] == number and r["year"] in years}
            lots = session.read.schema(schema).option("basePath", landing).parquet(*sorted(_path(session, f) for f in files))
            return lots.filter(release == number).drop("release")

        def grouped(number: int, years: list[int]) -> list[list[int]]:
            groups, held = [], 0
            for year in sorted(years):
                size = sum(r["size"] for r in counted if r["release"] == number and r["year"] == year)
                if not groups or held + size > GROUP_BYTES:
                    groups.append([])
                    held = 0
                groups[-1].append(year)
                held += size
            return groups

        for r in counted:
            if r["year"] is not None and FIRST_YEAR <= r["year"] <= last:
                found[r["year"]] = max(r["release"], found.get(r["year"], r["release"]))
            else:
                refused[r["year"]] = refused.get(r["year"], 0) + r["rows"]
        if refused and "rejected" in tables:
            session.createDataFrame(list(refused.items()), "year int, rows long").write.mode("overwrite").parquet(
                f"{tables['rejected']}/batch={batch_id}")
        store = YearStore(session, tables["store"])
        known = {y: store.head(y)["notes"] for y in found}
        newer = [y for y, r in found.items() if key not in known[y].get("deliveries", []) and r > known[y].get("release", -1)]
        same = [y for y, r in found.items() if r == known[y].get("release", -1)]
        for release_number in sorted({found[y] for y in newer}):
            for years in grouped(release_number, [y for y in newer if found[y] == release_number]):
                publish_years(store, landed(release_number, years), years, now,
                              {"release": release_number, "deliveries": [key]})
                for year in () if keep_replaced else years:
                    store.prune(year)
        for release_number in sorted({found[y] for y in same}):
            for years in grouped(release_number, [y for y in same if found[y] == release_number]):
                add_delivery(store, landed(release_number, years), years, key, now)

    # the stream only says which files have come: a batch is read with all its columns by every step that uses it
    files = spark.readStream.schema(schema).parquet(landing).select(
        "year", release.alias("release"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    (
        files.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def _path(spark: SparkSession, uri: str) -> str:
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)).toString()


def drain_geocoding(
    spark: SparkSession, table: str | DataFrame, cities: DataFrame, geocodes: DataFrame, answers: str, now: dt.datetime,
) -> int:
    """Match the whole backlog of addresses in one pass and append the attempts to the table `answers`.

    Addresses tried before are no longer in the backlog, so a run that stops early is simply run again. The sales files
    stay as they are. `table` is the lots, or the path of a plain table of them. Returns the addresses tried.
    """
    lots = spark.read.parquet(table) if isinstance(table, str) else table
    tx = with_geocodes(lots, read_geocodes(spark, answers))
    waiting = geocode_backlog(tx, cities).select("id", "year").distinct()
    return record_geocodes(match_geocodes(waiting, geocodes), answers, now)
