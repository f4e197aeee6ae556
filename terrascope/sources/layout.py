"""How many tasks a scan gives."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Spread the rows of a file scan over all task slots when it has fewer splits than slots.

    Gzip files, archives and Parquet files of one row group cannot be split; large tables have many splits and
    are left alone. Meant for scans only: asking a plan with shuffles for its partitions would run it.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
