"""Job run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sales import rows_per_year

IMPORT_JOB = "salesImport"


def _duration_ms(start: str, end: str) -> Column:
    return F.timestamp_diff("MILLISECOND", F.col(start), F.col(end))


def latest_runs(job_runs: DataFrame, job_name: str | None = None) -> DataFrame:
    """Newest completed run per year, of equal starts the one that ended last; the maximum combines before the shuffle."""
    done = job_runs.filter((F.col("status") == "COMPLETED") & F.col("end_time").isNotNull())
    if job_name is not None:
        done = done.filter(F.col("job_name") == job_name)
    last = done.groupBy("year").agg(F.max(F.struct("start_time", "end_time")).alias("_run"))
    return last.select("year", "_run.*").select(
        "year",
        F.col("start_time").alias("last_run_at"),
        _duration_ms("start_time", "end_time").alias("last_duration_ms"),
    )


def partition_status(tx: DataFrame, job_runs: DataFrame, job_name: str = IMPORT_JOB) -> DataFrame:
    """Rows per year with the newest completed import of that year."""
    runs = latest_runs(job_runs, job_name)
    return rows_per_year(tx).join(runs, "year", "left").orderBy(F.desc("year"))


def job_status(job_runs: DataFrame) -> DataFrame:
    """Per job: RUNNING while a started run has no end, plus start, status and duration of the newest run."""
    running = F.bool_or(F.col("status").isin("STARTED", "STARTING") & F.col("end_time").isNull())
    last = F.max(F.struct("start_time", "end_time", "status"))
    jobs = job_runs.groupBy("job_name").agg(running.alias("_running"), last.alias("_last"))
    return jobs.select("job_name", "_running", "_last.*").select(
        "job_name",
        F.when(F.col("_running"), "RUNNING").otherwise("IDLE").alias("state"),
        F.col("start_time").alias("last_run_at"),
        F.col("status").alias("last_status"),
        _duration_ms("start_time", "end_time").alias("last_duration_ms"),
    )
