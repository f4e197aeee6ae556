"""Event feeds as Structured Streaming queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import is_blank
from ..schemas import JOB_EVENT, WEB_VITAL
from ..session import folder_names, remove_folder

_BAD = "_unreadable"
RECENT = 20


def _payloads(spark: SparkSession, src) -> DataFrame:
    """A streaming frame with one text column `value`: JSON lines in a folder, Kafka options, or given as is."""
    if isinstance(src, DataFrame):
        return src
    if isinstance(src, dict):
        raw = spark.readStream.format("kafka").options(**src).load()
        return raw.select(F.col("value").cast("string").alias("value"))
    return spark.readStream.text(src)


def _parsed(payloads: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    rows = payloads.select(F.from_json("value", f"{schema}, {_BAD} STRING", options).alias("e"))
    return rows.filter(F.col("e").isNotNull() & F.col(f"e.{_BAD}").isNull()).select("e.*").drop(_BAD)


def parse_job_events(payloads: DataFrame) -> DataFrame:
    """(type, job, message, at); payloads that are not JSON objects of that shape are ignored."""
    return _parsed(payloads, JOB_EVENT)


def job_events_stream(spark: SparkSession, src) -> DataFrame:
    return parse_job_events(_payloads(spark, src))


def parse_web_vitals(payloads: DataFrame) -> DataFrame:
    """Beacons with a name, a value and an id; the other fields may be missing."""
    rows = _parsed(payloads, WEB_VITAL)
    return rows.filter(~is_blank(F.col("name")) & F.col("value").isNotNull() & ~is_blank(F.col("id")))


def web_vitals_stream(spark: SparkSession, src) -> DataFrame:
    return parse_web_vitals(_payloads(spark, src))


def job_state_stream(stream: DataFrame) -> DataFrame:
    """Newest event of every job, of equal times the greatest; the state is one row per job."""
    last = F.max(F.struct("at", "type", "message")).alias("_last")
    return stream.groupBy("job").agg(last).select("job", "_last.type", "_last.message", "_last.at")


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything available now to a Parquet folder."""
    (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run an aggregated stream and keep its newest complete result as a Parquet folder."""
    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    (
        stream.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )


STATE_SCHEMA = "job string, type string, message string, at timestamp"
FULL_EVERY = 20


def _state_batches(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(batch, whether it holds all states) of what is stored, in order."""
    names = [n.partition("=") for n in folder_names(spark, path)]
    return sorted((int(v), k == "full") for k, _, v in names if k in ("changed", "full") and v.isdigit())


def _states_before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """Newest state of every job, from the last full batch and the changes after it."""
    stored = [b for b in _state_batches(spark, path) if batch_id is None or b[0] < batch_id]
    start = max((b for b, full in stored if full), default=-1)
    used = [f"{path}/{'full' if full else 'changed'}={b}" for b, full in stored if b > start or (b == start and full)]
    if not used:
        return spark.createDataFrame([], STATE_SCHEMA)
    return _newest_states(spark.read.schema(STATE_SCHEMA).parquet(*used))


def _newest_states(events: DataFrame) -> DataFrame:
    last = F.max(F.struct("at", "type", "message")).alias("_last")
    return events.groupBy("job").agg(last).select("job", "_last.type", "_last.message", "_last.at")


def keep_job_states(
    events: DataFrame, path: str, checkpoint: str, delay: dt.timedelta | None = None, late: str | None = None,
) -> None:
    """Keep the newest event of every job: each batch writes only the jobs that it changes.

    With `delay`, events more than that behind the newest event of the batches before are late: they change nothing and
    are put aside under `late`. Every `FULL_EVERY`th batch writes all states, and the batches before it are removed when
    the next one starts. A repeated batch reads what stood before it and writes the same again.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _state_batches(spark, path)
        start = max((b for b, full in stored if full and b < batch_id), default=-1)
        for b, full in stored:
            if b < start:
                remove_folder(spark, f"{path}/{'full' if full else 'changed'}={b}")
        known = _states_before(spark, path, batch_id)
        rows = batch.select("job", "type", "message", "at")
        if delay is not None:
            newest = known.agg(F.max("at")).first()[0]  # one value
            if newest is not None:
                behind = F.col("at") < F.lit(newest - delay)
                if late is not None:
                    rows.filter(behind).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
                rows = rows.filter(~F.coalesce(behind, F.lit(False)))
        fresh = _newest_states(rows)
        before = known.select(F.col("job").alias("_job"), F.struct("at", "type", "message").alias("_before"))
        newer = F.col("_before").isNull() | (F.struct("at", "type", "message") > F.col("_before"))
        changed = fresh.join(before, F.col("job").eqNullSafe(F.col("_job")), "left").filter(newer).select(*fresh.columns)
        if batch_id and batch_id % FULL_EVERY == 0:
            _newest_states(known.unionByName(changed)).write.mode("overwrite").parquet(f"{path}/full={batch_id}")
        else:
            changed.write.mode("overwrite").parquet(f"{path}/changed={batch_id}")

    (
        events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def read_job_states(spark: SparkSession, path: str) -> DataFrame:
    """The newest event of every job."""
    return _states_before(spark, path)


def _newest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("at"), "job", "type", "message").limit(n)


def recent_events(stream: DataFrame, state: str, checkpoint: str, n: int = RECENT) -> None:
    """Keep the newest `n` events. Batch k merges its rows with the `n` rows that batch k-1 left, and writes its
    own version, so a repeated batch gives the same version again; the version before the last is removed."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = _newest(batch, n)
        if batch_id > 0:
            rows = _newest(rows.unionByName(batch.sparkSession.read.parquet(f"{state}/v{batch_id - 1}")), n)
        rows.write.mode("overwrite").parquet(f"{state}/v{batch_id}")
        remove_folder(batch.sparkSession, f"{state}/v{batch_id - 2}")

    (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def read_recent(spark: SparkSession, state: str, n: int = RECENT) -> DataFrame:
    """The newest version; equal events are events of their own."""
    versions = [int(name[1:]) for name in folder_names(spark, state) if name[:1] == "v" and name[1:].isdigit()]
    return _newest(spark.read.parquet(f"{state}/v{max(versions)}"), n)
