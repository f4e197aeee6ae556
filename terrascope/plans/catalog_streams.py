"""Registered queries: streams. Every stream ends when it has read what is there; its table is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks, streaming
from ..session import fresh_path, shuffles_removed
from ..sinks import overwrite_years, read_geocodes, with_geocodes
from .catalog_tables import GEOCODED_SQL, NOW
from .fixtures import over, view
from .registry import CHECKS, QUERIES, micros, plain, query


def _events(spark, sf):
    files = f"{sf}/events*.parquet"
    return spark.readStream.schema(spark.read.parquet(files).schema).parquet(files)


def _job_payloads(spark, sf):
    """Job events as JSON text; every 13th payload is broken."""
    events = over(spark, "job_events", events=_events(spark, sf))
    text = F.to_json(
        F.struct("type", "job", "message", F.col("at").cast("timestamp").alias("at")),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return events.select(F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(text).alias("value"))


def _vital_payloads(spark, sf):
    vitals = over(spark, "web_vitals", events=_events(spark, sf))
    text = F.to_json(F.struct("name", "value", "id", F.floor(micros(F.col("ts")) / 1000).alias("ts")))
    return vitals.select(F.when(F.col("event_id") % 47 == 0, F.lit("not json")).otherwise(text).alias("value"))


_GOOD = "event_id % 13 <> 0"


@query("job_events_stream", ["job_events"], f"""
    SELECT type, job, message, epoch_us("at") AS at FROM job_events WHERE {_GOOD}""")
def _(spark, sf):
    out = fresh_path(spark, "job-events")
    streaming.run_append(streaming.job_events_stream(spark, _job_payloads(spark, sf)), out, out + "-checkpoint")
    return plain(spark.read.parquet(out))


@query("recent_events", ["job_events"], f"""
    SELECT type, job, message, epoch_us("at") AS at FROM job_events WHERE {_GOOD}
    ORDER BY job_events."at" DESC LIMIT 20""")
def _(spark, sf):
    state = fresh_path(spark, "recent")
    streaming.recent_events(streaming.job_events_stream(spark, _job_payloads(spark, sf)), state, state + "-checkpoint")
    return plain(streaming.read_recent(spark, state))


@query("job_state_stream", ["job_events"], f"""
    SELECT job, arg_max(type, "at") AS type, arg_max(message, "at") AS message, epoch_us(max("at")) AS at
    FROM job_events WHERE {_GOOD} GROUP BY job""")
def _(spark, sf):
    out = fresh_path(spark, "job-state")
    states = streaming.job_state_stream(streaming.job_events_stream(spark, _job_payloads(spark, sf)))
    streaming.keep_latest(states, out, out + "-checkpoint")
    return plain(spark.read.parquet(out))


def _job_state_changes(spark, sf):
    """The same events in three deliveries, of which each writes only the jobs that it changes."""
    landing, out = fresh_path(spark, "job-landing"), fresh_path(spark, "job-states")
    events = view(spark, sf, "job_events")
    text = F.to_json(
        F.struct("type", "job", "message", F.col("at").cast("timestamp").alias("at")),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    lines = F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(text).alias("value")
    for part in range(3):
        events.filter(F.pmod(F.col("event_id"), F.lit(3)) == part).select(lines).write.mode("append").text(landing)
        streaming.keep_job_states(streaming.job_events_stream(spark, landing), out, out + "-checkpoint")
    return plain(streaming.read_job_states(spark, out))


QUERIES["job_state_changes"], CHECKS["job_state_changes"] = _job_state_changes, CHECKS["job_state_stream"]


@query("web_vitals_stream", ["web_vitals"], """
    SELECT name, value, id, epoch_us(ts) // 1000 AS ts FROM web_vitals
    WHERE trim(name) <> '' AND value IS NOT NULL AND id <> '' AND event_id % 47 <> 0""")
def _(spark, sf):
    out = fresh_path(spark, "vitals")
    streaming.run_append(streaming.web_vitals_stream(spark, _vital_payloads(spark, sf)), out, out + "-checkpoint")
    return spark.read.parquet(out).select("name", "value", "id", "ts")


@query("drain_geocoding", ["tx_by_sale", "cities", "geocodes"], GEOCODED_SQL)
def _(spark, sf):
    table = fresh_path(spark, "transactions")
    waiting = view(spark, sf, "tx_by_sale").withColumn("geocoded_at", F.lit(None).cast("timestamp"))
    overwrite_years(waiting, table, ["mutation_date"])
    answers = fresh_path(spark, "geocoding")
    for _run in range(2):  # the second finds nothing left to do
        streaming.drain_geocoding(spark, table, view(spark, sf, "cities"), view(spark, sf, "geocodes"), answers, NOW)
    rows = with_geocodes(spark.read.parquet(table), read_geocodes(spark, answers))
    return rows.select("lot_id", "latitude", "longitude", F.col("geocoded_at").isNotNull().alias("tried"))


@query("sales_refresh_stream", ["city_year"], """
    SELECT insee_code, year, transaction_count, CAST(total_price AS DOUBLE) AS total_price, total_residential_surface
    FROM city_year""")
def _(spark, sf):
    landing = fresh_path(spark, "landing")
    tables = {"store": fresh_path(spark, "sales-store")}
    tx = view(spark, sf, "tx")
    # a first release with other prices, then the second in two deliveries that share sales
    half = F.pmod(F.hash("id"), F.lit(2)) == 0
    parts = [
        tx.withColumn("property_value", F.col("property_value") + 1).withColumn("release", F.lit(1)),
        tx.filter(half).withColumn("release", F.lit(2)),
        tx.filter(~half).withColumn("release", F.lit(2)),
    ]
    for part in parts:
        columns = [F.col(c).cast(tx.schema[c].dataType).alias(c) for c in tx.columns]
        with shuffles_removed(spark):
            part.select(*columns, "release").write.mode("append").option("compression", "zstd").partitionBy(
                "year", "release").parquet(landing)
        # nobody reads the store in between
        streaming.sales_refresh_stream(spark, landing, tables, landing + "-checkpoint", NOW, keep_replaced=False)
    return plain(sinks.read_city_stats(spark, tables["store"]).drop("updated_at"))
