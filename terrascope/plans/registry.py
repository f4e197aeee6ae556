"""Named queries with their check in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
GRID_SHIFT = 0.2718281  # no quotient of cents and whole square metres ends there


def query(name: str, views: Iterable[str] = (), sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_views(views, sql)
        return fn

    return register


def micros(c: Column) -> Column:
    """Microseconds since 1970 on the wall clock, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c.cast("timestamp_ntz"))


def plain(df: DataFrame, *rounded: str, digits: int = 6, gridded: Iterable[str] = ()) -> DataFrame:
    """Types both engines print alike: money as double, dates as text, instants as microseconds; columns whose
    value depends on the order of a floating-point sum are rounded. `gridded` columns are means whose short
    decimals often end in a tie, where the last bit would decide: they are cut to thousandths on a shifted grid."""
    def convert(field):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = micros(c)
        if field.name in rounded:
            c = F.round(c, digits)
        if field.name in gridded:
            c = F.floor(c * 1000.0 + GRID_SHIFT).cast("double") / 1000.0
        return c.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])
