"""Delimited files addressed by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MALFORMED = "_malformed"
_NO_SEP = "\u0001"


def positional_schema(n: int) -> str:
    return ", ".join([f"c{i} STRING" for i in range(n)] + [f"{_MALFORMED} STRING"])


def csv_options(sep: str) -> dict[str, str]:
    return {
        "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED,
    }


def field_count(line: Column, sep: str) -> Column:
    """Number of fields of a raw line; separators inside quotes do not count."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def enough_fields(malformed: Column, sep: str, min_fields: int) -> Column:
    """Spark keeps the raw text of lines whose width differs from the schema: only those need counting."""
    return malformed.isNull() | (field_count(malformed, sep) >= min_fields)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of delimited files, unparsed, as column `line`; the first line of every file is a header."""
    raw = (
        spark.read.schema(f"line STRING, {_MALFORMED} STRING")
        .options(**(csv_options(_NO_SEP) | {"quote": "\u0000"}))
        .option("header", True)
        .option("columnPruning", False)
        .csv(path)
    )
    return raw.select(F.coalesce(_MALFORMED, "line").alias("line"))  # one that has the separator is kept as it was


def read_positional(
    spark: SparkSession, path: str | list[str], width: int, min_fields: int, sep: str = ","
) -> DataFrame:
    """String columns c0..c{width-1}; the first line of every file is a header; shorter rows are dropped."""
    raw = (
        spark.read.schema(positional_schema(width))
        .options(**csv_options(sep))
        .option("header", True)
        .option("columnPruning", False)  # a pruned parser cannot tell the width of a line
        .csv(path)
    )
    return raw.filter(enough_fields(F.col(_MALFORMED), sep, min_fields)).drop(_MALFORMED)


def parse_positional(lines: DataFrame, width: int, min_fields: int, sep: str = ",") -> DataFrame:
    """The same over a frame with one `line` column.

    The fields come from a generator: filters on fields of a plain struct would be pushed below it, and the line parsed once
    for every field they name.
    """
    parsed = lines.select(F.inline(F.array(F.from_csv("line", positional_schema(width), csv_options(sep)))))
    return parsed.filter(enough_fields(F.col(_MALFORMED), sep, min_fields)).drop(_MALFORMED)
