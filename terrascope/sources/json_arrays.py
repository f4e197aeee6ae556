"""JSON arrays and FeatureCollections of any size, read in splits.

A file that holds one array is cut where its records start: the text in front of the first record's first value (as
`{"code":`, or `{"type": "Feature"`) is looked up in the file's head and becomes the line separator of Spark's text
reader, which finds the next separator after the start of any split. Whatever does not fit a cut shows: a piece is
parsed as an array of records, so a record that starts otherwise comes along with the one before it, and a piece that
is no whole record raises an error instead of being lost.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _file_system, data_files

HEAD_BYTES = 1 << 16
_KEY = r'\{\s*"(?:[^"\\]|\\.)*"\s*:'
_FEATURE = r'\{\s*"type"\s*:\s*"Feature"'
_ARRAY = re.compile(rf"^﻿?\s*\[\s*({_KEY})")
_COLLECTION = re.compile(rf'"features"\s*:\s*\[\s*({_FEATURE}|{_KEY})')
_EMPTY = re.compile(r'^﻿?\s*(\[\s*\]|\{.*"features"\s*:\s*\[\s*\])', re.DOTALL)


def _head(spark: SparkSession, file: str) -> str:
    """The first bytes of a file, unpacked where its name says so."""
    jvm = spark.sparkContext._jvm
    fs, target = _file_system(spark, file)
    stream = fs.open(target)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
            spark.sparkContext._jsc.hadoopConfiguration()).getCodec(target)
        plain = codec.createInputStream(stream) if codec is not None else stream
        bounded = jvm.org.apache.commons.io.input.BoundedInputStream(plain, HEAD_BYTES)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded)).decode("utf-8", "ignore")
    finally:
        stream.close()


def record_start(head: str, features: bool) -> str | None:
    """What every record of a file starts with; None for a file without records."""
    found = (_COLLECTION if features else _ARRAY).search(head)
    if found:
        return found.group(1)
    if _EMPTY.match(head):
        return None
    raise ValueError("no array of records at the start of the file: " + head[:80])


def read_json_records(
    spark: SparkSession, path: str, schema: str, features: bool = False, position: str | None = None
) -> DataFrame:
    """The records of all array (or FeatureCollection) files under a path, parsed by `schema`.

    `position` names a column with a record's place in the feed: file, split and number in it; later records of a file
    have greater places.
    """
    by_start = defaultdict(list)
    for file in data_files(spark, path):
        start = record_start(_head(spark, file), features)
        if start is not None:
            by_start[start].append(file)
    parsed = None
    for start, files in by_start.items():
        text = F.rtrim(F.regexp_replace("value", r"\s+$", ""))
        piece = F.when(F.endswith(text, F.lit(",")), F.concat(F.substring(text, F.lit(1), F.char_length(text) - 1), F.lit("]")))
        records = F.from_json(F.concat(F.lit("[" + start), piece.otherwise(text)), f"ARRAY<STRUCT<{schema}>>")
        whole = F.when(records.isNull(), F.raise_error(F.concat(
            F.lit("not a whole record: "), F.substring(text, 1, 200))).cast(f"ARRAY<STRUCT<{schema}>>")).otherwise(records)
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
        rows = spark.read.option("lineSep", start).text(files)
        rows = rows.select("value", *([place.alias("_place")] if position else []))
        # what stands before the first record ends with the bracket that opens the array
        rows = rows.filter(~F.col("value").rlike(r"\[\s*$"))
        rows = rows.select(*(["_place"] if position else []), F.posexplode(whole).alias("_at", "_record"))
        rows = rows.select("_record.*", *([F.struct("_place", "_at").alias(position)] if position else []))
        parsed = rows if parsed is None else parsed.unionByName(rows)
    if parsed is None:
        place_type = "STRUCT<_place: STRUCT<file_path: STRING, file_block_start: BIGINT, n: BIGINT>, _at: INT>"
        return spark.createDataFrame([], schema + (f", {position}: {place_type}" if position else ""))
    return parsed
