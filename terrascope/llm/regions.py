"""Where windows of a text can repeat at all, found from one hash per few windows instead of one per window.

Each window has a sign: the least hash of the short grams inside it. Neighbouring windows share signs, so a text falls
into regions of window starts with one sign; equal windows have equal signs wherever they stand. Only regions whose
sign is there twice can hold a repeated window. Regions that are equal as a whole need no further look: all their
windows repeat. What is left, one place of each different region under a shared sign, is the residue, whose windows
an operator compares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RangeHash, anchored_runs, partitions, row_key, signed, staged, text_chunks

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, key and text; the key is a 64-bit hash of id and text, so equal rows are one document.

    Among very many rows a few keys agree by chance: what is found for a document is kept by key and `owner`.
    """
    return docs.select(
        F.col(doc_id).alias("id"), row_key(F.col(doc_id), F.col(text)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))


def owner(doc_id: Column | str = "id") -> Column:
    """A second hash of a document, of its id alone."""
    return F.xxhash64(doc_id)


def packed(docs: DataFrame) -> DataFrame:
    """The texts compressed one by one, so that a shuffle moves and stores less of them."""
    schema = T.StructType([docs.schema["id"], docs.schema["key"], T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [compress(t.as_buffer()) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], schema.names)

    return docs.select("id", "key", "text").mapInArrow(pack, schema)


def unpacked(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value) if value else b""


def regions(docs: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """sign, region (hash of all its units), id, key, first and last window start, of every region of every text.

    `units` turns (bytes, offsets) of some texts into (numbers to hash, how many of them stand before each text).
    """
    schema = T.StructType([
        T.StructField("sign", T.LongType()), T.StructField("region", T.LongType()), docs.schema["id"],
        docs.schema["key"], T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(2)):
                values, limits = units(data, offsets)
                hashed = RangeHash(values)
                number, sign, first, last = anchored_runs(hashed, limits, window, gram)
                if not len(first):
                    continue
                whole = hashed.of(first, last + window)
                rows = pa.array(number + row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(sign)), pa.array(signed(whole)), batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array((first - limits[number]).astype(np.int32)), pa.array((last - limits[number]).astype(np.int32)),
                ], schema.names)

    return docs.select("id", "key", "text").mapInArrow(cut, schema)


def repeated_regions(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions under repeated signs, their classes, the residue).

    Classes: sign, region, n and the first place (id, key, first, last). Residue: the first place of every class whose
    sign has several classes, with their number `rivals`. All counts combine map-side; joins are between staged tables,
    so that a crowded sign can be split.
    """
    again = staged(found.groupBy("sign").count().filter("count > 1").select("sign"), "signs")
    shared = staged(found.join(again, "sign"), "regions")
    classes = staged(shared.groupBy("sign", "region").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "first", "last")).alias("at")), "classes")
    rivals = staged(classes.groupBy("sign").agg(F.count(F.lit(1)).alias("rivals")).filter("rivals > 1"), "rivals")
    residue = staged(classes.join(rivals, "sign").select("sign", "region", "n", "rivals", "at.*"), "residue")
    return shared, classes, residue


def text_exchange(docs: DataFrame) -> DataFrame:
    """The packed texts dealt by key and owner, which is column `of`."""
    return packed(docs).withColumn("of", owner()).repartition(partitions(docs.sparkSession), "key", "of")


def with_texts(rows: DataFrame, docs: DataFrame, *columns: str | Column) -> DataFrame:
    """One row per document that has rows (id, key and others): id, key, of, packed and the rows as array `places`."""
    gathered = rows.withColumn("of", owner()).groupBy("key", "of").agg(F.collect_list(F.struct(*columns)).alias("places"))
    return text_exchange(docs).join(gathered, ["key", "of"])


def marked_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Every document with `spans`, its marked window starts (first, last), or null. `marks`: key, of, first, last."""
    spans = marks.groupBy("key", "of").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return text_exchange(docs).join(spans, ["key", "of"], "left")


def covered(n: int, spans: list | None, window: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    if spans:
        first = np.array([s["first"] for s in spans])
        last = np.array([s["last"] for s in spans])
        np.add.at(edges, first, 1)
        np.add.at(edges, last + window, -1)
    return np.cumsum(edges[:n]) > 0
