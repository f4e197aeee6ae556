"""Repeated word windows, by doubling lengths.

The first length is `base` words. Its grams are hashed, and the least one inside each window stands for it (regions.py);
windows whose gram is nowhere else are out. Of the windows left, the first `2 * base` words are hashed and counted, and
only those there twice go on to twice that length, and so on to the whole window. The earliest place of each repeated
window is kept; the words of all later ones go.

Defined results: a null text has no words; a text shorter than the window loses nothing; rows with equal id and text are
one document and get one result each; a null id stands before all others; documents of one id and different texts are
ordered by the hash of their row; an empty table gives no rows; columns other than id and text are ignored; a long text
is read whole in one task, its words hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import regions as R
from .common import RangeHash, signed, space_separated, staged, word_hashes, words

WINDOW, BASE = 20, 5


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and how many words stand before each text."""
    starts, ends, limits = words(space_separated(data), offsets)
    return word_hashes(data, starts, ends), limits


def lengths(window: int, base: int) -> list[int]:
    """The lengths after the first: twice as long each time, the last one the window itself."""
    out, size = [], base
    while size < window:
        size = min(size * 2, window)
        out.append(size)
    return out or [window]


def residual_windows(docs: DataFrame, residue: DataFrame, window: int, base: int) -> DataFrame:
    """id, key, start and a hash h_n for every length n, of every window in the residue."""
    sizes = lengths(window, base)
    schema = T.StructType(
        [docs.schema["id"], docs.schema["key"], T.StructField("start", T.IntegerType())]
        + [T.StructField(f"h_{n}", T.LongType()) for n in sizes])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for row in range(batch.num_rows):
                data = np.frombuffer(R.unpacked(columns["packed"][row].as_py()), np.uint8)
                values, _ = word_units(data, np.array([0, len(data)]))
                hashed = RangeHash(values)
                places = columns["places"][row].as_py()
                start = np.unique(np.concatenate([np.arange(p["first"], p["last"] + 1) for p in places]))
                same = pa.array(np.full(len(start), row))
                yield pa.RecordBatch.from_arrays(
                    [columns["id"].take(same), columns["key"].take(same), pa.array(start.astype(np.int32))]
                    + [pa.array(signed(hashed.of(start, start + n))) for n in sizes], schema.names)

    return R.with_texts(residue, docs, "first", "last").mapInArrow(hashes, schema)


def later_windows(docs: DataFrame, window: int, base: int) -> DataFrame:
    """(key, of, first, last): the window starts whose words are there earlier too."""
    shared, classes, residue = R.repeated_regions(R.regions(docs, word_units, window, base))
    copies = classes.filter("n > 1").select("sign", "region", F.col("at").alias("earliest"))
    here = _place("first")
    whole = shared.join(copies, ["sign", "region"]).filter(here != _earliest("first")).select(
        "key", R.owner().alias("of"), "first", "last")

    left = staged(residual_windows(docs, residue, window, base), "windows")
    for n in lengths(window, base)[:-1]:
        again = staged(left.groupBy(f"h_{n}").count().filter("count > 1").select(f"h_{n}"), "windows-again")
        left = staged(left.join(again, f"h_{n}"), "windows")
    last = f"h_{window}"
    earliest = staged(left.groupBy(last).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "start")).alias("earliest"),
    ).filter("n > 1").drop("n"), "windows-earliest")
    single = left.join(earliest, last).filter(_place("start") != _earliest("start")).select(
        "key", R.owner().alias("of"), F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(single)


def _place(start: str) -> Column:
    return F.struct(F.col("key"), R.owner().alias("of"), F.col(start).alias("start"))


def _earliest(start: str) -> Column:
    return F.struct(F.col("earliest.key"), R.owner("earliest.id").alias("of"), F.col(f"earliest.{start}").alias("start"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, base: int = BASE, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """id, n_words, n_removed, spans of removed words (first, last) and kept_text (words joined by one space)."""
    keyed = R.keyed(docs, doc_id, text)
    marks = staged(later_windows(keyed, window, min(base, window)), "substring-marks")
    schema = T.StructType([
        keyed.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("kept_text", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            out: list[list] = [[], [], [], []]
            for row in range(batch.num_rows):
                raw = R.unpacked(columns["packed"][row].as_py())
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = words(space_separated(data), np.array([0, len(data)]))
                gone = R.covered(len(starts), columns["spans"][row].as_py(), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join(raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
                out[0].append(len(starts))
                out[1].append(int(gone.sum()))
                out[2].append([{"first": f, "last": e - 1} for f, e in edges.reshape(-1, 2).tolist()])
                out[3].append(kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [columns["id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array(out[3], pa.string())], schema.names)

    return R.marked_texts(keyed, marks).mapInArrow(remove, schema)
