"""Vector codes: each vector's equal parts are replaced by the number of the nearest entry of the part's codebook.

Components are integers (floor of 256 times the value), so distances, sums and ties are exact. The codebooks start as
the first vectors and are moved to the floor of their parts' mean in a few rounds.

The nearest entry is found by slicing and intersecting bitmasks. The entries' coordinates in one dimension are sorted,
and beside each stands the mask of the entries up to it. All entries within a radius of a value in that dimension are a
range of the sorted coordinates, and its mask is the XOR of two prefix masks. The masks of all dimensions of a part, put
together by AND, are exactly the entries in the box around the part; only their distances are computed. An entry no
farther than the radius is in the box; where the best one found is farther, the box is made as large as that distance
and looked at once more, and where the box is empty the radius doubles. So the result is exact whatever the radius is.

Tasks send back sums by (part, entry, position), which Spark adds up; the driver sees 64 entries' sums, never vectors.
What is sent to tasks is the codebooks, entries x dimensions numbers however many vectors there are.

Defined results: a vector that is null or has a null, NaN or infinite component is left out; equal vectors have equal
codes; vectors of one id are separate rows, in the codebooks' start by their components; a null id comes last there; with
fewer vectors than entries the codebooks are shorter; an empty table has no codes; vectors of different lengths, or of a
length that the parts do not divide, are an error, and so is a component beyond 2^18 in size, whose squares would not fit
their sums; other columns are carried, and columns named `code` and `error` replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

PARTS = 16
ENTRIES = 64  # one bit each of a 64-bit mask
ROUNDS = 2
SCALE = 256
MOST = 1 << 26
CHUNK = 1 << 14  # rows looked up at a time


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


@dataclass
class Codebooks:
    """`entries`: (parts, entries, width) whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


class SlicedCodebook:
    """The nearest entry of one part's codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (n, width)
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()  # (width, n)
        self.masks = np.zeros((width, n + 1), np.uint64)
        bits = np.uint64(1) << order.T.astype(np.uint64)
        np.bitwise_or.accumulate(bits, axis=1, out=self.masks[:, 1:])
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        near = np.where(apart > 0, apart, np.iinfo(np.int64).max).min(axis=1) if n else apart
        near = near[near < np.iinfo(np.int64).max]
        #: the first radius: how far entries stand from one another in the middle
        self.radius = int(np.sqrt(np.median(near))) + 1 if len(near) else 1

    def in_box(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The mask of the entries whose coordinates all lie within `radius` of each point's."""
        mask = np.full(len(points), ~np.uint64(0))
        for at, prefix, x in zip(self.sorted, self.masks, points.T, strict=True):
            low, high = np.searchsorted(at, x - radius, "left"), np.searchsorted(at, x + radius, "right")
            mask &= prefix[high] ^ prefix[low]
        return mask

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every point; the lower entry of a tie."""
        n = len(points)
        entry, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        radius, rows = np.full(n, self.radius, np.int64), np.arange(n)
        while len(rows):
            mask = self.in_box(points[rows], radius[rows])
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, candidate = np.nonzero(bits)
            apart = ((points[rows[at]] - self.entries[candidate]) ** 2).sum(axis=1)
            filled = np.flatnonzero(mask != 0)
            again = [rows[mask == 0]]
            radius[again[0]] *= 2
            if len(filled):
                starts = np.searchsorted(at, filled)
                least = np.minimum.reduceat(apart, starts)
                # candidates ascend inside a row, so the first of the least is the lower entry
                first = np.flatnonzero(apart == np.repeat(least, np.diff(np.append(starts, len(at)))))
                chosen = first[np.searchsorted(at[first], filled)]
                found = rows[filled]
                sure = least <= radius[found] ** 2
                entry[found[sure]], best[found[sure]] = candidate[chosen[sure]], least[sure]
                unsure = found[~sure]
                radius[unsure] = np.ceil(np.sqrt(least[~sure].astype(np.float64))).astype(np.int64) + 1
                again.append(unsure)
            rows = np.concatenate(again)
        return entry, best


def whole_numbers(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, dimensions) of a column of vectors without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    if len(lengths) and ((lengths != lengths[0]).any() or not lengths[0] or lengths[0] % parts):
        raise ValueError(f"vectors must have one length that {parts} parts divide")
    values = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    if (np.abs(values) > MOST).any():
        raise ValueError(f"a component is beyond {MOST // SCALE}")
    return values.astype(np.int64).reshape(len(column), -1)


def _assigned(vectors: np.ndarray, books: list[SlicedCodebook]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) entries, and the squared distances summed over the parts."""
    width = vectors.shape[1] // len(books)
    codes, error = np.zeros((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
    for p, book in enumerate(books):
        codes[:, p], apart = book.nearest(vectors[:, p * width:(p + 1) * width])
        error += apart
    return codes, error


def _sliced(entries: np.ndarray, dimensions: int) -> list[SlicedCodebook]:
    if entries.shape[0] * entries.shape[2] != dimensions:
        raise ValueError("vectors must have one length")
    return [SlicedCodebook(part) for part in entries]


def first_codebooks(vectors: DataFrame, vec_id: str, vector: str, parts: int, entries: int) -> Codebooks:
    """The first vectors by id: `entries` rows at most reach the driver."""
    first = vectors.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).limit(entries).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    numbers = whole_numbers(pa.array([r[1] for r in first], pa.list_(pa.float64())), parts)
    return Codebooks(numbers.reshape(len(first), parts, -1).swapaxes(0, 1).copy())


def moved(vectors: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: every entry goes to the floor of the mean of the parts nearest to it; an unused one stays."""
    entries = books.entries
    parts, n, width = entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used, sliced = np.zeros(entries.shape, np.int64), np.zeros((parts, n), np.int64), None
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                numbers = whole_numbers(batch.column(0).slice(start, CHUNK), parts)
                sliced = sliced or _sliced(entries, numbers.shape[1])
                codes, _ = _assigned(numbers, sliced)
                for p in range(parts):
                    used[p] += np.bincount(codes[:, p], minlength=n)
                    np.add.at(total[p], codes[:, p], numbers[:, p * width:(p + 1) * width])
        part, entry = np.nonzero(used)
        if len(part):
            at = np.tile(np.arange(width), len(part))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(part, width)), pa.array(np.repeat(entry, width)), pa.array(at),
                pa.array(np.repeat(used[part, entry], width)), pa.array(total[part, entry].reshape(-1)),
            ], ["part", "entry", "at", "used", "total"])

    added = vectors.select(vector).mapInArrow(
        sums, "part bigint, entry bigint, at bigint, used bigint, total bigint",
    ).groupBy("part", "entry", "at").agg(F.sum("used").alias("used"), F.sum("total").alias("total"))
    new = entries.copy()
    for r in added.collect():  # entries x dimensions rows at most
        new[r.part, r.entry, r.at] = r.total // r.used
    return Codebooks(new)


def fit(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codebooks:
    """Codebooks of the usable vectors."""
    if not 1 <= entries <= 64:
        raise ValueError("a codebook has 1 to 64 entries")
    kept = vectors.filter(usable(F.col(vector)))
    books = first_codebooks(kept, vec_id, vector, parts, entries)
    for _ in range(rounds):
        if books.entries.size:
            books = moved(kept, vector, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The usable rows' other columns with `code`, two hex digits a part, and `error`, the squared distance."""
    own = [f for f in vectors.schema.fields if f.name not in (vector, "code", "error")]
    schema = T.StructType([*own, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    entries = books.entries
    parts = len(entries)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = None
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                numbers = whole_numbers(batch.column(batch.num_columns - 1), parts)
                sliced = sliced or _sliced(entries, numbers.shape[1])
                codes, error = _assigned(numbers, sliced)
                hexed = codes.astype(np.uint8).tobytes().hex()
                texts = [hexed[i:i + 2 * parts] for i in range(0, len(hexed), 2 * parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(len(own))] + [pa.array(texts, pa.string()), pa.array(error)],
                    schema.names)

    kept = vectors.filter(usable(F.col(vector))).select(*[F.col(f"`{f.name}`") for f in own], F.col(vector))
    return kept.mapInArrow(coded, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """The rows with `approximation`, the vector that a code stands for."""
    rows = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]) for e in part]) for part in books.entries])
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(len(books.entries) - 1)),
        lambda p: F.element_at(F.element_at(rows, p + 1), F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return codes.withColumn("approximation", F.flatten(numbers))


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """The rows with `label_error`, the sum of `error` over their label's rows; null is a label.

    Sums combine map-side, so a crowded label is no task of its own; they are staged, so that Spark knows their size
    when it joins them, and it splits a crowded label where it does not send them to all tasks.
    """
    sums = staged(coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.drop("label_error").join(sums, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
