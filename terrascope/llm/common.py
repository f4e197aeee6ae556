"""Helpers of the text operators: tables, staged results, and hashing of byte ranges in numpy."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.session import fresh_path, remove_folder, shuffles_removed

SPACE_WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: later steps do not repeat the work before."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return _read_again(df, path)


def staged_in_slices(make: Callable[[Callable[..., Column]], DataFrame], name: str, slices: int) -> DataFrame:
    """The rows that `make` gives for every slice, written one slice after the other, so that only one has shuffle files.

    `make` gets a function that tells whether a row is of the slice, from the columns that rows of one slice share.
    """
    for k in range(slices):
        df = make(lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(slices)) == k)  # noqa: B023
        path = path if k else fresh_path(df.sparkSession, name)  # noqa: F821
        with shuffles_removed(df.sparkSession):
            df.write.mode("append").parquet(path)
    return _read_again(df, path)


def _read_again(df: DataFrame, path: str) -> DataFrame:
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    rows.staged_path = path
    return rows


def released(*frames: DataFrame) -> None:
    """Remove the files of staged frames that nothing reads any more."""
    for df in frames:
        remove_folder(df.sparkSession, df.staged_path)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Hand this package's source to the executors, once per application, so that their Python finds it however the
    driver does. Spark serves the archive from the driver; executors read no folder of it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    folder, root = tempfile.mkdtemp(prefix="terrascope-code-"), Path(__file__).resolve().parents[2]
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/terrascope-code.zip", "w") as archive:
        for source in sorted((root / "terrascope").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(f"{folder}/terrascope-code.zip")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*columns: Column) -> Column:
    """A 64-bit key of a row; equal rows share it."""
    return F.xxhash64(*columns)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if len(known) <= 4 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


class RangeHash:
    """Polynomial hashes of any range of a sequence of numbers, from one pass over it. For ranges of a few hundred numbers,
    or of distinct sorted ones: in longer ones two numbers can be arranged so that hashes agree (see `word_hashes`)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers(_BASE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.back = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] ^ (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every range of `size` values, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n])


LONG_WORD = 128


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from slices of about a megabyte, so that memory does not grow with the text.

    Polynomials modulo 2^64 have known collisions from about a thousand letters on; words over `LONG_WORD` bytes are
    hashed by BLAKE2 instead.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        if ends[end - 1] - low <= CHUNK_BYTES:
            out[at:end] = RangeHash(data[low:ends[end - 1]]).of(starts[at:end] - low, ends[at:end] - low)
        at = end
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of rows that hold about `limit` bytes; a null is empty. A longer text comes alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def space_separated(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, and how many words stand before each text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(inside):
        edge[0], edge[-1] = inside[0], inside[-1]
    starts_here, ends_here = np.zeros(len(inside) + 1, bool), np.zeros(len(inside) + 1, bool)
    starts_here[:-1] = edge[:-1] & inside
    ends_here[1:] = edge[1:] & inside
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    starts_here[cuts] = True
    ends_here[cuts] = True
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def anchored_runs(hashed: RangeHash, limits: np.ndarray, window: int, gram: int):
    """Runs of window starts that share their first least gram: (text number, its hash, first start, last start).

    Equal windows have equal least gram hashes and stand in different runs, so a window can only repeat where the hash
    of a run does. `limits` are the offsets of the texts; no window crosses one.
    """
    n = int(limits[-1])
    if n < window:
        empty = np.empty(0, np.int64)
        return empty, np.empty(0, np.uint64), empty, empty
    grams = hashed.windows(gram)
    least = sliding_min(grams, window - gram + 1)
    room = np.zeros(n + 1, np.int32)
    lengths = np.diff(limits)
    long = lengths >= window
    np.add.at(room, limits[:-1][long], 1)
    np.add.at(room, limits[1:][long] - window + 1, -1)
    valid = np.cumsum(room[:n - window + 1]) > 0
    first = valid.copy()
    # a window without the gram that the one before it began with, but with an equal one, starts a new run
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[:len(least) - 1] == least[1:])
    first[limits[:-1][long]] = True
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return np.searchsorted(limits, starts, "right") - 1, least[starts], starts, ends


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)
