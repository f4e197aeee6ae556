"""Repeated byte strings by suffix arrays.

Regions under repeated signs (regions.py) are dealt to shards by sign, so that equal strings meet. A shard sorts the
suffixes of its pieces by Larsson-Sadakane refinement, takes the common prefixes of neighbours as Kasai does, and has
the strings of `window` bytes that are there twice. A sign with many different regions is spread over several shards;
their sorted strings are cut by range and merged by binary search.

Defined results: a null text is empty; a text shorter than the window loses nothing; matches do not cross texts; equal
rows are copies of one another; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import regions as R
from .common import RangeHash, partitions, signed, staged

WINDOW, GRAM = 200, 48
SHARD_BYTES = 1 << 20  # a shard closes at the first sign after so many bytes
RIVALS = 256  # different regions of one sign that one shard takes
RANGES = 16  # ranges of strings for each shard of a split sign


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes in order, which of them may share `depth` bytes with another: they share half of that).

    Larsson-Sadakane: suffixes are grouped by their first bytes; every round sorts the groups that still hold several,
    by the group of the suffix that starts as many bytes later, which doubles the reach, until all stand alone.
    """
    n, first = len(text), 7
    symbols = np.zeros(n + first, np.int64)
    symbols[:n] = text.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for i in range(first):
        key = (key << 9) | symbols[i:i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    reach = first
    shared = np.ones(n, bool)
    while True:
        size = np.bincount(group, minlength=n)
        open_places = np.flatnonzero(size[group] > 1)
        if reach <= depth:
            shared = np.zeros(n, bool)
            shared[order[open_places]] = True
        if not len(open_places):
            return order, shared
        suffixes = order[open_places]
        later = suffixes + reach
        follow = np.where(later < n, rank[np.minimum(later, n - 1)], -1)
        both = rank[suffixes] * (n + 1) + follow + 1
        by = np.argsort(both, kind="stable")
        order[open_places] = suffixes[by]
        both = both[by]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        group[open_places] = open_places[np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))]
        rank[order[open_places]] = group[open_places]
        reach *= 2


def common_prefixes(text: bytes, order: np.ndarray, most: int, wanted: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix of each suffix with the one before it in order, up to `most`; 0 where not wanted."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    before[~wanted] = -1
    out, size = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            size = 0
            continue
        room = min(most, n - (i if i > j else j))
        if size > room:
            size = room
        while size < room and text[i + size] == text[j + size]:
            size += 1
        out[i] = size
        if size:
            size -= 1
    return np.array(out, np.int64)[order]


def shard_strings(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, class, members) of every string of `window` bytes, sorted by string; equal strings share a class."""
    whole = b"".join(pieces)
    text = np.frombuffer(whole, np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    order, shared = suffix_array(text, window)
    prefixes = common_prefixes(whole, order, window, shared)
    classes = np.cumsum(prefixes < window)
    piece = np.searchsorted(ends, order, "right")
    fits = ends[piece] - order >= window
    order, piece, classes = order[fits], piece[fits], classes[fits]
    members = np.bincount(classes, minlength=1)[classes] if len(classes) else classes
    starts = order - (ends - np.array([len(p) for p in pieces]))[piece]
    return piece, starts, classes, members


def _cut_pieces(residue: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """sign, salt, parts (over how many salts the sign is spread), key, of, first and the bytes of every region in the
    residue."""
    parts = F.ceil(F.col("rivals") / F.lit(RIVALS)).cast("int")
    dealt = residue.select(
        "id", "key", "sign", F.pmod("region", parts).cast("int").alias("salt"), parts.alias("parts"), "first", "last")
    schema = T.StructType([
        T.StructField("sign", T.LongType()), T.StructField("salt", T.IntegerType()),
        T.StructField("parts", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("of", T.LongType()),
        T.StructField("first", T.IntegerType()), T.StructField("piece", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for row in range(batch.num_rows):
                raw = R.unpacked(columns["packed"][row].as_py())
                places = columns["places"][row].as_py()
                key, of = columns["key"][row].as_py(), columns["of"][row].as_py()
                rows = {(p["sign"], p["first"]): p for p in places}.values()  # equal documents come with equal places
                yield pa.RecordBatch.from_pylist([{
                    "sign": p["sign"], "salt": p["salt"], "parts": p["parts"], "key": key, "of": of, "first": p["first"],
                    "piece": raw[p["first"]:p["last"] + window],
                } for p in rows], schema=_arrow(schema))

    return R.with_texts(dealt, docs, "sign", "salt", "parts", "first", "last").mapInArrow(cut, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def _shards(pieces: DataFrame, window: int) -> DataFrame:
    """Marks (key, of, first, last), and for split signs also the shard's sorted strings, one of each class, cut into
    ranges: sign, range and the arrays strings, keys, owners and places. The more shards a sign has, the finer the ranges."""
    schema = T.StructType([
        T.StructField("key", T.LongType()), T.StructField("of", T.LongType()), T.StructField("first", T.IntegerType()),
        T.StructField("last", T.IntegerType()), T.StructField("sign", T.LongType()),
        T.StructField("range", T.LongType()), T.StructField("strings", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("owners", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.IntegerType()))])
    names = schema.names

    def close(held: list[dict]) -> Iterator[pa.RecordBatch]:
        piece, start, classes, members = shard_strings([h["piece"] for h in held], window)
        key, of = (np.array([h[c] for h in held], np.int64) for c in ("key", "of"))
        first = np.array([h["first"] for h in held], np.int64)
        twice = members > 1
        by = np.lexsort((start[twice], piece[twice]))
        p, s = piece[twice][by], start[twice][by]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        run = np.flatnonzero(new)
        end = np.append(run[1:], len(p)) - 1
        if len(run):
            longs, lists = pa.nulls(len(run), pa.int64()), pa.nulls(len(run), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([
                pa.array(key[p[run]]), pa.array(of[p[run]]), pa.array((first[p[run]] + s[run]).astype(np.int32)),
                pa.array((first[p[run]] + s[end]).astype(np.int32)), longs, longs, lists, lists, lists,
                pa.nulls(len(run), pa.list_(pa.int32()))], names)
        parts = np.array([h["parts"] for h in held], np.int64)
        lead = np.ones(len(classes), bool)
        lead[1:] = classes[1:] != classes[:-1]
        chosen = np.flatnonzero((parts[piece] > 1) & lead)
        if len(chosen):
            p, s = piece[chosen], start[chosen]
            offsets = np.concatenate([[0], np.cumsum([len(h["piece"]) for h in held])])
            hashed = RangeHash(np.frombuffer(b"".join(h["piece"] for h in held), np.uint8))
            string = hashed.of(offsets[p] + s, offsets[p] + s + window)
            sign = np.array([h["sign"] for h in held], np.int64)[p]
            bits = np.minimum(np.ceil(np.log2(parts[p] * RANGES)).astype(np.uint64), 63)
            part = string >> (np.uint64(64) - bits)
            by = np.lexsort((string, part, sign))
            p, s, string, sign, part = p[by], s[by], string[by], sign[by], part[by]
            new = np.ones(len(by), bool)
            new[1:] = (sign[1:] != sign[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(new)
            cuts = pa.array(np.append(begin, len(by)).astype(np.int32))
            none, longs = pa.nulls(len(begin), pa.int32()), pa.nulls(len(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([
                longs, longs, none, none, pa.array(sign[begin]), pa.array(signed(part[begin])),
                pa.ListArray.from_arrays(cuts, pa.array(signed(string))), pa.ListArray.from_arrays(cuts, pa.array(key[p])),
                pa.ListArray.from_arrays(cuts, pa.array(of[p])),
                pa.ListArray.from_arrays(cuts, pa.array((first[p] + s).astype(np.int32)))], names)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if held and size >= SHARD_BYTES and (row["sign"], row["salt"]) != group:
                    yield from close(held)
                    held, size = [], 0
                group = (row["sign"], row["salt"])
                held.append(row)
                size += len(row["piece"])
        if held:
            yield from close(held)

    dealt = pieces.repartition(partitions(pieces.sparkSession), "sign", "salt").sortWithinPartitions("sign", "salt")
    return dealt.mapInArrow(shard, schema)


def _merged(ranges: DataFrame) -> DataFrame:
    """The strings of split signs that are in several shards: each is looked up by binary search among the strings that
    all shards have of its sign in its range."""
    schema = "key long, of long, first int, last int"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column("strings").chunk(0)
        sign = np.repeat(rows.column("sign").to_numpy(), np.diff(lists.offsets.to_numpy()))
        string = lists.flatten().to_numpy()
        there = np.zeros(len(string), bool)
        by_sign = np.argsort(sign, kind="stable")
        for own in np.split(by_sign, np.flatnonzero(np.diff(sign[by_sign])) + 1):
            ordered = np.sort(string[own])
            there[own] = np.searchsorted(ordered, string[own], "right") - np.searchsorted(ordered, string[own], "left") > 1
        key, of, place = (rows.column(c).chunk(0).flatten().to_numpy()[there] for c in ("keys", "owners", "places"))
        by = np.lexsort((place, of, key))
        key, of, place = key[by], of[by], place[by]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)
        run = np.flatnonzero(new)
        if len(run):
            end = np.append(run[1:], len(key)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[run]), pa.array(of[run]), pa.array(place[run]), pa.array(place[end])],
                ["key", "of", "first", "last"])

    dealt = ranges.select("sign", "range", "strings", "keys", "owners", "places").repartition(
        partitions(ranges.sparkSession), "sign", "range")
    return dealt.mapInArrow(merge, schema)


def repeated_strings(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, of, first, last): the starts of strings of `window` bytes that start elsewhere too."""
    shared, classes, residue = R.repeated_regions(
        R.regions(docs, lambda data, offsets: (data, offsets), window, gram))
    copies = classes.filter("n > 1").select("sign", "region")
    whole = shared.join(copies, ["sign", "region"]).select("key", R.owner().alias("of"), "first", "last")
    sharded = staged(_shards(_cut_pieces(residue, docs, window), window), "suffix-shards")
    local = sharded.filter("range IS NULL").select("key", "of", "first", "last")
    return whole.unionByName(local).unionByName(_merged(sharded.filter("range IS NOT NULL")))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """id, n_bytes, n_removed, spans of removed bytes (first, last) and kept_bytes."""
    keyed = R.keyed(docs, doc_id, text)
    marks = staged(repeated_strings(keyed, window, min(gram, window)), "suffix-marks")
    schema = T.StructType([
        keyed.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("kept_bytes", T.BinaryType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            out: list[list] = [[], [], [], []]
            for row in range(batch.num_rows):
                data = np.frombuffer(R.unpacked(columns["packed"][row].as_py()), np.uint8)
                gone = R.covered(len(data), columns["spans"][row].as_py(), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out[0].append(len(data))
                out[1].append(int(gone.sum()))
                out[2].append([{"first": f, "last": e - 1} for f, e in edges.reshape(-1, 2).tolist()])
                out[3].append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [columns["id"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array(out[3], pa.binary())], schema.names)

    return R.marked_texts(keyed, marks).mapInArrow(remove, schema)
