"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Terms are words and pairs of neighbouring words, with A-Z as a-z; a term that is there n times weighs 1 + ln n. Each of
the 64 bits of a term's hash votes for or against that bit of the fingerprint. For the search the bits are cut into
blocks; two fingerprints that differ in `radius` bits agree in all but `radius` of the blocks, so tables keyed by every
choice of agreeing blocks find all of them. Equal fingerprints are searched once.

Defined results: a null text is empty; a text without words has the fingerprint 0; a vote that ends even leaves the bit
0; documents follow one another by id, nulls first, those of one id by the hash of their text; after the last comes the
first, and a single document comes after itself; an empty table gives no rows; other columns are ignored; the votes of a
long text are added up in slices, so that it needs about 40 bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import regions as R
from .common import RangeHash, lowered, partitions, space_separated, staged, text_chunks, word_hashes, words

BITS = 64
RADIUS, BLOCKS = 3, 6
VOTE_BYTES = 1 << 17  # text whose terms are sorted at once; a longer text comes alone
VOTE_TERMS = 1 << 14  # terms whose votes are in memory at once
_WEIGHT = 16.0  # votes are whole numbers, so that no rounding depends on the order of terms


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    out = np.zeros(len(texts), np.uint64)
    for row, data, offsets in text_chunks(texts, VOTE_BYTES):
        starts, ends, limits = words(space_separated(data), offsets)
        single = word_hashes(lowered(data), starts, ends)
        if not len(single):
            continue
        text = np.searchsorted(limits, np.arange(len(single)), "right") - 1
        pair = RangeHash(single).of(np.arange(len(single) - 1), np.arange(2, len(single) + 1))
        together = text[1:] == text[:-1]
        term = np.concatenate([single, pair[together]])
        of = np.concatenate([text, text[1:][together]])
        by = np.argsort(term, kind="stable")
        by = by[np.argsort(of[by], kind="stable")]
        term, of = term[by], of[by]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(term)))
        weight = np.rint(_WEIGHT * (1 + np.log(times))).astype(np.int32)
        other = np.ones(len(first), bool)  # where the terms of another text begin
        other[1:] = of[first[1:]] != of[first[:-1]]
        owners, owner = of[first[other]], np.cumsum(other) - 1
        sums = np.zeros((len(owners), BITS), np.int64)
        for at in range(0, len(first), VOTE_TERMS):  # a long text's votes are added up in slices
            part = slice(at, at + VOTE_TERMS)
            bits = np.unpackbits(term[first[part]].astype(">u8").view(np.uint8)).reshape(-1, BITS)
            votes = (bits.astype(np.int32) * 2 - 1) * weight[part, None]
            begin = np.flatnonzero(other[part])
            begin = begin if other[at] else np.append(0, begin)
            sums[owner[part][begin]] += np.add.reduceat(votes, begin, axis=0)
        won = sums > 0
        out[row + owners] = np.packbits(won, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of bits that agree."""
    return 1 - np.bitwise_count(a ^ b).astype(np.float64) / BITS


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, fingerprint, and of the edited text its edited_sha256 and edited_fingerprint; near_edited and
    near_next compare the fingerprint with the edited text's and with the next document's.

    The texts are dealt once, compressed, by ranges of the id. Every range is read in order and hands out its rows but
    for the last, which needs the first text of the next range: the ends meet in a small table, two texts per range.
    """
    keyed = R.keyed(docs, doc_id, text)
    row = [keyed.schema["id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
           T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    schema = T.StructType([
        *row, T.StructField("part", T.IntegerType()), T.StructField("first_text", T.StringType()),
        T.StructField("last_text", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = part = None
        for batch in batches:
            texts = [R.unpacked(p.as_py()).decode("utf-8", "replace") for p in batch.column(1)]
            if not texts:
                continue
            prints = fingerprints(pa.array(texts, pa.string()))
            ids = batch.column(0)
            if held is None:
                first, part = texts[0], batch.column(2)[0].as_py()
            else:
                ids = pa.concat_arrays([held[0], ids])
                texts, prints = [held[1], *texts], np.concatenate([held[2], prints])
            if len(texts) > 1:
                yield _rows(ids.slice(0, len(texts) - 1), texts[:-1], prints[:-1], texts[1:], prints[1:], names)
            held = (ids.slice(len(texts) - 1), texts[-1], prints[-1:])
        if held is not None:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([
                held[0], *none, pa.array([part], pa.int32()), pa.array([first], pa.string()),
                pa.array([held[1]], pa.string())], names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            made = _rows(batch.column(0), texts, fingerprints(batch.column(1)), following, fingerprints(batch.column(2)), names)
            yield made.select(names[:len(row)])

    names = schema.names
    ordered = R.packed(keyed).repartitionByRange(partitions(docs.sparkSession), "id", "key").sortWithinPartitions("id", "key")
    walked = staged(ordered.select("id", "packed", F.spark_partition_id().alias("part")).mapInArrow(walk, schema), "simhash")
    ends = walked.filter("part IS NOT NULL")
    order = W.orderBy("part")  # numbers of ranges only, one row each
    following = ends.select("part").withColumn("next", F.coalesce(
        F.lead("part").over(order), F.min("part").over(W.partitionBy(F.lit(0)))))
    starts = ends.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"))
    met = ends.join(following, "part").join(starts, "next").select("id", "last_text", "next_text")
    whole = walked.filter("part IS NULL").select(*[f.name for f in row])
    return whole.unionByName(met.mapInArrow(finish, T.StructType(row)))


def _rows(ids, texts, prints, following, next_prints, names) -> pa.RecordBatch:
    edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    edited_prints = fingerprints(pa.array(edited, pa.string()))
    n = len(texts)
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited], pa.string()),
        pa.array([f"{p:016x}" for p in prints.tolist()], pa.string()),
        pa.array([f"{p:016x}" for p in edited_prints.tolist()], pa.string()),
        pa.array(likeness(prints, edited_prints)), pa.array(likeness(prints, next_prints)),
        pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names)


def block_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """For every choice of `blocks - radius` blocks: (table, the bits in them). Fingerprints within the radius share one."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(number).alias("table"), fingerprint.bitwiseAND(F.lit(mask)).alias("block")))
    return F.array(*keys)


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, n_near): for every query fingerprint, how many rows of `prints` lie within the radius.

    Both sides have a hexadecimal `fingerprint`. Equal ones are counted first, so a group of copies is one row.
    """
    number = F.shiftleft(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("bigint"), 32).bitwiseOR(
        F.conv(F.substring("fingerprint", 9, 8), 16, 10).cast("bigint"))
    counted = staged(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).select(
        "fingerprint", number.alias("bits"), "n"), "simhash-counts")
    asked = queries.select("fingerprint").distinct().select("fingerprint", number.alias("bits"))

    left = asked.select("fingerprint", F.col("bits").alias("q"), F.explode(block_keys(F.col("bits"), radius, blocks)).alias("at"))
    right = counted.select(F.col("bits").alias("r"), "n", F.explode(block_keys(F.col("bits"), radius, blocks)).alias("at"))
    pairs = left.select("fingerprint", "q", "at.table", "at.block").join(
        right.select("r", "n", "at.table", "at.block"), ["table", "block"])
    close = pairs.filter(F.bit_count(F.col("q").bitwiseXOR(F.col("r"))) <= radius)
    return close.groupBy("fingerprint", "r").agg(F.first("n").alias("n")).groupBy("fingerprint").agg(
        F.sum("n").alias("n_near"))
