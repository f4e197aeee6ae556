"""Benchmark decontamination by Wu-Manber search over words.

The test strings of a window length share one searcher. A table over blocks of two words tells how far the search may
jump; where it may not jump, the block (the suffix of the strings that can end here) and then their first block select
the strings that are compared with the text. Words are numbered by the benchmark's vocabulary; other words are 0 and
let the search jump a whole window.

Defined results: a null text has no words; a null or empty item occurs nowhere; an item with a null id marks words but
is not listed; items of one id count once; equal documents get equal results; a column named like the result is
replaced; with no items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, staged

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
BLOCK_BYTES = 4 << 20  # benchmark text that one pass holds in memory
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string())),
])


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class Searcher:
    """Wu-Manber tables for test strings of one length, over numbered words."""

    def __init__(self, strings: dict[tuple[int, ...], set], vocabulary: int):
        self.size = len(next(iter(strings)))
        self.base = vocabulary + 1
        self.block = min(2, self.size)
        self.jump = self.size - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, dict[tuple[int, ...], set]]] = {}
        for string, items in strings.items():
            for end in range(self.block, self.size + 1):
                key = self._key(string, end)
                self.shift[key] = min(self.shift.get(key, self.jump), self.size - end)
            bucket = self.buckets.setdefault(self._key(string, self.size), {})
            bucket.setdefault(self._key(string, self.block), {})[string] = items

    def _key(self, ids, end: int) -> int:
        return ids[end - 1] if self.block == 1 else ids[end - 2] * self.base + ids[end - 1]

    def find(self, ids: list[int]) -> Iterator[tuple[int, set]]:
        """(first word, items) of every occurrence, from left to right."""
        shift, jump, base, size, single = self.shift.get, self.jump, self.base, self.size, self.block == 1
        end, n = size, len(ids)
        while end <= n:
            key = ids[end - 1] if single else ids[end - 2] * base + ids[end - 1]
            step = shift(key, jump)
            if step:
                end += step
                continue
            start = end - size
            strings = self.buckets[key].get(self._key(ids, start + self.block))
            if strings:
                items = strings.get(tuple(ids[start:end]))
                if items is not None:
                    yield start, items
            end += 1


class Index:
    """Searchers for all windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], set]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(ids[start:start + size], set()).add(item)
        self.searchers = [Searcher(strings, len(self.vocabulary)) for _, strings in sorted(by_size.items())]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, hit spans, items)."""
        known = self.vocabulary.get
        ids = [known(w, 0) for w in words(text)]
        spans, found = [], set()
        for searcher in self.searchers:
            for start, items in searcher.find(ids):
                found |= items
                spans.append((start, start + searcher.size - 1))
        found.discard(None)
        return len(ids), spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def blocks_of(items: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of `limit` bytes of text, one at a time (an item over the limit comes alone)."""
    block, held = [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        size = len(row[1] or "")
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    yield block


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", result: str = "contamination", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents with a struct `result`: n_words, n_hit, spans of hit words (first, last) and items (sorted ids).

    A window is `window` consecutive words of an item; an item of fewer words is one window. The documents are not
    shuffled. The items are the query set: a block of them at a time is sent to all tasks, and each further block is
    one more pass whose input is the staged result of the pass before.
    """
    out, passes = docs.drop(result), 0
    for block in blocks_of(items, item_id, item_text, block_bytes):
        out = _scan(staged(out, "contamination") if passes else out, block, window, text, result)
        passes += 1
    return out


def _scan(docs: DataFrame, block: list[tuple], window: int, text: str, result: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([f for f in docs.schema.fields if f.name != result] + [T.StructField(result, RESULT)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, window)
        for batch in batches:
            names = batch.schema.names
            before = batch.column(names.index(result)).to_pylist() if result in names else [None] * batch.num_rows
            rows = []
            for doc, old in zip(batch.column(names.index(text)), before, strict=True):
                n, spans, found = index.scan(doc.as_py())
                if old:
                    spans += [(s["first"], s["last"]) for s in old["spans"]]
                    found |= set(old["items"])
                spans = merged(spans)
                rows.append({
                    "n_words": n, "n_hit": sum(last - first + 1 for first, last in spans),
                    "spans": [{"first": first, "last": last} for first, last in spans], "items": sorted(found),
                })
            kept = [i for i, name in enumerate(names) if name != result]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(rows, _ARROW)], [names[i] for i in kept] + [result])

    return docs.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, **names) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    result = free_name(docs, "_contamination")
    found = find_contamination(docs, items, window, result=result, **names)
    return found.filter(F.col(f"`{result}`.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
