"""Exact Jaccard join of word shingles, linked into classes.

1. Equal sets are one set, known by a 64-bit hash.
2. In one order of all shingles (by hash, the very common last), two sets as similar as asked share one of their first
   shingles. Shingles that only one set has among its first are dropped; the others list the sets that may link.
3. A signature tree over each list drops pairs by sizes and bitmaps and joins the rest into candidate classes. A list
   too long for a tree joins as it is: a candidate class may be too large, never too small.
4. The sets of a candidate class meet in one task, or in blocks where the class is large, and a signature tree with
   exact intersections links them.

Classes, not pairs, are passed on: every tree hands out at most one link per set.

Defined results: a null or blank text has an empty set and is linked with nothing; fewer words than a shingle are one
shingle, the whole sequence; equal sets link, whatever their texts; rows of one id are rows of their own and get the
least id of their class; a null id is less than none: it is ignored as the least id unless all ids of the class are
null; an empty table gives no rows; columns other than id and text are ignored; a long text is one set, cut in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import regions as R
from .common import (
    RangeHash, free_name, lowered, partitions, released, signed, space_separated, staged, staged_in_slices, text_chunks,
    word_hashes, words,
)
from .components import connected
from .signature_tree import Classes, bitmap, link

SHINGLE, PERCENT = 5, 80
COMMON = 0.002  # share of the texts from which on a shingle goes to the end of the order
LIST_SETS = 1000  # sets in a list that a candidate tree takes
BLOCK_SETS, BLOCK_BYTES = 4000, 4 << 20  # sets and packed text in one block of a class
BITMAP_WORDS = 128  # 64-bit words of the largest bitmap that travels
SLICES = 4  # parts in which shingles, and then texts, are shuffled one after the other


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, sorted and distinct within each text; limits of the texts)."""
    starts, ends, limits = words(space_separated(data), offsets)
    hashed = RangeHash(word_hashes(lowered(data), starts, ends))
    count = np.diff(limits)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    first = limits[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    tokens = hashed.of(first, np.minimum(first + size, limits[1:][text]))
    by = np.argsort(tokens, kind="stable")
    by = by[np.argsort(text[by], kind="stable")]
    tokens, text = tokens[by], text[by]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    return tokens[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def common_shingles(docs: DataFrame, size: int, share: float) -> list[int]:
    """Shingles in `share` of the texts or more, the most frequent last.

    Each task counts all shingles of its batches and reports those frequent there. At most (mean shingles per text) /
    share can be so frequent, whatever the number of texts; they only set the order, so the result does not depend on
    them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [shingle_sets(data, offsets, size)[0] for _, data, offsets in text_chunks(batch.column(0))]
            seen, n = np.unique(np.concatenate(tokens) if tokens else np.empty(0, np.uint64), return_counts=True)
            often = n >= max(4, share * batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(seen[often])), pa.array(n[often].astype(np.int64))], ["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token long, n long")
    total = docs.count()
    rows = counted.groupBy("token").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= max(4, share * total)).orderBy("n", "token").collect()
    return [r["token"] for r in rows]


def prefixes(docs: DataFrame, size: int, percent: int, last: list[int]) -> DataFrame:
    """id, key, n (set size), set (hash of the set), bits (bitmap) and the first shingles of every text."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(last, np.int64).view(np.uint64))
    schema = T.StructType([
        docs.schema["id"], docs.schema["key"], T.StructField("n", T.LongType()), T.StructField("set", T.LongType()),
        T.StructField("bits", T.BinaryType()), T.StructField("first", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash = np.argsort(sent.value)
        common = sent.value[by_hash]
        for batch in batches:
            n, sets, bits, first = [], [], [], []
            for _, data, offsets in text_chunks(batch.column(2)):
                tokens, limits = shingle_sets(data, offsets, size)
                hashed = RangeHash(tokens).of(limits[:-1], limits[1:])
                place = np.searchsorted(common, tokens)
                place[place == len(common)] = 0
                often = common[place] == tokens if len(common) else np.zeros(len(tokens), bool)
                for a, b, whole in zip(limits[:-1].tolist(), limits[1:].tolist(), signed(hashed).tolist(), strict=True):
                    own, rare = tokens[a:b], ~often[a:b]
                    take = (b - a) - -(-percent * (b - a) // 100) + 1 if b > a else 0
                    chosen = own[rare][:take]
                    if len(chosen) < take:
                        late = np.flatnonzero(often[a:b])
                        late = late[np.argsort(by_hash[place[a:b][late]], kind="stable")]
                        chosen = np.concatenate([chosen, own[late][:take - len(chosen)]])
                    n.append(b - a)
                    sets.append(whole if b > a else None)
                    bits.append(bitmap(own, _bitmap_words(b - a)).tobytes())
                    first.append(signed(chosen))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.int64()),
                pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))], schema.names)

    return docs.select("id", "key", "text").mapInArrow(cut, schema)


def _bitmap_words(n: int) -> int:
    words_needed = 1
    while words_needed * 64 < n and words_needed < BITMAP_WORDS:
        words_needed *= 2
    return words_needed


def _linked_lists(sizes: np.ndarray, raw: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links between sets of one list. Sets are compared by bitmaps of one width; wider bitmaps are OR-folded. A set has
    more than half the bits of its width, so similar sets have widths of a ratio under 200 / percent."""
    width = np.array([len(b) // 8 for b in raw])
    classes, links = Classes(len(raw)), []
    for w in np.unique(width):
        here, wider = np.flatnonzero(width == w), np.flatnonzero((width > w) & (percent * width < 200 * w))
        bits = np.zeros((len(raw), w), np.uint64)
        bits[here] = np.frombuffer(b"".join(raw[i] for i in here), np.uint64).reshape(-1, w)
        here = here[np.lexsort((sizes[here], bits[here, 0]))]
        links += link(sizes, bits, here, percent, classes)
        if len(wider):
            for v in np.unique(width[wider]):
                at = wider[width[wider] == v]
                parts = np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(-1, v // w, w)
                bits[at] = np.bitwise_or.reduce(parts, axis=1)
            links += link(sizes, bits, here, percent, classes, others=wider)
    return links


def candidate_links(prefixed: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets that may be similar; their classes hold every similar pair. `prefixed` is staged, and read
    here for the last time.

    The shingles are shuffled a slice at a time. One that only equal sets have is dropped, however many these are.
    """
    info = staged(prefixed.filter("n > 0").groupBy("set").agg(
        F.first("n").alias("n"), F.first("bits").alias("bits")), "jaccard-info")
    firsts = prefixed.filter("n > 0").select("set", F.explode("first").alias("token"))
    again = []

    def lists(inside: Callable[..., Column]) -> DataFrame:
        some = firsts.filter(inside("token"))
        again.append(staged(some.groupBy("token").agg(F.min("set").alias("least"), F.max("set").alias("most")).filter(
            "least < most").select("token", "least"), "jaccard-again"))
        return some.join(again[-1], "token").distinct()

    shared = staged_in_slices(lists, "jaccard-shared", SLICES)
    released(prefixed, *again)
    lengths = staged(shared.groupBy("token").agg(F.count(F.lit(1)).alias("sets")), "jaccard-lengths")
    sized = staged(shared.join(lengths, "token").select("token", "set", "sets", "least"), "jaccard-lists")
    released(shared, lengths)

    stars = sized.filter((F.col("sets") > LIST_SETS) & (F.col("set") != F.col("least"))).select(
        F.col("least").alias("a"), F.col("set").alias("b")).distinct()
    lists = sized.filter(F.col("sets") <= LIST_SETS).groupBy("token").agg(
        F.array_sort(F.collect_list("set")).alias("members")).groupBy("members").agg(F.min("token").alias("list"))
    members = lists.select("list", F.explode("members").alias("set"))
    described = staged(members.join(info, "set").select("list", "set", "n", "bits"), "jaccard-members")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["list"]):
            links = _linked_lists(np.array([r["n"] for r in rows], np.int64), [r["bits"] for r in rows], percent)
            if links:
                yield pa.RecordBatch.from_arrays([
                    pa.array([rows[i]["set"] for i, _ in links], pa.int64()),
                    pa.array([rows[j]["set"] for _, j in links], pa.int64())], ["a", "b"])

    dealt = described.repartition(partitions(prefixed.sparkSession), "list").sortWithinPartitions("list")
    links = staged(dealt.mapInArrow(trees, "a long, b long").unionByName(stars).distinct(), "jaccard-candidates")
    released(info, sized, described)
    return links


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """The rows of each value of the sorted columns, one group at a time."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[n] for n in names)
            if held and now != key:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


def _exact(rows: DataFrame, group: list[str], size: int, percent: int) -> DataFrame:
    """Links (a, b) inside each group of rows (group columns, set, start, packed). Rows of one `start` are linked
    already."""
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, group):
            if len(held) < 2:
                continue
            tokens = [_set_of(r["packed"], size) for r in held]
            sizes = np.array([len(t) for t in tokens], np.int64)
            width = 1
            while width * 64 < 2 * sizes.mean() and width < 256:
                width *= 2
            bits = np.array([bitmap(t, width) for t in tokens])
            classes, leader = Classes(len(held)), {}
            for i, r in enumerate(held):
                classes.join(leader.setdefault(r["start"], i), i)

            def same(i: int, j: int) -> bool:
                both = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))  # noqa: B023
                return 100 * both >= percent * (sizes[i] + sizes[j] - both)  # noqa: B023

            order = np.lexsort((sizes, np.array([t[0] for t in tokens])))
            links = link(sizes, bits, order, percent, classes, same)
            if links:
                yield pa.RecordBatch.from_arrays([
                    pa.array([held[i]["set"] for i, _ in links], pa.int64()),
                    pa.array([held[j]["set"] for _, j in links], pa.int64())], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.select(*group, "set", "start", "packed").mapInArrow(trees, "a long, b long")


def _set_of(packed: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(R.unpacked(packed), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), size)[0]


def exact_links(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between similar sets of one candidate class. `members`: class, set, packed; staged, and removed once dealt.

    A class over one block is linked block by block.
    """
    weight = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum(F.length("packed")) / BLOCK_BYTES)
    blocks = staged(members.groupBy("class").agg(F.ceil(weight).cast("int").alias("blocks")), "jaccard-blocks")
    dealt = staged(members.join(blocks, "class").withColumn(
        "block", F.pmod(F.hash("set"), "blocks")), "jaccard-dealt")
    released(members, blocks)
    links = _links_of_blocks(dealt.withColumn("start", F.col("set")), size, percent)
    released(dealt)
    return links


def _links_of_blocks(dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside the blocks, then over one leader of each linked part. Where a class is one part now, as a large group
    of near copies is, nothing is left to do. Else the sets outside its largest part (`rest`) meet the other blocks, a
    block of them at a time, so every pair of two parts is looked at."""
    links = staged(_exact(dealt, ["class", "block"], size, percent), "jaccard-links")
    large = dealt.filter("blocks > 1").drop("start")
    if large.isEmpty():
        return links

    parts = _labelled(large, links)
    leaders = parts.filter("set = start").withColumn(
        "block", F.pmod(F.hash("start"), F.ceil(F.col("blocks") / F.lit(8)).cast("int")))
    links = staged(links.unionByName(_exact(leaders, ["class", "block"], size, percent)), "jaccard-links")
    parts = staged(_labelled(large, links), "jaccard-parts")
    most = staged(parts.groupBy("class", "start").count().groupBy("class").agg(
        F.max_by("start", F.struct("count", "start")).alias("main")), "jaccard-main")
    placed = parts.join(most, "class")
    rest = placed.filter("start != main").withColumnRenamed("block", "of").drop("main")
    if rest.isEmpty():
        return links
    asked = rest.select("class", "of").distinct()
    base = placed.drop("main").join(asked, "class").filter("block != of")
    others = parts.select("class", "block").distinct()
    guests = rest.join(others, "class").filter("block != of")
    names = ["class", "block", "of", "set", "start", "packed"]
    met = base.select(*names).unionByName(guests.select(*names))
    return staged(links.unionByName(_exact(met, ["class", "block", "of"], size, percent)), "jaccard-links")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with `start`: the least set that links lead to."""
    roots = connected(links, "a", "b")
    return rows.join(roots, rows["set"] == roots["node"], "left").withColumn(
        "start", F.coalesce("root", "set")).drop("node", "root")


def similar_classes(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
    common: float = COMMON,
) -> DataFrame:
    """One row per document: id, key, n_shingles, component_id (the least id that links of similarity `percent` / 100
    or more lead to; its own id for an empty set) and class (a hash of the component; null for an empty set)."""
    keyed = R.keyed(docs, doc_id, text)
    last = common_shingles(keyed, size, common)
    prefixed = staged(prefixes(keyed, size, percent, last), "jaccard-prefixes")
    rows = staged(prefixed.select("id", "key", "n", "set"), "jaccard-rows")
    candidates = connected(candidate_links(prefixed, percent), "a", "b")

    one_each = rows.filter("n > 0").groupBy("set").agg(F.min(F.struct("id", "key")).alias("at"))
    chosen = staged(candidates.join(one_each, candidates["node"] == one_each["set"]).select(
        "set", "at.*", F.col("root").alias("class")), "jaccard-chosen")

    def met(inside: Callable[..., Column]) -> DataFrame:
        here = inside("key", R.owner())
        found = R.with_texts(chosen.filter(here), keyed.filter(here), "set", "class").dropDuplicates(["key", "of"])
        return found.select("packed", F.explode("places").alias("p")).select(
            F.col("p.class").alias("class"), F.col("p.set").alias("set"), "packed")

    members = staged_in_slices(met, "jaccard-met", SLICES)
    roots = connected(exact_links(members, size, percent), "a", "b")

    labelled = staged(rows.join(roots, F.col("set") == F.col("node"), "left").select(
        "id", "key", "n", F.coalesce("root", "set").alias("root")), "jaccard-labels")
    released(rows, chosen)
    least = staged(labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")), "jaccard-least")
    return labelled.join(least, "root", "left").select(
        "id", "key", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"),
        F.col("root").alias("class"))


def distinct_documents(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One document of each class, the one with the least id, with its own columns.

    Documents without words all stay. Rows equal in id and text stay once.
    """
    found = similar_classes(docs, size, percent, doc_id, text)
    kept = found.filter("class IS NULL OR id <=> component_id").groupBy(
        "class", F.when(F.col("class").isNull(), F.struct("key", R.owner())).alias("blank")).agg(
            F.min(F.struct("key", R.owner().alias("of"))).alias("at"))
    key, of, kept_key, kept_of = (free_name(docs, f"_jaccard_{c}") for c in ("key", "of", "kept_key", "kept_of"))
    keep = staged(kept.select(F.col("at.key").alias(kept_key), F.col("at.of").alias(kept_of)), "jaccard-keep")
    named = docs.withColumns({key: R.row_key(F.col(doc_id), F.col(text)), of: R.owner(F.col(doc_id))})
    return named.join(keep, (F.col(key) == F.col(kept_key)) & (F.col(of) == F.col(kept_of))).dropDuplicates([key, of]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
