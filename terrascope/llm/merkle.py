"""Merkle manifest of a data set by time-forward processing.

Every row is a leaf; leaves ascend by id inside their group; runs of `FANOUT` neighbours become the digest of their
concatenation, level by level, until a group has one subroot; the subroots, in the order of their groups, become the
root in the same way.

Nodes are processed in the order of their labels, and a node hands its result to the nodes that need it as messages in a
priority queue ordered by label. The queue is external: between blocks of `FANOUT ** LEVELS` neighbours it is a table in
the shared folder that Spark partitions by block and sorts by label (spilling as it must), and every round takes the
messages of one band of `LEVELS` levels out of it and puts those of the next band in. Inside a block a heap delivers the
messages; as labels are in post-order (last leaf below, level), the heap holds at most `FANOUT` messages a level. The
reversed sweep takes the same tables from the root down: a node hands to each child its own proof suffix with the
child's siblings in front, so that every leaf ends with its whole proof.

No task sees more than a block of digests at once, however large a group is. Rounds: log of the largest group to base
`FANOUT ** LEVELS`; each moves digests only, never texts, and is written to the shared folder, so a lost executor
repeats one round at most.

Defined results: a null field is `-`, an empty one `0:`; null groups come first and are one group; null ids come first in
their group; rows with one id are ordered by digest, so the result does not depend on where equal rows stand; a lone
leaf is its own subroot, a lone subroot the root (its proof is empty); an empty table has no rows; columns of the input
that are not asked for do not take part; a long text is hashed as a stream of one row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
LEVELS = 3  # of one block: 512 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
ARROW_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def field_text(c: Column) -> Column:
    """A value with its length in front, so that no two rows read alike: `-` for null, else bytes, `:`, value."""
    value = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]), 256)


def digest_of(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_above(n: int) -> int:
    """How often n neighbours must be joined until one is left."""
    levels = 0
    while n > 1:
        n, levels = (n + FANOUT - 1) >> FANOUT_BITS, levels + 1
    return levels


def _label(index: int, level: int) -> tuple[int, int]:
    """Post-order: the last leaf below a node, then its level."""
    return ((index + 1) << FANOUT_BITS * level) - 1, level


def forward_sweep(digests: Sequence[str], top: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest of a block's top node, `top` levels up, and the children's digests of every inner node by label."""
    queue: list[tuple[tuple[int, int], int, str]] = []
    runs: dict[tuple[int, int], list[str]] = {}
    result = ""

    def send(index: int, level: int, digest: str) -> None:
        nonlocal result
        if level == top:
            result = digest
        else:
            heapq.heappush(queue, (_label(index >> FANOUT_BITS, level + 1), index, digest))

    def settle() -> None:
        label, children = queue[0][0], []
        while queue and queue[0][0] == label:
            children.append(heapq.heappop(queue)[2])
        runs[label] = children
        send(((label[0] + 1) >> FANOUT_BITS * label[1]) - 1, label[1], digest_of(children))

    for index, digest in enumerate(digests):
        while queue and queue[0][0] < (index, 0):
            settle()
        send(index, 0, digest)
    while queue:
        settle()
    return result, runs


def reverse_sweep(size: int, top: int, runs: dict[tuple[int, int], list[str]], suffix: list[tuple[str, str]]) -> list[list]:
    """The proof of each of a block's `size` leaves: (left, right) siblings from the leaf to the root.

    `suffix` is the proof of the block's top node.
    """
    proofs: list[list] = [[]] * size
    last, level = _label(0, top)
    queue = [((-last, -level), 0, ())]  # a proof is a chain (step, the rest); the suffix is added at the leaves
    while queue:
        (last, level), index, chain = heapq.heappop(queue)
        if level == 0:
            steps = []
            while chain:
                steps.append(chain[0])
                chain = chain[1]
            proofs[index] = steps + suffix
            continue
        children = runs[-last, -level]
        for slot in range(len(children)):
            child = (index << FANOUT_BITS) + slot
            below, at = _label(child, -level - 1)
            step = "".join(children[:slot]), "".join(children[slot + 1:])
            heapq.heappush(queue, ((-below, -at), child, (step, chain)))
    return proofs


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows of whole blocks, in order, with the starts of the blocks and the end; memory: a batch and a block."""
    held: pa.Table | None = None

    def starts(rows: pa.Table) -> list[int]:
        tree, block = (np.asarray(rows.column(c)) for c in ("tree", "block"))
        return [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        cuts = starts(held)
        if len(cuts) > 1:
            yield held.slice(0, cuts[-1]), cuts
            held = held.slice(cuts[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def _dealt(rows: DataFrame) -> DataFrame:
    """Messages by block, each block in the order of its labels, a message from above first."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "index")


def _blocks(queue: DataFrame) -> DataFrame:
    return queue.filter("n > 1").withColumns({
        "block": F.shiftright("index", FANOUT_BITS * LEVELS), "kind": F.lit(1)})


def _next_band(queue: DataFrame) -> DataFrame:
    """tree, index, n, digest of the nodes `LEVELS` levels up (or of a tree's top, if that is nearer)."""
    schema = "tree bigint, index bigint, n bigint, digest string"

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_blocks(batches):
            tree, block, n = (rows.column(c).to_pylist() for c in ("tree", "block", "n"))
            digests = rows.column("digest").to_pylist()
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                top = min(LEVELS, levels_above(n[a]))
                digest, _ = forward_sweep(digests[a:b], top)
                out.append((tree[a], block[a], -(-n[a] // FANOUT ** top), digest))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[i], pa.int64()) for i in range(3)] + [pa.array(columns[3], pa.string())],
                ["tree", "index", "n", "digest"])

    return _dealt(_blocks(queue).select("tree", "block", "kind", "index", "n", "digest")).mapInArrow(climb, schema)


def sweep_up(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """The queue's tables (tree, index, n, digest), from the leaves to the bands above; n counts a tree's nodes there.

    A tree is done where n is 1: that node is its top.
    """
    bands = [leaves]
    while largest > 1:
        bands.append(staged(_next_band(bands[-1]), "merkle-band"))
        largest = -(-largest // FANOUT ** LEVELS)
    return bands


def tops(bands: list[DataFrame]) -> DataFrame:
    """tree and digest of every tree's top node."""
    done = [b.filter("n = 1").select("tree", "digest") for b in bands]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _proofs_of(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of trees with several nodes, with `steps`, `subroot` and `root` handed down from their blocks' tops."""
    own = [f for f in nodes.schema.fields if f.name not in ("steps", "subroot", "root")]
    schema = T.StructType([*own, T.StructField("steps", STEPS), T.StructField("subroot", T.StringType()),
                           T.StructField("root", T.StringType())])
    messages = above.select(
        "tree", F.col("index").alias("block"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("index"), "steps",
        "subroot", "root")
    rows = _dealt(_blocks(nodes).unionByName(messages, allowMissingColumns=True))

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_blocks(batches):
            n, digests = rows.column("n").to_pylist(), rows.column("digest").to_pylist()
            lefts, rights, ends, subroots, roots = [], [], [0], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                head = rows.slice(a, 1)
                suffix = [(s["left"], s["right"]) for s in head.column("steps")[0].as_py()]
                top = min(LEVELS, levels_above(n[a + 1]))
                _, runs = forward_sweep(digests[a + 1:b], top)
                for steps in reverse_sweep(b - a - 1, top, runs, suffix):
                    lefts.extend(s[0] for s in steps)
                    rights.extend(s[1] for s in steps)
                    ends.append(len(lefts))
                subroots += head.column("subroot").to_pylist() * (b - a - 1)
                roots += head.column("root").to_pylist() * (b - a - 1)
            steps = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(ARROW_STEP)))
            below = rows.filter(pc.equal(rows.column("kind"), 1)).combine_chunks()
            columns = [below.column(f.name).combine_chunks() for f in own]
            columns += [steps, pa.array(subroots, pa.string()), pa.array(roots, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return rows.mapInArrow(hand_down, schema)


def sweep_down(bands: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The lowest band's rows with their proofs; `heads` has tree, steps, subroot and root of every tree's top."""
    def done(band: DataFrame) -> DataFrame:
        return band.filter("n = 1").join(heads, "tree")

    told = done(bands[-1])
    for k in range(len(bands) - 2, -1, -1):
        below = _proofs_of(bands[k], told).unionByName(done(bands[k]))
        told = staged(below.select("tree", "index", "steps", "subroot", "root"), "merkle-told") if k else below
    return told


def _numbered(rows: DataFrame, group: str | None, order: Sequence[str], name: str) -> DataFrame:
    """The rows with `index`, their position in their group, from 0, by `order` (nulls first).

    Rows are range-partitioned and sorted, numbered inside their partition while they are written, and the sizes of the
    partitions before are added; `order` must tell all rows apart, so that no crowd of equal rows shares a partition.
    """
    by = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + list(order)]
    written = staged(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    key = F.col(group) if group else F.lit(0)
    at = written.withColumn("_slice", F.shiftright("_at", 33)).withColumn("_group", key)
    slices = at.groupBy("_group", "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = staged(slices.select(
        F.col("_group").alias("_g"), F.col("_slice").alias("_s"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), f"{name}-slices")
    joined = at.join(offsets, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn("index", F.col("_at") + F.col("_shift")).drop(
        "_at", "_slice", "_group", "_g", "_s", "_shift", *order[-1:])


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
    carry: Sequence[Column | str] = (),
) -> DataFrame:
    """One row per input row: the `carry` columns and a struct `merkle` of leaf, subroot, root and proof.

    `proof` lists (left, right), the siblings' digests on either side, from the leaf to the root; `replayed` folds a
    digest through it, `proof_text` is all of it.
    """
    carried = F.struct(*(carry or [order]))
    leaves = staged(docs.select(
        F.col(group).alias("group"), F.col(order).alias("id"), leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
        carried.alias("carried"), F.monotonically_increasing_id().alias("seq")), "merkle-leaves")
    groups = staged(leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "merkle-groups")
    trees = staged(_numbered(groups.withColumn("one", F.lit(0)), None, ["group", "one"], "merkle-trees").select(
        F.col("group").alias("of"), F.col("n"), F.col("index").alias("tree")), "merkle-tree-numbers")
    numbered = _numbered(leaves, "group", ["id", "digest", "seq"], "merkle-ordered").join(
        trees, F.col("group").eqNullSafe(F.col("of"))).select("tree", "index", "n", "digest", "carried")
    numbered = staged(numbered, "merkle-queue")
    count, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()

    bands = sweep_up(numbered, largest or 0)
    subroots = tops([b.select("tree", "n", "digest") for b in bands]).select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("bigint").alias("n"), "digest")
    over = sweep_up(staged(subroots, "merkle-subroots"), count)
    no_steps = F.array().cast(STEPS)
    root = tops(over).select(
        "tree", no_steps.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    heads = staged(sweep_down(over, root).select(
        F.col("index").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"), "merkle-heads")
    proved = sweep_down(bands, heads)
    own = [f"carried.{f.name}" for f in proved.schema["carried"].dataType.fields if f.name != "merkle"]
    return proved.select(*own, F.struct(
        F.col("digest").alias("leaf"), "subroot", "root", F.col("steps").alias("proof")).alias("merkle"))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def replayed(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest gives with a proof."""
    return F.aggregate(proof, leaf, lambda held, s: F.sha2(F.concat(s["left"], held, s["right"]), 256))
