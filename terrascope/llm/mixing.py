"""Mixing sources to target weights by hash thresholds.

Every document has a fixed point in 60 bits, the start of the MD5 of its id. A source that is to give a part of its
words gives the documents below a threshold. Words are summed by (source, bucket of points); the bucket in which the
budget runs out is cut into finer buckets, and only that one, until it holds one point. Nothing is sorted, budgets nest
(a smaller one takes a subset of a larger one's documents), and reruns take the same documents.

Defined results: a null or blank text has size 0; documents of one id share a point and are taken together; a source
without words has target 0; the document on which the budget runs out is taken when that brings the sum nearer to it
(a tie takes it); a document without words is taken as the others of its source are, `most` times at most; an empty
table gives an empty result; columns named like the results are replaced; a long text counts as one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
POINT_BITS = 60
STEP_BITS = 12


def point(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """(source, source_size) with `target`: `share` of all words by weight, none above `most` times its size.

    The weights repeat along the sources in the order of their code points, null last. What is over a source's limit
    goes to the others by weight, until none is over.
    """
    ordered = staged(_numbered(sources), "mix-sources")
    weight = F.lit(None).cast("double")
    for i, w in reversed(list(enumerate(weights))):
        weight = F.when(F.pmod(F.col("_rank"), F.lit(len(weights))) == i, F.lit(float(w))).otherwise(weight)
    weighed = ordered.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    # every round freezes the sources over their limit; the others share what is left
    level, frozen = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("_w") * level[0] / level[1] > F.col("_cap")
        total, kept, weight_left, n = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)), F.count(F.when(over, 1)),
        ).first()
        if n == frozen:
            break
        level, frozen = (float(total) * share - float(kept), float(weight_left) or 1.0), n
        if n and not weight_left:
            break
    shared = F.col("_w") * level[0] / level[1]
    return weighed.select("source", "source_size", F.least(shared, F.col("_cap")).alias("target"))


def _numbered(sources: DataFrame) -> DataFrame:
    """The rank of every source by code point, null last, without bringing all of them to one task."""
    placed = staged(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("_part", F.spark_partition_id()), "mix-order")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    offsets = counts.select("_part", before.alias("_before"))  # one row per partition
    return placed.join(offsets, "_part").select(
        "source", "source_size", (F.col("_before") + within - 1).alias("_rank"))


def thresholds(points: DataFrame, budgets: DataFrame, group: str = "source") -> DataFrame:
    """(group, `below`): take the points under `below`, so that their sizes come as near to `budget` as they can.

    `points`: group, point, size. `budgets`: group, budget, at most the size of the group. Each level sums sizes by
    bucket and keeps the one bucket in which the budget runs out; its points alone are summed at the next level.
    """
    # without a budget nothing is below: not even a blank document, which would cost no words
    marks = budgets.filter("budget > 0").select(group, F.lit(0).cast("bigint").alias("_low"), F.col("budget").cast("double").alias("_left"))
    width = POINT_BITS
    same = F.col(f"p.{group}").eqNullSafe(F.col(f"m.{group}"))
    by_bucket = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    while width > 0:
        finer = max(0, width - STEP_BITS)
        scale = 1 << finer
        inside = points.alias("p").join(
            marks.alias("m"),
            same & (F.col("p.point") >= F.col("m._low")) & (F.col("p.point") < F.col("m._low") + (1 << width)))
        sums = inside.select(
            F.col(f"p.{group}"), F.shiftright("p.point", finer).alias("_bucket"), "p.size", "m._left",
        ).groupBy(group, "_bucket", "_left").agg(F.sum("size").alias("_size"))
        reached = sums.withColumn("_upto", F.sum("_size").over(by_bucket)).filter(
            (F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_size") <= F.col("_left")) & (F.col("_size") > 0))
        marks = staged(reached.select(
            group, (F.col("_bucket") * F.lit(scale)).alias("_low"),
            (F.col("_left") - F.col("_upto") + F.col("_size")).alias("_left"), F.col("_size")), "mix-marks")
        width = finer
    nearer = F.col("_left") * 2 >= F.col("_size")  # with the last point the sum is as near or nearer
    return marks.select(group, F.when(nearer, F.col("_low") + 1).otherwise(F.col("_low")).alias("below"))


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken (size times copies).

    Sizes are counted once and staged without the texts. `copies` is the whole part of target / source_size, and one
    more below the source's threshold for the rest.
    """
    sized = staged(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_WORD)), F.lit(0)).cast("bigint").alias("size"),
        point(F.col(doc_id)).alias("point")), "mix-sizes")
    targets = staged(source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("_whole", whole.cast("bigint"))
    budgets = targets.select("source", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("budget"))
    below = thresholds(sized, budgets)
    plan = targets.alias("t").join(
        below.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left",
    ).select(F.col("t.source").alias("_source"), "source_size", "target", "_whole", "below")
    copies = F.col("_whole") + F.when(F.col("point") < F.coalesce(F.col("below"), F.lit(0)), 1).otherwise(0)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"), "_whole", F.coalesce(F.col("below"), F.lit(0)).alias("_below"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """The documents the mix takes, with their own columns; a document taken twice is there twice."""
    # staged, so that Spark knows that it is one row per source and sends it to the texts, not the texts to it
    plan = staged(mixed(docs, weights, share, most, doc_id, source, text).groupBy(
        F.col("source").alias("_mix_source")).agg(
            F.max("_whole").alias("_mix_whole"), F.max("_below").alias("_mix_below")), "mix-plan")
    copies = F.col("_mix_whole") + F.when(point(F.col(doc_id)) < F.col("_mix_below"), 1).otherwise(0)
    return (
        docs.join(plan, F.col(source).eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))))  # none for no copies
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
