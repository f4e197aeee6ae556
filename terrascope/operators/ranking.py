"""Exact order statistics and ranks that never gather one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

#: buckets for every doubling of a value: about 15 000 hold all prices from 1 000 to 30 million, and one of them at
#: 200 000 holds 135 neighbouring whole amounts
_STEPS = 1024
_SHIFT = 1100 * _STEPS  # more than the buckets below 1


def value_bucket(v: Column) -> Column:
    """A whole number that never falls when the value grows: the logarithm in steps, mirrored for negative values."""
    size = F.floor(F.log2(F.abs(v.cast("double"))) * _STEPS).cast("bigint") + _SHIFT
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def is_finite(c: Column) -> Column:
    """Neither NULL nor NaN nor infinite; NaN is greater than any number here."""
    x = c.cast("double")
    return (x < float("inf")) & (x > float("-inf"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, lower: bool = False) -> DataFrame:
    """Element n/2 (from 0) of the sorted finite values of every group, as `median`; of an even number of values the one
    before, where `lower` is asked for. Any number type; the values themselves are compared, none is rounded.

    Values are first counted per (group, value), which combines map-side and spreads a large group over all tasks.
    """
    counted = df.filter(is_finite(F.col(value))).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return median_of_counts(counted, keys, lower).select(*keys, "median")


def median_of_counts(counted: DataFrame, keys: Sequence[str], lower: bool = False, sums: Sequence[Column] = ()) -> DataFrame:
    """The median of every group from its counts: `counted` has the keys, values `_v` and how often each occurs, `_n`.

    `sums` are named aggregates over the rows of `counted`, added up with the counts and returned with the median. The
    bucket that holds the middle is found first, then the middle inside that bucket. The windows only see bucket
    counts and the values of one bucket, however many rows a group has.
    """
    bucketed = counted.withColumn("_hi", value_bucket(F.col("_v")))
    levels = bucketed.groupBy(*keys, "_hi").agg(F.sum("_n").alias("_n"), *sums)
    found, names = _middle(levels, keys, lower)
    inside = _inside(_whole(bucketed, keys), found, keys, "_hi", names)
    return _bucket(inside, keys, "_v", names).select(*keys, F.col("_v").alias("median"), *names)


def median_over_places(
    counted: DataFrame, places: DataFrame, place: str, keys: Sequence[str], lower: bool = False, sums: Sequence[Column] = (),
) -> DataFrame:
    """`median_of_counts` of groups that a place belongs to, where one place may belong to several and more than once.

    `counted` has the place, values `_v` and counts `_n`; `places` has the place, the group's keys and how often it
    belongs to that group, `_times`, which `sums` may use too. Values meet the groups twice: as counts by bucket, and only
    those of the bucket that holds the middle as they are; so no table of all values of all groups is made.
    """
    bucketed = counted.withColumn("_hi", value_bucket(F.col("_v")))
    n = F.sum(F.col("_n") * F.col("_times")).alias("_n")
    levels = bucketed.join(places, place).groupBy(*keys, "_hi").agg(n, *sums)
    found, names = _middle(levels, keys, lower)
    right = found.select(*[F.col(k).alias(f"_r_{k}") for k in (*keys, "_hi")], *names, "_rank")
    wanted = places.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]).withColumnRenamed(place, "_place")
    whole = _whole(bucketed, [place]).select(place, "_hi", "_v", "_n")
    same = [F.col(place) == F.col("_place"), F.col("_hi").eqNullSafe(F.col("_r__hi"))]
    inside = whole.join(wanted, same).groupBy(*keys, "_v").agg(n, *[F.max(c).alias(c) for c in (*names, "_rank")])
    return _bucket(inside, keys, "_v", names).select(*keys, F.col("_v").alias("median"), *names)


def _middle(levels: DataFrame, keys: Sequence[str], lower: bool) -> tuple[DataFrame, list[str]]:
    """The bucket that holds the middle of each group, with the sums of the group, and their names."""
    names = [c for c in levels.columns if c not in (*keys, "_hi", "_n")]
    group = W.partitionBy(*keys)
    total = F.sum("_n").over(group)
    middle = F.floor((total + 1) / 2).cast("bigint") if lower else F.floor(total / 2).cast("bigint") + 1
    ranked = levels.select(*keys, "_hi", "_n", middle.alias("_rank"), *[F.sum(c).over(group).alias(c) for c in names])
    return _bucket(ranked, keys, "_hi", names), names


def _whole(bucketed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, by a test that is true of each; without it, Spark would leave other columns out where only values and
    counts are used, and count all rows a second time."""
    held = [c for c in bucketed.columns if c not in (*keys, "_v", "_n", "_hi")]
    return bucketed.filter(F.hash(*held) >= F.lit(-(1 << 31))) if held else bucketed


def _bucket(levels: DataFrame, keys: Sequence[str], bucket: str, names: Sequence[str] = ()) -> DataFrame:
    """The bucket of each group in which rank `_rank` falls, with the rank left inside it."""
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0))
    return (
        levels.withColumn("_upto", upto)
        .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        .select(*keys, bucket, *names, (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )


def _inside(
    counted: DataFrame, found: DataFrame, keys: Sequence[str], bucket: str, sums: Sequence[str] = ()
) -> DataFrame:
    names = [*keys, bucket]
    right = found.select(*[F.col(n).alias(f"_r_{n}") for n in names], *sums, "_rank")
    # a plain equality would push a not-NULL test into this scan only, and Spark could not reuse the counts
    same = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return counted.select(*names, *[c for c in ("_v", "_n") if c not in names]).join(right, same).drop(
        *[f"_r_{n}" for n in names])


def rank_in_groups(df: DataFrame, group: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in its group, for groups of any size.

    Rows are range-partitioned by (group, order) and checkpointed, so a large group spans many partitions;
    each partition ranks its own slice, and the slice sizes before it are added.
    """
    ranged = checkpointed(
        df.repartitionByRange(F.col(group), *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = ranged.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(
        F.col(group).alias("_group"), F.col("_slice").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before")
    )
    local = F.row_number().over(W.partitionBy(group, "_slice").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_s")))
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_local", "_group", "_s", "_before")
    )


def top_in_groups(df: DataFrame, group: str, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First `n` rows of each group; Spark keeps only `n` per group and task before the shuffle."""
    position = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn(name, position).filter(F.col(name) <= n)
