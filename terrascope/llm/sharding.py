"""Sharding by fixed virtual slots.

A record is hashed into one of thousands of slots. Bytes are summed per slot, and a table of one row per slot says which
shard has it, also for slots without records yet. The table is versioned: a run with a stored version keeps its places;
when the number of shards changes, rebalancing writes a new version that moves a few slots, and the records need no new
hash. Shards come out near equal in bytes.

Defined results: a null text has no bytes (size 1), and its CRC is that of no bytes; equal records share a slot; ties
between slots go by slot number, ties between shards by shard number; an empty table gives no rows; columns named like
the results are replaced; a long text is one record. Records with equal texts and different ids are records of their
own: what is held together is a record's slot, not a group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

SLOTS = 4096
SHARDS = 8
RUN = 1 << 14  # equal records that one row of a run gives


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: 60 bits of the MD5 of its id and its text's CRC, modulo the number of slots."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_crc32(text).cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_bytes(sized: DataFrame) -> DataFrame:
    """Bytes and records of every slot that has any: at most one row per slot."""
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def every_slot(by_slot: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and records of all slots; one without records weighs a byte, so that empty slots are dealt evenly."""
    return by_slot.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(
        by_slot, "virtual_slot", "left").select(
            "virtual_slot", F.coalesce("bytes", F.lit(1).cast("bigint")).alias("bytes"),
            F.coalesce("records", F.lit(0).cast("bigint")).alias("records"))


def balanced_map(by_slot: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(virtual_slot, shard): the largest slot first, each to the shard with the fewest bytes so far.

    The table has one row per slot, thousands at most, and is folded as one array.
    """
    ordered = by_slot.agg(F.sort_array(F.collect_list(
        F.struct((-F.col("bytes")).alias("order"), F.col("virtual_slot"), F.col("bytes")))).alias("slots"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"),
        F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("placed"))

    def place(state: Column, slot: Column) -> Column:
        least = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        load = F.transform(state["load"], lambda x, i: F.when(i == least, x + slot["bytes"]).otherwise(x))
        put = F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard"))
        return F.struct(load.alias("load"), F.concat(state["placed"], F.array(put)).alias("placed"))

    placed = F.aggregate("slots", start, place, lambda state: state["placed"])
    return ordered.select(F.explode(placed).alias("_slot")).select("_slot.virtual_slot", "_slot.shard")


def rebalanced_map(slot_map: DataFrame, by_slot: DataFrame, shards: int) -> DataFrame:
    """The map edited for `shards` shards: overfull shards hand slots to the others.

    Slots stay where they are, by number, while their shard is within the mean; shards that are gone hand over all of
    theirs. The slots that move are dealt out, largest first, to the shards with the most room.
    """
    held = by_slot.join(slot_map, "virtual_slot", "left")
    mean = F.sum("bytes").over(W.partitionBy(F.lit(1))) / F.lit(shards)
    upto = F.sum("bytes").over(
        W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, 0))
    stays = F.coalesce((F.col("shard") < shards) & (F.col("_upto") <= F.col("_mean")), F.lit(False))
    load = F.sum(F.when(F.col("_stays"), F.col("bytes"))).over(W.partitionBy("shard"))
    marked = held.withColumn("_mean", mean).withColumn("_upto", upto).withColumn("_stays", stays).withColumn("_load", load)
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda i: F.coalesce(F.element_at(F.col("loads"), i), F.lit(0).cast("bigint")))
    folded = marked.agg(
        F.sort_array(F.collect_list(F.when(~F.col("_stays"), F.struct(
            (-F.col("bytes")).alias("order"), F.col("virtual_slot"), F.col("bytes"))))).alias("slots"),
        F.map_from_entries(F.collect_set(F.when(F.col("_stays"), F.struct("shard", "_load")))).alias("loads"))
    start = F.struct(loads.alias("load"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("placed"))

    def place(state: Column, slot: Column) -> Column:
        least = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        grown = F.transform(state["load"], lambda x, i: F.when(i == least, x + slot["bytes"]).otherwise(x))
        put = F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard"))
        return F.struct(grown.alias("load"), F.concat(state["placed"], F.array(put)).alias("placed"))

    moved = folded.select(F.explode(F.aggregate("slots", start, place, lambda s: s["placed"])).alias("_slot"))
    return marked.filter("_stays").select("virtual_slot", "shard").unionByName(
        moved.select("_slot.virtual_slot", "_slot.shard"))


def write_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store one version of the map; earlier versions stay as they are."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, or the newest."""
    versions = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version).drop("version")


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored whole under a path, in order; none if it does not exist."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def slot_map_for(by_slot: DataFrame, shards: int, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """The map for all slots of `by_slot`. With `map_path`, the stored `version` or else the newest one holds; a missing one
    is created. If it is for another number of shards or lacks slots, it is edited and stored after the newest."""
    if not map_path:
        return staged(balanced_map(by_slot, shards), "shard-map")
    spark = by_slot.sparkSession
    known = stored_versions(spark, map_path)
    if not known or (version is not None and version not in known):
        version = max(known, default=0) + 1 if version is None else version
        write_map(balanced_map(by_slot, shards), map_path, version)
        return read_map(spark, map_path, version)
    stored = read_map(spark, map_path, known[-1] if version is None else version)
    slots = by_slot.count()
    held, last = by_slot.join(stored, "virtual_slot").agg(F.count(F.lit(1)), F.max("shard")).first()
    if held == slots and last + 1 == min(shards, slots):
        return stored
    write_map(rebalanced_map(stored, by_slot, shards), map_path, known[-1] + 1)
    return read_map(spark, map_path, known[-1] + 1)


def sized_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), record_size(F.col(text)).alias("size"),
        text_crc32(F.col(text)).alias("text_crc32"), virtual_slot(F.col(doc_id), F.col(text), slots).alias("virtual_slot"))


def numbered(sized: DataFrame, slot_map: DataFrame, by_slot: DataFrame) -> DataFrame:
    """Every record with its shard and its place in the shard, gapless from 0.

    Slots follow one another inside a shard, so a place is the number of records in the slots before plus the rank
    inside the slot. Equal records are counted first, which combines map-side, and ranked as one; then each gives as many
    rows as it stands for, those of large groups in runs of `RUN` dealt over all tasks.
    """
    before = F.coalesce(F.sum("records").over(
        W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = by_slot.join(slot_map, "virtual_slot").select("virtual_slot", "shard", before.alias("_before"))
    inside = F.coalesce(F.sum("_n").over(
        W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    different = staged(sized.groupBy("doc_id", "size", "text_crc32", "virtual_slot").agg(F.count(F.lit(1)).alias("_n"))
                       .withColumn("_inside", inside).join(placed, "virtual_slot")
                       .withColumn("_at", F.col("_before") + F.col("_inside")).drop("_before", "_inside"), "shard-ranks")
    own = ["doc_id", "size", "text_crc32", "virtual_slot", "shard"]
    end = F.col("_at") + F.col("_n")
    few = different.filter(F.col("_n") <= RUN).select(*own, F.explode(F.sequence("_at", end - 1)).alias("place"))
    runs = different.filter(F.col("_n") > RUN).select(
        *own, end.alias("_end"), F.explode(F.sequence("_at", end - 1, F.lit(RUN).cast("bigint"))).alias("_at")).repartition("shard", "_at")
    many = runs.select(*own, F.explode(F.sequence("_at", F.least("_end", F.col("_at") + RUN) - 1)).alias("place"))
    return few.unionByName(many)


def shard_records(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text",
    map_path: str | None = None, version: int | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and place (position in the shard) of every record.

    Sizes are computed once and staged without the texts. `map_path` and `version` are those of `slot_map_for`.
    """
    sized = staged(sized_records(docs, doc_id, text, slots), "shard-sizes")
    by_slot = staged(every_slot(slot_bytes(sized), slots), "shard-slots")
    return numbered(sized, slot_map_for(by_slot, shards, map_path, version), by_slot)


def sharded(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text",
    map_path: str | None = None, version: int | None = None,
) -> DataFrame:
    """The documents with their own columns, `virtual_slot` and `shard`. The texts are not shuffled: the map has one
    row per slot. `map_path` and `version` are those of `slot_map_for`."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("virtual_slot", "shard")]
    placed = docs.select(*own, virtual_slot(F.col(doc_id), F.col(text), slots).alias("virtual_slot"))
    by_slot = placed.select("virtual_slot", record_size(F.col(text)).alias("size"))
    slot_map = slot_map_for(staged(every_slot(slot_bytes(by_slot), slots), "shard-slots"), shards, map_path, version)
    return placed.join(slot_map, "virtual_slot").select(*own, "virtual_slot", "shard")
