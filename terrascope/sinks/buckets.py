"""Keyed tables in hash buckets: a feed rewrites only the buckets that its keys fall in.

    root/hash_folder=f<name>/hash_bucket=17/*.parquet    rows, never changed once they are written
    root/_heads/00000007.json                            keys, number of buckets, schema, and the folder of each bucket

A merge deals the feed into the buckets of the table, reads those buckets alone, and writes them to a new folder; one
small head file then switches all of them at once (see `releases`). Rows of other buckets are neither read nor moved.
A merge is bound to the head it started from: when another writer has switched in between, it is refused, and its
folder is one that no head names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import folder_names, fresh_path, remove_folder
from .releases import HEADS, add_head, head_numbers, read_head

BUCKET, FOLDER = "hash_bucket", "hash_folder"


class BucketTable:
    """A table with a key, stored under one folder.

    The number of buckets is chosen when the table is created: a merge rewrites whole buckets, so that one should hold
    some tens of megabytes. Keys may be NULL; all rows of a key are in one bucket.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- state ------------------------------------------------------------------------------------------------

    def head(self) -> tuple[int, dict]:
        """Number and content of the newest head; (0, {}) before the table is created."""
        numbers = head_numbers(self.spark, f"{self.root}/{HEADS}")
        return (numbers[-1], read_head(self.spark, f"{self.root}/{HEADS}", numbers[-1])) if numbers else (0, {})

    def _switch(self, number: int, head: dict) -> None:
        if not add_head(self.spark, f"{self.root}/{HEADS}", number, head):
            raise RuntimeError(f"{self.root} was switched by another writer")

    def _created(self) -> tuple[int, dict, T.StructType]:
        number, head = self.head()
        if not number:
            raise ValueError(f"no table at {self.root}")
        return number, head, T.StructType.fromJson(json.loads(head["schema"]))

    # --- rows -------------------------------------------------------------------------------------------------

    def create(self, rows: DataFrame, keys: Sequence[str], buckets: int = 64) -> int:
        """Write the first state of the table; returns its rows. A table that is there already is an error."""
        number, _ = self.head()
        if number:
            raise ValueError(f"there is a table at {self.root}")
        if buckets < 1:
            raise ValueError("a table has at least one bucket")
        taken = {BUCKET, FOLDER} & set(rows.columns)
        if taken:
            raise ValueError(f"columns {sorted(taken)} are names of folders")
        folder, count = self._write(rows, keys, buckets)
        held = {str(b): folder for b in self._written(folder)}
        self._switch(1, {"keys": list(keys), "count": buckets, "schema": rows.schema.json(), "buckets": held})
        return count

    def read(self) -> DataFrame:
        """All rows, as the newest head names them."""
        _, head, schema = self._created()
        return self._read(head, schema, head["buckets"])

    def lookup(self, key: Mapping[str, object]) -> DataFrame:
        """The rows of one key, read from its bucket alone."""
        _, head, schema = self._created()
        types = {f.name: f.dataType for f in schema}
        values = [F.lit(key[k]).cast(types[k]) for k in head["keys"]]
        bucket = self.spark.range(1).select(bucket_of(values, head["count"])).head()[0]
        same = [F.col(k).eqNullSafe(v) for k, v in zip(head["keys"], values)]
        rows = self._read(head, schema, [str(bucket)])
        for condition in same:
            rows = rows.filter(condition)
        return rows

    def merge(self, feed: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        """Merge a feed by `combine(rows of the touched buckets, feed)`, for example `upsert_cities`, which gives the
        rows that these buckets hold from now on. An empty feed changes nothing.

        Returns {"touched": number of buckets rewritten, "rows": rows they hold now}. The driver sees bucket numbers only.
        """
        number, head, schema = self._created()
        types = {f.name: f.dataType for f in schema}
        keyed = feed.withColumns({k: F.col(k).cast(types[k]) for k in head["keys"]})
        aside = fresh_path(self.spark, "feed")  # read twice: for its buckets, and for its rows
        keyed.write.parquet(aside)
        staged = self.spark.read.schema(keyed.schema).parquet(aside)
        bucket = bucket_of([F.col(k) for k in head["keys"]], head["count"])
        touched = [str(r[0]) for r in staged.select(bucket.alias(BUCKET)).distinct().collect()]
        if not touched:
            return {"touched": 0, "rows": 0}
        merged = combine(self._read(head, schema, touched), staged).select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        folder, rows = self._write(merged, head["keys"], head["count"])
        full = {str(b) for b in self._written(folder)}
        if not full <= set(touched):
            raise ValueError("the merged rows have keys of buckets that the feed does not touch")
        kept = {b: f for b, f in head["buckets"].items() if b not in set(touched)}
        self._switch(number + 1, {**head, "buckets": {**kept, **{b: folder for b in full}}})
        remove_folder(self.spark, aside)
        return {"touched": len(touched), "rows": rows}

    def prune(self) -> int:
        """Remove the buckets and heads that the newest head does not need; returns the buckets removed. For times
        without writers and without readers that resolved an older head."""
        number, head, _ = self._created()
        removed = 0
        for name in folder_names(self.spark, self.root):
            if not name.startswith(f"{FOLDER}=f"):
                continue
            folder, gone = name[len(f"{FOLDER}=f"):], 0
            held = self._written(folder)
            for bucket in held:
                if head["buckets"].get(str(bucket)) != folder:
                    gone += remove_folder(self.spark, f"{self.root}/{name}/{BUCKET}={bucket}")
            if gone == len(held):
                remove_folder(self.spark, f"{self.root}/{name}")
            removed += gone
        for old in head_numbers(self.spark, f"{self.root}/{HEADS}"):
            if old != number:
                remove_folder(self.spark, f"{self.root}/{HEADS}/{old:08d}.json")
        return removed

    # --- files ------------------------------------------------------------------------------------------------

    def _read(self, head: dict, schema: T.StructType, buckets) -> DataFrame:
        named = [(head["buckets"][b], b) for b in buckets if b in head["buckets"]]
        paths = [f"{self.root}/{FOLDER}=f{folder}/{BUCKET}={b}" for folder, b in named]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(schema.names)

    def _write(self, rows: DataFrame, keys: Sequence[str], buckets: int) -> tuple[str, int]:
        """Rows in a new folder, dealt by bucket; AQE cuts a large bucket into files of the advisory size."""
        folder, written = uuid.uuid4().hex, Observation()
        dealt = rows.withColumn(BUCKET, bucket_of([F.col(k) for k in keys], buckets)).hint("rebalance", BUCKET)
        (
            dealt.observe(written, F.count(F.lit(1)).alias("rows"))
            .withColumn(FOLDER, F.lit(f"f{folder}"))
            .write.mode("append").partitionBy(FOLDER, BUCKET).parquet(self.root)
        )
        return folder, written.get["rows"]

    def _written(self, folder: str) -> list[int]:
        start = f"{BUCKET}="
        names = folder_names(self.spark, f"{self.root}/{FOLDER}=f{folder}")
        return sorted(int(n[len(start):]) for n in names if n.startswith(start))


def bucket_of(keys: Sequence[Column], buckets: int) -> Column:
    """The bucket of a key; part of the format of the tables."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
