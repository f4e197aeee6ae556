"""Tables kept by year, where a year is switched from one state to the next in one step.

    root/<part>/year=2019/folder=<name>/*.parquet      rows, never changed once they are written
    root/_heads/year=2019/00000007.json                which folders of which parts are the year, and its notes

A year may have several parts (lots, statistics derived from them, ...), and a part several folders, which are read as
one. Writers put new folders next to those in use and then add one small head file; that is the switch. It is written
under another name and renamed, so that a reader sees a whole head or none, and the head with the greatest number
holds. A writer that stops before leaves folders that no head names: readers never see them, and `prune` removes them.
All parts of a year change together. Readers resolve the heads first and then read plain Parquet folders, with `year` as
a partition column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import _file_system, folder_names, remove_folder, shuffles_removed

HEADS = "_heads"
ROW_GROUP = 16 << 20
PAGE_ROWS = 5000  # readers skip pages too


def head_numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the head files in a folder, in order."""
    names = folder_names(spark, folder)
    return sorted(int(n[:-len(".json")]) for n in names if n[:1] != "." and n.endswith(".json"))


def read_head(spark: SparkSession, folder: str, number: int) -> dict:
    fs, path = _file_system(spark, f"{folder}/{number:08d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def add_head(spark: SparkSession, folder: str, number: int, value: dict) -> bool:
    """Write a head under another name and rename it; False, and nothing is changed, when its number is taken."""
    fs, aside = _file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    _, final = _file_system(spark, f"{folder}/{number:08d}.json")
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        return False
    return True


class YearStore:
    """The parts of all years under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- heads ------------------------------------------------------------------------------------------------

    def _numbers(self, year: int) -> list[int]:
        return head_numbers(self.spark, f"{self.root}/{HEADS}/year={year}")

    def head(self, year: int) -> dict:
        """{"parts": {part: [folder, ...]}, "notes": {...}} of a year; empty before its first switch."""
        numbers = self._numbers(year)
        if not numbers:
            return {"parts": {}, "notes": {}}
        return read_head(self.spark, f"{self.root}/{HEADS}/year={year}", numbers[-1])

    def years(self) -> list[int]:
        """Years that have had a switch, also those that are empty now."""
        return sorted(int(n[len("year="):]) for n in folder_names(self.spark, f"{self.root}/{HEADS}") if n.startswith("year="))

    def switch(self, year: int, parts: dict[str, Sequence[str]], notes: dict | None = None) -> None:
        """From now on these folders are the year; parts that are not named stay as they are.

        Two writers of one year at a time are refused: the second finds its number taken.
        """
        before = self.head(year)
        after = {"parts": {**before["parts"], **{p: list(f) for p, f in parts.items()}},
                 "notes": {**before["notes"], **(notes or {})}}
        number = max(self._numbers(year), default=0) + 1
        if not add_head(self.spark, f"{self.root}/{HEADS}/year={year}", number, after):
            raise RuntimeError(f"year {year} was switched by another writer")

    # --- rows -------------------------------------------------------------------------------------------------

    def new_folder(self) -> str:
        return uuid.uuid4().hex

    def write(self, part: str, df: DataFrame, folder: str, sort: Sequence = (), by: Sequence = (),
              inner: Sequence[str] = (), aside: Sequence[str] = ()) -> int:
        """Write rows of any years (column `year`) into the folder of this name in every year; no reader sees them yet.

        AQE cuts a large year into files of the advisory size; with `by`, rows are dealt in ranges of these columns
        instead and row groups are small, so that files and row groups hold narrow ranges. `inner` columns become folders
        below; `aside` columns only serve to deal and sort. Returns the rows, counted while they are written.
        """
        written = Observation()
        spread = df.repartitionByRange("year", *by) if by else df.hint("rebalance", "year", *inner)
        if sort:
            spread = spread.sortWithinPartitions("year", *inner, *sort)
        writer = spread.drop(*aside).observe(written, F.count(F.lit(1)).alias("rows")).withColumn("folder", F.lit(f"f{folder}")).write
        if by:
            writer = writer.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS)
        with shuffles_removed(df.sparkSession):
            writer.mode("append").option("compression", "zstd").partitionBy("year", "folder", *inner).parquet(f"{self.root}/{part}")
        return written.get["rows"]

    def written_years(self, part: str, folder: str, years: Iterable[int]) -> list[int]:
        """Those of the years for which `write` put rows into the folder."""
        return [y for y in years if folder_names(self.spark, f"{self.root}/{part}/year={y}/folder=f{folder}")]

    def read(self, part: str, years: Iterable[int] | None = None, schema: T.StructType | None = None,
             folders: dict[int, Sequence[str]] | None = None) -> DataFrame:
        """The rows of a part as the heads name them now. `schema` is needed where no year has rows."""
        wanted = self.years() if years is None else list(years)
        named = folders or {y: self.head(y)["parts"].get(part, []) for y in wanted}
        paths = [f"{self.root}/{part}/year={y}/folder=f{f}" for y, fs in named.items() for f in fs]
        if not paths:
            if schema is None:
                raise ValueError(f"no year has rows of {part}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", f"{self.root}/{part}")
        if len(paths) > 1:
            reader = reader.option("mergeSchema", True)
        return reader.parquet(*paths).drop("folder")

    def is_empty(self, part: str) -> bool:
        return not any(self.head(y)["parts"].get(part) for y in self.years())

    def replace(self, part: str, df: DataFrame, years: Iterable[int], sort: Sequence = (), by: Sequence = (),
                notes: dict | None = None) -> int:
        """Write the rows and switch each of `years` to them; a year without rows is empty then."""
        folder = self.new_folder()
        rows = self.write(part, df, folder, sort, by)
        full = set(self.written_years(part, folder, years))
        for year in years:
            self.switch(year, {part: [folder] if year in full else []}, notes)
        return rows

    # --- upkeep -----------------------------------------------------------------------------------------------

    def prune(self, year: int) -> int:
        """Remove the folders and heads of a year that its newest head does not need; returns the folders removed.

        For times without writers and without readers that resolved an older head.
        """
        parts, removed = self.head(year)["parts"], 0
        for part in folder_names(self.spark, self.root):
            if part == HEADS:
                continue
            for name in folder_names(self.spark, f"{self.root}/{part}/year={year}"):
                if name.startswith("folder=") and name[len("folder=f"):] not in parts.get(part, []):
                    removed += remove_folder(self.spark, f"{self.root}/{part}/year={year}/{name}")
        numbers = self._numbers(year)
        keep = f"{numbers[-1]:08d}.json" if numbers else ""
        for name in folder_names(self.spark, f"{self.root}/{HEADS}/year={year}"):
            if name != keep:
                remove_folder(self.spark, f"{self.root}/{HEADS}/year={year}/{name}")
        return removed
