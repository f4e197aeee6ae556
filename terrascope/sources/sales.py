"""Raw sale files: scan, clean, resolve the commune."""

from __future__ import annotations

import io
import itertools
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..session import data_files, fresh_path, qualified, shuffles_removed
from .delimited import parse_positional, read_lines, read_positional
from .layout import spread_if_narrow

RANGED = ("file", "hdfs", "s3", "gs")
TASK_BYTES = 32 << 20  # text of zip entries that one task reads, where entries are smaller
# Width of the sales file and the positions that are read.
SALES_WIDTH = 40
SALES_MIN_FIELDS = 38
SALES_POSITIONS = {
    "id_mutation": 0, "date_mutation": 1, "nature_mutation": 3, "valeur_fonciere": 4, "adresse_numero": 5,
    "adresse_code_voie": 8, "code_postal": 9, "code_commune": 10, "nom_commune": 11, "code_departement": 12,
    "id_parcelle": 15, "nombre_lots": 28, "type_local": 30, "surface_reelle_bati": 31,
    "nombre_pieces_principales": 32, "surface_terrain": 37,
}


def scan_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """Four columns of a sales file with a header; unreadable numbers become NULL."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(
        F.col("code_commune").alias("insee_code"),
        F.col("valeur_fonciere").try_cast("double").alias("price"),
        F.col("surface_reelle_bati").try_cast("double").alias("surface"),
        F.col("date_mutation").alias("date"),
    )


def _named(positional: DataFrame) -> DataFrame:
    return positional.select(*[F.col(f"c{i}").alias(name) for name, i in SALES_POSITIONS.items()])


def scan_sales_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw sale fields as text, by position, from plain or gzip CSV."""
    named = _named(read_positional(spark, path, SALES_WIDTH, SALES_MIN_FIELDS))
    paths = [path] if isinstance(path, str) else path
    splittable = not any(p.endswith((".gz", ".gzip")) for p in paths)
    return named if splittable else spread_if_narrow(named)


def lines_of_year(lines: DataFrame, year: int) -> DataFrame:
    """Without the lines in which no date of the year can stand, whatever their quotes: those need no parsing."""
    return lines.filter(F.replace("line", F.lit('"'), F.lit("")).contains(f"{year:04d}-"))


def parse_sales(raw: DataFrame) -> DataFrame:
    """Typed sale columns plus `accepted`: whether the row may enter the transactions table.

    A row is refused for an unreadable date or price, a missing nature, or a parcel id of six or seven characters.
    """
    def field(name):
        return C.clean_text(F.col(name)) if name in raw.columns else F.lit(None).cast("string")

    value = field("valeur_fonciere")
    sale_date = C.parse_sale_date(field("date_mutation"))
    parcel = field("id_parcelle")
    accepted = (
        sale_date.isNotNull()
        & (value.isNull() | C.parse_money(value).isNotNull())
        & field("nature_mutation").isNotNull()
        & ~C.parcel_rejected(parcel)
    )
    return raw.select(
        field("id_mutation").alias("mutation_id"),
        sale_date.alias("mutation_date"),
        F.year(sale_date).alias("year"),
        field("nature_mutation").alias("mutation_nature"),
        C.parse_money(value).alias("property_value"),
        field("adresse_numero").alias("street_number"),
        F.lit(None).cast("string").alias("street_type"),
        field("code_postal").alias("postal_code"),
        C.full_insee_code(field("code_commune"), field("code_departement")).alias("city_insee_code"),
        C.parcel_section(parcel).alias("section"),
        C.parcel_plan(parcel).alias("plan_number"),
        C.parse_int(field("nombre_lots")).alias("lot_count"),
        C.map_property_type(field("type_local")).alias("property_type"),
        C.parse_double(field("surface_reelle_bati")).alias("built_surface"),
        C.parse_int(field("nombre_pieces_principales")).alias("room_count"),
        C.parse_double(field("surface_terrain")).alias("land_surface"),
        F.coalesce(accepted, F.lit(False)).alias("accepted"),
    )


def clean_sales(raw: DataFrame) -> DataFrame:
    return parse_sales(raw).filter("accepted").drop("accepted")


def resolve_city(sales: DataFrame, cities: DataFrame) -> DataFrame:
    """Keep the commune code only where the commune is known."""
    known = cities.select(F.col("insee_code").alias("_known_code"))
    return (
        sales.join(known, F.col("city_insee_code") == F.col("_known_code"), "left")
        .withColumn("city_insee_code", F.col("_known_code"))
        .drop("_known_code")
    )


def _finish(raw: DataFrame, year: int, cities: DataFrame) -> DataFrame:
    sales = clean_sales(raw).filter(F.col("year") == year)
    located = resolve_city(_identified(sales), cities)
    return located.withColumns(
        {
            "latitude": F.lit(None).cast("double"),
            "longitude": F.lit(None).cast("double"),
            "geocoded_at": F.lit(None).cast("timestamp"),
        }
    )


def _identified(sales: DataFrame) -> DataFrame:
    """Rows with an `id`: the SHA-256 of all fields, NULLs included, and which of several equal rows it is.

    The cleaned rows are written to the shared folder once, with their place, so that the file is parsed once and ids do
    not change if a task runs again. Only digests are shuffled to find those that are there twice; equal rows are
    numbered inside their slice of the file and the slices before are added, so a row that is there very often is spread
    over many tasks; all other rows stay where they are.
    """
    spark, path = sales.sparkSession, fresh_path(sales.sparkSession, "cleaned-sales")
    fields = F.to_json(F.struct(*sales.columns), {"ignoreNullFields": "false"})
    with shuffles_removed(spark):
        sales.withColumns({"_digest": F.sha2(fields, 256), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    rows = spark.read.parquet(path)
    digests = rows.select("_digest", "_at", F.shiftright("_at", 33).alias("_slice"))
    twice = digests.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_digest")
    equal = digests.join(twice, "_digest", "left_semi")
    sizes = equal.groupBy("_digest", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(W.partitionBy("_digest").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_digest").alias("_d"), F.col("_slice").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("_digest", "_slice").orderBy("_at"))
    numbers = equal.withColumn("_local", local).join(
        offsets, (F.col("_digest") == F.col("_d")) & (F.col("_slice") == F.col("_s"))).select(
            F.col("_at").alias("_row"), (F.col("_before") + F.col("_local")).alias("_copy"))
    copy = F.coalesce(F.col("_copy"), F.lit(1)).cast("string")
    return rows.join(numbers, F.col("_at") == F.col("_row"), "left").withColumn(
        "id", F.concat_ws("-", "_digest", copy)).drop("_digest", "_at", "_row", "_copy")


def import_sales(spark: SparkSession, path: str | list[str], year: int, cities: DataFrame) -> DataFrame:
    """Sales of one year from CSV or gzip. Row ids are unique and come from the cleaned content."""
    lines = lines_of_year(read_lines(spark, path), year)
    paths = [path] if isinstance(path, str) else path
    if any(p.endswith((".gz", ".gzip")) for p in paths):
        lines = spread_if_narrow(lines)
    return _finish(_named(parse_positional(lines, SALES_WIDTH, SALES_MIN_FIELDS)), year, cities)


def lines_from_archives(archives: DataFrame, suffix: str = ".csv", block: int = 20_000) -> DataFrame:
    """Data lines of every matching entry of zip archives given as (path, content), one archive per task.

    Entries are decompressed as a stream and emitted in blocks, without their header line. Bytes that are not UTF-8
    become replacement characters.
    """
    def unpack(frames):
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not name.endswith(suffix):
                            continue
                        with archive.open(name) as stream:
                            lines = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None)
                            next(lines, None)
                            pending = []
                            for line in lines:
                                pending.append(line.rstrip("\n"))
                                if len(pending) >= block:
                                    yield pd.DataFrame({"line": pending})
                                    pending = []
                            if pending:
                                yield pd.DataFrame({"line": pending})

    return archives.select("content").mapInPandas(unpack, "line STRING")


def zip_entries(spark: SparkSession, files: list[str], suffix: str = ".csv") -> DataFrame:
    """(path, entry, size) of the matching entries, from the archives' directories alone: their ends are read, not them."""
    def directory(frames):
        for frame in frames:
            for path in frame["path"]:
                store, name = _open_store(path)
                with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                    found = [(path, e.filename, e.file_size) for e in archive.infolist() if e.filename.endswith(suffix)]
                yield pd.DataFrame(found, columns=["path", "entry", "size"])

    named = spark.createDataFrame([(qualified(spark, f),) for f in files], "path string")
    # a number is given, or AQE would gather these short rows in one task
    named = named.repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)))
    return named.mapInPandas(directory, "path string, entry string, size bigint")


def _open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def lines_of_entries(entries: DataFrame, block: int = 20_000) -> DataFrame:
    """Data lines of zip entries given as (path, entry), each read from its place in the archive as a stream.

    An entry is the unit of work: it is compressed as one, and no part of it can be read without what is before.
    """
    def unpack(frames):
        for frame in frames:
            for path, entry in zip(frame["path"], frame["entry"], strict=True):
                store, name = _open_store(path)
                with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive, archive.open(entry) as stream:
                    lines = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None)
                    next(lines, None)
                    while pending := [line.rstrip("\n") for line in itertools.islice(lines, block)]:
                        yield pd.DataFrame({"line": pending})

    return entries.select("path", "entry").mapInPandas(unpack, "line STRING")


def _spread_entries(entries: DataFrame) -> DataFrame:
    """Lines of the entries, which are dealt over tasks of about `TASK_BYTES` of text. Their names are short rows, which AQE
    would gather in one task; so the number of tasks is given. Where there are fewer entries than task slots, the lines
    are dealt again, so that they are not parsed by as few tasks as read them."""
    slots = entries.sparkSession.sparkContext.defaultParallelism
    total = entries.agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes")).first()
    tasks = max(4 * slots, -(-(total["bytes"] or 0) // TASK_BYTES))
    lines = lines_of_entries(entries.repartition(min(tasks, 4 * max(total["entries"], 1)), "path", "entry"))
    return lines.repartition(slots) if total["entries"] < slots else lines


def import_sales_zip(spark: SparkSession, path: str, year: int, cities: DataFrame, ranged: bool | None = None) -> DataFrame:
    """Sales of one year from zip archives.

    Archives of any size are read entry by entry, one task each, where their file system can be read at any place
    (`ranged`, by default for local files, HDFS and object stores). In others an archive is one binary value of Spark's
    own reader, at most 2 GB, one archive per task.
    """
    files = [f for f in data_files(spark, path) if f.endswith(".zip")]
    if ranged is None:
        ranged = all(qualified(spark, f).split(":", 1)[0] in RANGED for f in files)
    if ranged and files:
        lines = _spread_entries(zip_entries(spark, files))
    else:
        archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
        lines = spread_if_narrow(lines_from_archives(archives))
    lines = lines_of_year(lines, year)
    return _finish(_named(parse_positional(lines, SALES_WIDTH, SALES_MIN_FIELDS)), year, cities)
