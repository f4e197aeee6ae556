"""Registered queries: sources, sinks and whole jobs. Inputs and outputs live in the shared folder."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from .. import sinks, sources
from ..operators import geo as G
from ..operators import hierarchy as H
from ..operators import indicators as I
from ..operators import paging as P
from ..operators import sales as S
from ..operators import summaries as U
from ..session import fresh_path, qualified
from . import catalog_geo, jobs  # noqa: F401 (its keys are read here)
from .catalog_sales import BOX, DEPARTMENT_STATS_SQL, DEPT, DEPT_STATS_SQL, REGION, REGION_STATS_SQL
from .catalog_text import ENERGY_SQL, HEALTH_SQL, energy_rows, health_rows, scored_reviews
from .fixtures import view
from .registry import CHECKS, QUERIES, plain, query

YEAR, YEARS = 2019, range(2014, 2025)
NOW = dt.datetime(2024, 1, 1)


# --- files ----------------------------------------------------------------------------------------------------


_INPUTS: dict[tuple, str] = {}


def _input(spark, sf, name, write) -> str:
    """Path of an input file set, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _INPUTS:
        path = fresh_path(spark, name)
        write(path)
        _INPUTS[key] = path
    return _INPUTS[key]


def _write_csv(spark, sf, name, make, sep=",", **options):
    def write(path):
        make().write.option("header", True).option("sep", sep).option("escape", '"').options(**options).csv(path)

    return _input(spark, sf, name, write)


def _write_lines(spark, sf, name, make, header, **options):
    """Ready-made lines under a header line in each file."""
    def write(path):
        lines = make().toDF(header).write.option("header", True).options(**options)
        lines.option("sep", "\u0001").option("quote", "\u0000").csv(path)

    return _input(spark, sf, name, write)


def _write_json(spark, sf, name, make):
    return _input(spark, sf, name, lambda path: make().write.json(path))


def _write_parquet(spark, sf, name, make=None):
    """A view, or what `make` gives, as a Parquet table."""
    return _input(spark, sf, name, lambda path: (make() if make else view(spark, sf, name)).write.parquet(path))


def _sales_lines(spark, sf):
    """Forty comma-separated fields per sale; every 41st sale is cut after ten fields."""
    raw = view(spark, sf, "raw_sales")
    fields = [F.lit("")] * sources.sales.SALES_WIDTH
    for name, i in sources.sales.SALES_POSITIONS.items():
        if name in raw.columns:
            fields[i] = F.coalesce(F.col(name), F.lit(""))
    short = F.col("id_mutation").cast("bigint") % 41 == 0
    line = F.when(short, F.concat_ws(",", *fields[:10])).otherwise(F.concat_ws(",", *fields))
    return raw.select(line.alias("line"))


_HEADER = ",".join(f"h{i}" for i in range(sources.sales.SALES_WIDTH))
_IMPORT_COLUMNS = [
    "mutation_id", "mutation_date", "year", "mutation_nature", "property_value", "postal_code", "city_insee_code",
    "section", "plan_number", "lot_count", "property_type", "built_surface", "room_count", "land_surface",
]
_IMPORT_SELECT = ", ".join(
    "CAST(property_value AS DOUBLE) AS property_value" if c == "property_value" else c for c in _IMPORT_COLUMNS
)
_KEPT = "CAST(mutation_id AS BIGINT) % 41 <> 0"
_IMPORT_SQL = f"SELECT {_IMPORT_SELECT} FROM imported WHERE {_KEPT} AND year = {YEAR}"


def sales_file(spark, sf):
    """The raw sales file of the data set, as plain CSV."""
    return _write_lines(spark, sf, "sales", lambda: _sales_lines(spark, sf), _HEADER)


@query("scan_sales_csv", ["sales_csv"], """
    SELECT code_commune AS insee_code, TRY_CAST(valeur_fonciere AS DOUBLE) AS price,
      TRY_CAST(surface_reelle_bati AS DOUBLE) AS surface, date_mutation AS date FROM sales_csv""")
def _(spark, sf):
    return sources.scan_sales_csv(spark, _write_csv(spark, sf, "sales-csv", lambda: view(spark, sf, "sales_csv")))


@query("clean_sales", ["imported"], f"SELECT {_IMPORT_SELECT} FROM imported")
def _(spark, sf):
    return plain(sources.clean_sales(view(spark, sf, "raw_sales")).select(_IMPORT_COLUMNS))


@query("import_sales", ["imported"], _IMPORT_SQL)
def _(spark, sf):
    path = sales_file(spark, sf)
    return plain(sources.import_sales(spark, path, YEAR, view(spark, sf, "cities")).select(_IMPORT_COLUMNS))


@query("import_sales_gzip", ["imported"], _IMPORT_SQL)
def _(spark, sf):
    path = _write_lines(spark, sf, "sales-gz", lambda: _sales_lines(spark, sf), _HEADER, compression="gzip")
    rows = sources.import_sales(spark, f"{path}/*.csv.gz", YEAR, view(spark, sf, "cities"))
    return plain(rows.select(_IMPORT_COLUMNS))


def write_archives(lines, header: str, path: str) -> None:
    """Zip archives of two CSV entries, one archive per Arrow batch, written by the tasks."""
    folder = qualified(lines.sparkSession, path)

    def pack(frames):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for frame in frames:
            buffer = io.BytesIO()
            half = len(frame) // 2
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                for name, part in (("a.csv", frame["line"][:half]), ("b.csv", frame["line"][half:])):
                    archive.writestr(name, "\n".join([header, *part]) + "\n")
                archive.writestr("readme.txt", "not a table\n")
            with store.open_output_stream(f"{base}/{hashlib.md5(buffer.getvalue()).hexdigest()}.zip") as out:
                out.write(buffer.getvalue())
            yield pd.DataFrame({"rows": [len(frame)]})

    lines.mapInPandas(pack, "rows BIGINT").write.format("noop").mode("overwrite").save()


@query("import_sales_ids", ["imported"], f"SELECT 2 * count(*) AS lots, 2 * count(*) AS ids FROM ({_IMPORT_SQL})")
def _(spark, sf):
    """The same file twice: every lot has an equal one, and ids differ all the same."""
    path = sales_file(spark, sf)
    rows = sources.import_sales(spark, [path, path], YEAR, view(spark, sf, "cities"))
    return rows.agg(F.count(F.lit(1)).alias("lots"), F.count_distinct("id").alias("ids"))


@query("import_sales_zip", ["imported"], _IMPORT_SQL)
def _(spark, sf):
    folder = _input(spark, sf, "sales-zip", lambda path: write_archives(_sales_lines(spark, sf), _HEADER, path))
    rows = sources.import_sales_zip(spark, folder, YEAR, view(spark, sf, "cities"))
    return plain(rows.select(_IMPORT_COLUMNS))


def _indicator_file(spark, sf):
    return _write_lines(
        spark, sf, "indicators-csv", lambda: view(spark, sf, "raw_indicators").select("line"),
        "code,year,value,label,unit")


@query("import_audit", ["raw_indicators"], """
    SELECT CAST(count_if(value IS NOT NULL AND label IS NOT NULL) AS BIGINT) AS accepted,
      CAST(count_if(value IS NULL OR label IS NULL) AS BIGINT) AS skipped FROM raw_indicators""")
def _(spark, sf):
    return S.import_audit(sources.parse_indicators(spark, _indicator_file(spark, sf), "ECONOMY"))


_INDICATOR_SQL = """
    SELECT 'CITY' AS geographic_level, code AS geographic_code, '{category}' AS category, label, value, '%' AS unit, year
    FROM raw_indicators WHERE value IS NOT NULL AND label IS NOT NULL"""


def _register_import(category: str) -> None:
    name = "import_indicators" if category == "ECONOMY" else f"import_indicators_{category.lower()}"

    @query(name, ["raw_indicators"], _INDICATOR_SQL.format(category=category))
    def _(spark, sf):
        return sources.import_indicators(spark, _indicator_file(spark, sf), category)


for _category in ("ECONOMY", "EDUCATION", "ENVIRONMENT", "INFRASTRUCTURE"):
    _register_import(_category)


def _energy_file(spark, sf, files=None):
    def make():
        rows = view(spark, sf, "energy").select(
            F.col("code_insee").alias("code_insee_ban"), F.col("label").alias("etiquette_dpe"),
            F.lit("B").alias("etiquette_ges"), F.lit("1990").alias("annee_construction"))
        return rows.repartition(files) if files else rows

    return _write_csv(spark, sf, f"energy-{files or 'one'}", make)


_ENERGY_SCAN = "SELECT code_insee, label, 'B' AS ges_label, 1990 AS year FROM energy WHERE label <> ''"


@query("scan_energy", ["energy"], _ENERGY_SCAN)
def _(spark, sf):
    return sources.scan_energy(spark, _energy_file(spark, sf))


@query("scan_energy_pages", ["energy"], _ENERGY_SCAN)
def _(spark, sf):
    return sources.scan_energy_pages(spark, _energy_file(spark, sf, files=7))


def _health_file(spark, sf):
    given = {0: F.col("year"), 1: F.col("pathology"), 8: F.col("dept"), 11: F.col("prevalence")}
    fields = [given.get(i, F.lit("x")).alias(f"h{i}") for i in range(12)]
    return _write_csv(spark, sf, "health", lambda: view(spark, sf, "health").select(*fields), sep=";")


@query("scan_health", ["health"], """
    SELECT CAST(year AS INT) AS year, pathology, dept, CAST(replace(prevalence, ',', '.') AS DOUBLE) AS prevalence
    FROM health WHERE trim(pathology) <> '' AND prevalence <> 'n/a'""")
def _(spark, sf):
    return sources.scan_health(spark, _health_file(spark, sf))


# --- reference feeds ------------------------------------------------------------------------------------------


def _regions_feed(spark, sf):
    def make():
        named = view(spark, sf, "regions").select("code", F.col("name").alias("nom"))
        unnamed = view(spark, sf, "departments").select(F.lit(" ").alias("code"), F.col("name").alias("nom"))
        return named.unionByName(unnamed)

    return _write_json(spark, sf, "regions-json", make)


def _departments_feed(spark, sf):
    region = F.when(F.col("code").cast("int") % 5 == 4, F.lit("99")).otherwise(F.col("region_code"))
    columns = ["code", F.col("name").alias("nom"), region.alias("codeRegion")]
    return _write_json(spark, sf, "departments-json", lambda: view(spark, sf, "departments").select(*columns))


def _communes_feed(spark, sf):
    full = F.array("longitude", "latitude")
    point = F.when(F.col("longitude").isNull(), F.array(F.lit(1.0))).otherwise(full)
    postal = F.when(F.col("postal_code").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.col("postal_code"), F.lit("00000")))
    columns = [
        "code", "nom", postal.alias("codesPostaux"), F.col("department_code").alias("codeDepartement"), "population",
        F.col("area").alias("surface"),
        F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("centre")]
    return _write_json(spark, sf, "communes-json", lambda: view(spark, sf, "communes_feed").select(*columns))


@query("scan_regions_json", ["regions"], "SELECT * FROM regions")
def _(spark, sf):
    return sources.scan_regions_json(spark, _regions_feed(spark, sf), multi_line=False)


@query("scan_departments_json", ["departments"], "SELECT * FROM departments WHERE CAST(code AS INT) % 5 <> 4")
def _(spark, sf):
    return sources.scan_departments_json(
        spark, _departments_feed(spark, sf), view(spark, sf, "regions"), multi_line=False)


_COMMUNES_SQL = """
    SELECT code AS insee_code, nom AS name, postal_code, department_code, population, area, latitude, longitude
    FROM communes_feed WHERE trim(nom) <> '' AND department_code <> 'ZZ'"""


@query("scan_communes_json", ["communes_feed"], _COMMUNES_SQL)
def _(spark, sf):
    return sources.scan_communes_json(
        spark, _communes_feed(spark, sf), view(spark, sf, "departments"), multi_line=False)


def _collections(spark, sf, name, rows, properties):
    """One FeatureCollection document per line."""
    feature = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), properties,
        F.lit(',"geometry":'), F.col("geometry"), F.lit("}]}"))
    return _input(spark, sf, name, lambda path: rows.select(feature.alias("value")).write.text(path))


def _one_file(spark, sf, name, make, opening: str, closing: str):
    """A single file: the rows' JSON objects between brackets, as the feeds send them."""
    def write(path):
        lines = make().coalesce(1).select(F.concat(
            F.when(F.monotonically_increasing_id() == 0, F.lit(opening)).otherwise(F.lit(",")), F.col("value")).alias("value"))
        end = spark.sql(f"SELECT '{closing}' AS value")
        lines.unionByName(end).coalesce(1).write.text(path)

    return _input(spark, sf, name, write)


def _array_of(spark, sf, name, lines_path):
    """The records of a JSON-lines feed as one array in one file."""
    return _one_file(spark, sf, name, lambda: spark.read.text(lines_path), "[", "]")


def _in_array(name: str, make) -> None:
    QUERIES[f"{name}_array"], CHECKS[f"{name}_array"] = make, CHECKS[name]


@query("scan_boundaries", ["city_boundaries"], "SELECT * FROM city_boundaries WHERE CAST(geographic_code AS INT) % 9 <> 0")
def _(spark, sf):
    name = F.when(F.col("geographic_code").cast("int") % 9 == 0, F.lit(" ")).otherwise(F.col("name"))
    properties = F.to_json(F.struct(F.col("geographic_code").alias("code"), name.alias("nom")))
    path = _collections(spark, sf, "boundaries", view(spark, sf, "city_boundaries"), properties)
    return sources.scan_boundaries(spark, path, "CITY", multi_line=False)


_COUNTRIES_SQL = """
    SELECT coalesce(nullif(iso_a3, '-99'), nullif(iso_a3_eh, '-99'), nullif(adm0_a3, '-99')) AS code, iso_a3, name,
      population, gdp_md AS gdp, round(radians(1) * (sin(radians(k + 1)) - sin(radians(k))) * 6371008.8 * 6371008.8
        / 1000000, 5) AS area
    FROM countries"""


def _countries_feed(spark, sf):
    rows = view(spark, sf, "countries")
    y, y1 = F.col("k").cast("string"), (F.col("k") + 1).cast("string")
    geometry = F.concat(
        F.lit('{"type":"Polygon","coordinates":[[[0,'), y, F.lit("],[1,"), y, F.lit("],[1,"), y1, F.lit("],[0,"), y1,
        F.lit("],[0,"), y, F.lit("]]]}"))
    properties = F.to_json(F.struct(
        F.col("iso_a3").alias("ISO_A3"), F.col("iso_a3_eh").alias("ISO_A3_EH"), F.col("adm0_a3").alias("ADM0_A3"),
        F.col("name").alias("NAME"), F.col("population").alias("POP_EST"), F.col("gdp_md").alias("GDP_MD"),
        F.lit("x").alias("WIKIDATAID")))
    return _collections(spark, sf, "countries", rows.withColumn("geometry", geometry), properties)


def _countries(layer):
    return plain(layer.select("code", "iso_a3", "name", "population", "gdp", "area"), "area", digits=5)


@query("scan_countries", ["countries"], _COUNTRIES_SQL)
def _(spark, sf):
    return _countries(sources.scan_countries(spark, _countries_feed(spark, sf), multi_line=False))


@query("union_layers", ["regions", "cities"], """
    SELECT code, name, CAST(NULL AS BIGINT) AS population, 'region' AS layer FROM regions
    UNION ALL SELECT insee_code, name, population, 'province' FROM cities""")
def _(spark, sf):
    regions = view(spark, sf, "regions").withColumn("layer", F.lit("region"))
    provinces = view(spark, sf, "cities").select(
        F.col("insee_code").alias("code"), "name", "population", F.lit("province").alias("layer"))
    return sources.union_layers(regions, provinces)


@query("scan_city_mapping", ["cities"], "SELECT insee_code, department_code FROM cities")
def _(spark, sf):
    return sources.scan_city_mapping(spark, _write_parquet(spark, sf, "cities"))


@query("scan_geocodes", ["geocodes"], """
    SELECT CAST(id AS BIGINT) AS id, CASE WHEN CAST(id AS BIGINT) % 19 <> 0 THEN latitude END AS latitude, longitude,
      score FROM geocodes WHERE CAST(id AS BIGINT) % 17 <> 0""")
def _(spark, sf):
    key = F.col("id").cast("bigint")
    columns = [
        F.when(key % 17 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")).alias("id"),
        F.when(key % 19 == 0, F.lit("n/a")).otherwise(F.col("latitude").cast("string")).alias("latitude"),
        "longitude", F.col("score").alias("result_score")]
    path = _write_csv(spark, sf, "geocodes", lambda: view(spark, sf, "geocodes").select(*columns), sep=";")
    return sources.scan_geocodes(spark, path)


_in_array("scan_regions_json", lambda spark, sf: sources.scan_regions_json(
    spark, _array_of(spark, sf, "regions-array", _regions_feed(spark, sf))))
_in_array("scan_departments_json", lambda spark, sf: sources.scan_departments_json(
    spark, _array_of(spark, sf, "departments-array", _departments_feed(spark, sf)), view(spark, sf, "regions")))
_in_array("scan_communes_json", lambda spark, sf: sources.scan_communes_json(
    spark, _array_of(spark, sf, "communes-array", _communes_feed(spark, sf)), view(spark, sf, "departments")))


def _collection(spark, sf, name, lines_path):
    """The features of collections of one feature a line, as one collection in one file."""
    opening = '{"type":"FeatureCollection","features":['
    features = spark.read.text(lines_path).select(F.expr(
        f"substring(value, {len(opening) + 1}, char_length(value) - {len(opening) + 2})").alias("value"))
    return _one_file(spark, sf, name, lambda: features, opening, "]}")


_CORNERS = " || ',' || ".join(
    f"'[' || CAST(CAST({x} AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST({y} AS DOUBLE) AS VARCHAR) || ']'"
    for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))


@query("scan_boundaries_array", ["city_boxes"], f"""
    SELECT 'CITY' AS geographic_level, code AS geographic_code, name, '[[[' || {_CORNERS} || ']]]' AS coordinates
    FROM city_boxes WHERE CAST(code AS INT) % 9 <> 0""")
def _(spark, sf):
    QUERIES["scan_boundaries"](spark, sf)  # writes the collections of one feature each
    lines = _INPUTS[spark.sparkContext.applicationId, sf, "boundaries"]
    rows = sources.scan_boundaries(spark, _collection(spark, sf, "boundaries-array", lines), "CITY")
    # numbers as numbers: 41.00 may be written 41.0
    return G.parse_geometry(rows).select(
        "geographic_level", "geographic_code", "name", F.to_json("parts").alias("coordinates"))


@query("scan_countries_array", ["countries"], _COUNTRIES_SQL)
def _(spark, sf):
    return _countries(sources.scan_countries(spark, _collection(spark, sf, "countries-array", _countries_feed(spark, sf))))


# --- table maintenance ----------------------------------------------------------------------------------------


@query("write_dept_stats", ["tx", "cities"], DEPT_STATS_SQL)
def _(spark, sf):
    tx = view(spark, sf, "tx").select(
        F.col("city_insee_code").alias("insee_code"), F.col("property_value").cast("double").alias("price"),
        F.col("built_surface").alias("surface"))
    stats = S.dept_sales_stats(tx, view(spark, sf, "cities"))
    target = fresh_path(spark, "dept-stats")
    sinks.write_dept_stats(stats, target)
    sinks.write_dept_stats(stats, target)
    return plain(spark.read.parquet(target), "avg_price", "avg_price_per_sqm")


_STORES: dict[tuple, str] = {}


def sales_store(spark, sf) -> str:
    """A store of all years with their statistics, written once per session and data set. For reading only."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        root = fresh_path(spark, "sales-store")
        lots = view(spark, sf, "tx")
        sinks.publish_years(sinks.YearStore(spark, root), lots, YEARS, NOW)
        _STORES[key] = root
    return _STORES[key]


def _lots_store(spark, sf, name="tx") -> str:
    """A store of its own with the lots of all years, without statistics."""
    root = fresh_path(spark, "lots-store")
    sinks.YearStore(spark, root).replace("lots", view(spark, sf, name), YEARS)
    return root


@query("replace_sales_year", ["tx"], f"""
    SELECT id, year, CAST(property_value AS DOUBLE) AS property_value FROM tx
    WHERE year <> {YEAR} OR property_type = 'MAISON'""")
def _(spark, sf):
    root = _lots_store(spark, sf)
    renewed = view(spark, sf, "tx").filter("property_type = 'MAISON'")
    sinks.replace_sales_year(renewed, root, YEAR)
    return plain(sinks.read_sales(spark, root).select("id", "year", "property_value"))


@query("truncate_year", ["tx"], f"SELECT id, year FROM tx WHERE year <> {YEAR}")
def _(spark, sf):
    root = _lots_store(spark, sf)
    sinks.truncate_year(spark, root, YEAR)
    return sinks.read_sales(spark, root).select("id", "year")


_CITY_YEAR = "insee_code, year, transaction_count, CAST(total_price AS DOUBLE) AS total_price, total_residential_surface"


@query("refresh_city_year", ["city_year"], f"SELECT {_CITY_YEAR} FROM city_year WHERE year IN ({YEAR}, {YEAR + 1})")
def _(spark, sf):
    path = fresh_path(spark, "city-stats")
    tx = view(spark, sf, "tx")
    sinks.refresh_city_year(tx.filter("property_type = 'MAISON'"), path, YEAR, NOW)
    for year in (YEAR + 1, YEAR):
        sinks.refresh_city_year(tx, path, year, NOW)
    return plain(sinks.read_city_stats(spark, path).drop("updated_at"))


@query("upsert_cities", ["cities"], """
    SELECT insee_code, CASE WHEN population % 3 <> 0 THEN upper(name) ELSE name END AS name,
      CASE WHEN population % 3 <> 0 THEN NULL ELSE postal_code END AS postal_code,
      CASE WHEN population % 2 = 0 THEN department_code ELSE 'XX' END AS department_code, population,
      CASE WHEN population % 3 <> 0 THEN area + 1 ELSE area END AS area,
      CASE WHEN population % 3 <> 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS latitude,
      CASE WHEN population % 3 <> 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS longitude
    FROM cities WHERE population % 2 = 0 OR population % 3 <> 0""")
def _(spark, sf):
    cities = view(spark, sf, "cities")
    known = cities.filter("population % 2 = 0").withColumns({"latitude": F.lit(1.0), "longitude": F.lit(1.0)})
    incoming = cities.filter("population % 3 <> 0").select(
        "insee_code", F.upper("name").alias("name"), F.lit(None).cast("string").alias("postal_code"),
        F.lit("XX").alias("department_code"), "population", (F.col("area") + 1).alias("area"),
        F.lit(2.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    return sinks.upsert_cities(known, incoming)


_NEW_NAME = "CASE WHEN department_code = '07' THEN lower(name) WHEN population % 3 <> 0 THEN upper(name) ELSE name END"


@query("merge_cities", ["cities"], f"""
    SELECT insee_code, {_NEW_NAME} AS name,
      CASE WHEN population % 3 = 0 AND population % 2 = 0 THEN postal_code END AS postal_code,
      CASE WHEN population % 2 = 0 THEN department_code WHEN population % 3 <> 0 THEN 'XX' END AS department_code,
      CASE WHEN population % 2 = 0 OR population % 3 <> 0 THEN population END AS population,
      CASE WHEN population % 3 <> 0 THEN area + 1 WHEN population % 2 = 0 THEN area END AS area
    FROM cities WHERE population % 2 = 0 OR population % 3 <> 0 OR department_code = '07'""")
def _(spark, sf):
    """A bucketed table, a feed in which every commune comes twice (the later place counts), and a small one of names."""
    cities = view(spark, sf, "cities")
    table = sinks.BucketTable(spark, fresh_path(spark, "cities-by-bucket"))
    table.create(cities.filter("population % 2 = 0"), ["insee_code"], buckets=16)
    feed = cities.filter("population % 3 <> 0").select(
        "insee_code", "name", F.lit(None).cast("string").alias("postal_code"), F.lit("XX").alias("department_code"),
        "population", (F.col("area") + 1).alias("area"), F.lit(1).alias("place"))
    later = feed.withColumns({"name": F.upper("name"), "place": F.lit(2)})
    by_place = functools.partial(sinks.upsert_cities, order="place")
    table.merge(feed.withColumn("name", F.concat(F.lit("zz"), "name")).unionByName(later), by_place)
    table.merge(cities.filter("department_code = '07'").select("insee_code", F.lower("name").alias("name")), sinks.upsert_cities)
    return table.read()


@query("upsert_names", ["cities"], """
    SELECT insee_code AS code, CASE WHEN population % 3 <> 0 THEN upper(name) ELSE name END AS name,
      CASE WHEN population % 2 = 0 THEN 'R1' ELSE 'R2' END AS region_code,
      CASE WHEN population % 2 = 0 THEN population END AS population
    FROM cities WHERE population % 2 = 0 OR population % 3 <> 0""")
def _(spark, sf):
    cities = view(spark, sf, "cities").withColumnRenamed("insee_code", "code")
    known = cities.filter("population % 2 = 0").select("code", "name", F.lit("R1").alias("region_code"), "population")
    incoming = cities.filter("population % 3 <> 0").select(
        "code", F.upper("name").alias("name"), F.lit("R2").alias("region_code"))
    return sinks.upsert_names(known, incoming)


_BOUNDARIES_SQL = """
    SELECT geographic_level, geographic_code, CASE WHEN geographic_level = 'CITY' THEN upper(name) ELSE name END AS name,
      CASE WHEN geographic_level = 'CITY' THEN 'null' ELSE geometry END AS geometry FROM all_boundaries"""


def _known_boundaries(spark, sf):
    return view(spark, sf, "all_boundaries").filter(
        "geographic_level <> 'CITY' OR CAST(geographic_code AS INT) % 2 = 0")


def _new_boundaries(spark, sf):
    return view(spark, sf, "city_boundaries").withColumns({"name": F.upper("name"), "geometry": F.lit("null")})


@query("upsert_boundaries", ["all_boundaries"], _BOUNDARIES_SQL)
def _(spark, sf):
    return sinks.upsert_boundaries(_known_boundaries(spark, sf), _new_boundaries(spark, sf))


@query("merge_boundaries", ["all_boundaries"], _BOUNDARIES_SQL)
def _(spark, sf):
    table = sinks.BucketTable(spark, fresh_path(spark, "boundaries-by-bucket"))
    table.create(_known_boundaries(spark, sf), ["geographic_level", "geographic_code"], buckets=16)
    table.merge(_new_boundaries(spark, sf), sinks.upsert_boundaries)
    return table.read()


@query("append_indicators", ["energy", "health"], f"{ENERGY_SQL} UNION ALL {HEALTH_SQL}")
def _(spark, sf):
    path = fresh_path(spark, "indicators")
    for _run in range(2):
        sinks.append_indicators(I.energy_distribution(energy_rows(spark, sf)), path)
        sinks.append_indicators(I.health_prevalence(health_rows(spark, sf)), path)
    return plain(spark.read.parquet(path), gridded=["value"])


@query("append_reviews", ["scored"], "SELECT id, sentiment_score, sentiment_label FROM scored")
def _(spark, sf):
    path = fresh_path(spark, "reviews")
    reviews = scored_reviews(spark, sf)
    for label in (F.col("sentiment_label") == "POSITIVE", F.col("sentiment_label") != "POSITIVE"):
        sinks.append_reviews(reviews.filter(label), path)
    return spark.read.parquet(path).select("id", "sentiment_score", "sentiment_label")


GEOCODED_SQL = """
    WITH b AS (SELECT t.lot_id, t.id, g.latitude AS la, g.longitude AS lo,
        coalesce(g.latitude IS NOT NULL AND (g.score IS NULL OR g.score >= 0.4), false) AS resolved
      FROM tx_by_sale t JOIN cities c ON c.insee_code = t.city_insee_code LEFT JOIN geocodes g ON g.id = t.id
      WHERE t.latitude IS NULL AND t.postal_code IS NOT NULL)
    SELECT t.lot_id, CASE WHEN b.resolved THEN b.la ELSE t.latitude END AS latitude,
      CASE WHEN b.resolved THEN b.lo ELSE t.longitude END AS longitude, b.lot_id IS NOT NULL AS tried
    FROM tx_by_sale t LEFT JOIN b ON b.lot_id = t.lot_id"""


@query("apply_geocodes", ["tx_by_sale", "cities", "geocodes"], GEOCODED_SQL)
def _(spark, sf):
    root = _lots_store(spark, sf, "tx_by_sale")
    backlog = S.geocode_backlog(view(spark, sf, "tx_by_sale"), view(spark, sf, "cities"))
    matches = S.match_geocodes(backlog.select("id", "year"), view(spark, sf, "geocodes"))
    sinks.write_geocodes(spark, root, matches, NOW)
    rows = sinks.read_sales(spark, root)
    return rows.select("lot_id", "latitude", "longitude", F.col("geocoded_at").isNotNull().alias("tried"))


# --- jobs -----------------------------------------------------------------------------------------------------


def aggregate_paths(spark, sf):
    return {
        "sales": _write_csv(spark, sf, "sales-csv", lambda: view(spark, sf, "sales_csv")),
        "cities": _write_parquet(spark, sf, "cities"),
        "dept_stats": fresh_path(spark, "dept-stats"),
    }


_JOB_DEPT_SQL = DEPT_STATS_SQL.replace(
    "WHERE t.property_value > 0", "WHERE t.property_value > 0 AND CAST(t.mutation_id AS BIGINT) % 37 <> 0")


@query("job_dept_aggregate", ["tx", "cities"], _JOB_DEPT_SQL)
def job_dept_aggregate(spark, sf):
    return plain(jobs.job_dept_aggregate(spark, aggregate_paths(spark, sf)), "avg_price", "avg_price_per_sqm")


_YEAR_STATS = f"""
    WITH s AS (SELECT mutation_id, max(property_value) AS price,
        sum(CASE WHEN property_type IN ('MAISON', 'APPARTEMENT') AND built_surface BETWEEN 9 AND 1000
          THEN built_surface END) AS surface,
        max(CASE WHEN property_type IN ('MAISON', 'APPARTEMENT') THEN city_insee_code END) AS code
      FROM imported WHERE {_KEPT} AND year = {YEAR}
        AND mutation_nature IN ('Vente', 'Vente en l''état futur d''achèvement')
        AND property_value BETWEEN 10000 AND 5000000 GROUP BY mutation_id)
    SELECT code AS insee_code, {YEAR} AS year, count(*) AS transaction_count,
      CAST(sum(price) AS DOUBLE) AS total_price, sum(surface) AS total_residential_surface
    FROM s WHERE code IS NOT NULL AND surface IS NOT NULL GROUP BY code"""


@query("job_import_year", ["imported"], _YEAR_STATS)
def _(spark, sf):
    paths = {
        "sales": sales_file(spark, sf),
        "cities": _write_parquet(spark, sf, "cities"),
        "store": fresh_path(spark, "sales-store"),
    }
    return plain(jobs.job_import_year(spark, paths, YEAR, NOW).drop("updated_at"))


@query("job_reference_data", ["regions", "departments", "cities", "communes_feed"], f"""
    WITH feed AS ({_COMMUNES_SQL} AND department_code IN (SELECT code FROM departments WHERE CAST(code AS INT) % 5 <> 4)),
    city AS (SELECT coalesce(c.insee_code, f.insee_code) AS code, coalesce(f.name, c.name) AS name,
        coalesce(c.department_code, f.department_code) AS parent, coalesce(f.population, c.population) AS population,
        coalesce(f.area, c.area) AS area
      FROM (SELECT * FROM cities WHERE population % 2 = 0) AS c FULL JOIN feed f ON f.insee_code = c.insee_code),
    dept AS (SELECT d.code, d.name, d.region_code AS parent, sum(c.population) AS population, sum(c.area) AS area
      FROM departments d LEFT JOIN city c ON c.parent = d.code WHERE CAST(d.code AS INT) % 5 <> 4
      GROUP BY d.code, d.name, d.region_code)
    SELECT 'CITY' AS level, code, name, parent, population, area FROM city
    UNION ALL SELECT 'DEPARTMENT', code, name, parent, CAST(population AS BIGINT), area FROM dept
    UNION ALL SELECT 'REGION', r.code, r.name, NULL, CAST(sum(d.population) AS BIGINT), sum(d.area) FROM regions r
      LEFT JOIN dept d ON d.parent = r.code GROUP BY r.code, r.name""")
def _(spark, sf):
    regions, departments, cities = (view(spark, sf, n) for n in ("regions", "departments", "cities"))
    unknown = {"population": F.lit(None).cast("bigint"), "area": F.lit(None).cast("double")}
    nowhere = {"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")}
    half = departments.filter("CAST(code AS INT) % 5 < 2").withColumn("name", F.lit("old"))
    paths = {
        "regions": _write_parquet(
            spark, sf, "known-regions",
            lambda: regions.filter("code < '2'").withColumns({"name": F.lit("old"), **unknown})),
        "departments": _write_parquet(spark, sf, "known-departments", lambda: half.withColumns(unknown)),
        "cities": _write_parquet(
            spark, sf, "known-cities", lambda: cities.filter("population % 2 = 0").withColumns(nowhere)),
        "regions_json": _regions_feed(spark, sf),
        "departments_json": _departments_feed(spark, sf),
        "communes_json": _communes_feed(spark, sf),
        "out": fresh_path(spark, "reference"),
    }
    merged = jobs.job_reference_data(spark, paths, multi_line=False)

    def long(name, level, code, parent):
        return merged[name].select(
            F.lit(level).alias("level"), F.col(code).alias("code"), "name", parent.alias("parent"), "population", "area")

    return (
        long("cities", "CITY", "insee_code", F.col("department_code"))
        .unionByName(long("departments", "DEPARTMENT", "code", F.col("region_code")))
        .unionByName(long("regions", "REGION", "code", F.lit(None).cast("string")))
    )


@query("job_energy", ["energy"], ENERGY_SQL)
def _(spark, sf):
    return plain(jobs.job_energy(spark, _energy_file(spark, sf), fresh_path(spark, "indicators")), gridded=["value"])


@query("job_health", ["health"], HEALTH_SQL)
def _(spark, sf):
    return plain(jobs.job_health(spark, _health_file(spark, sf), fresh_path(spark, "indicators")), gridded=["value"])


@query("job_score_reviews", ["scored"], "SELECT id, sentiment_score, sentiment_label FROM scored")
def _(spark, sf):
    rows = jobs.job_score_reviews(spark, view(spark, sf, "reviews"), fresh_path(spark, "reviews"))
    return rows.select("id", "sentiment_score", "sentiment_label")


@query("job_recompute_stats", ["regions", "departments", "tx", "cities", "city_year"], f"""
    WITH r AS ({REGION_STATS_SQL}), d AS ({DEPARTMENT_STATS_SQL}), a AS ({_JOB_DEPT_SQL})
    SELECT 'REGION' AS level, code, transaction_count, average_price, average_price_per_sqm FROM r
    UNION ALL SELECT 'DEPARTMENT', code, transaction_count, average_price, average_price_per_sqm FROM d
    UNION ALL SELECT 'LOTS', department_code, transaction_count, avg_price, avg_price_per_sqm FROM a""")
def _(spark, sf):
    paths = {
        **aggregate_paths(spark, sf),
        "store": _lots_store(spark, sf),
        "regions": _write_parquet(spark, sf, "regions"),
        "departments": _write_parquet(spark, sf, "departments"),
    }
    done = jobs.job_recompute_stats(spark, paths, NOW)

    def long(name, level, code, *figures):
        names = ("transaction_count", "average_price", "average_price_per_sqm")
        return done[name].select(
            F.lit(level).alias("level"), F.col(code).alias("code"), *[F.col(f).alias(n) for f, n in zip(figures, names)])

    figures = ("transaction_count", "average_price", "average_price_per_sqm")
    lots = plain(done["dept_stats"], "avg_price", "avg_price_per_sqm")
    done["dept_stats"] = lots
    return (
        long("regions", "REGION", "code", *figures)
        .unionByName(long("departments", "DEPARTMENT", "code", *figures))
        .unionByName(long("dept_stats", "LOTS", "department_code", "transaction_count", "avg_price", "avg_price_per_sqm"))
    )


# --- read from stored summaries -------------------------------------------------------------------------------


def _rollup(name: str, like: str, make) -> None:
    """A key that must give what the key `like` gives from the lots."""
    QUERIES[name], CHECKS[name] = make, CHECKS[like]


def _summary(spark, sf):
    return sinks.read_prices(spark, sales_store(spark, sf))


_MEANS = ("average_surface", "average_price_per_sqm")
_rollup("transaction_stats_rollup", "transaction_stats", lambda spark, sf: plain(U.stats_of_summary(U.summary_scope(
    _summary(spark, sf), view(spark, sf, "cities"), dept=DEPT, year=YEAR), []), gridded=_MEANS))
_rollup("transaction_stats_of_region_rollup", "transaction_stats_of_region", lambda spark, sf: plain(
    U.stats_of_summary(U.summary_scope(_summary(spark, sf), view(spark, sf, "cities"), region=REGION,
                                       departments=view(spark, sf, "departments")), []), gridded=_MEANS))
_rollup("transaction_stats_by_rollup", "transaction_stats_by", lambda spark, sf: plain(U.stats_of_summary(
    _summary(spark, sf).withColumnRenamed("insee_code", "city_insee_code"), ["city_insee_code", "year"]), gridded=_MEANS))
_rollup("transaction_stats_by_department_rollup", "transaction_stats_by_department", lambda spark, sf: plain(
    U.stats_of_summary(_summary(spark, sf), ["department_code"], view(spark, sf, "cities")), gridded=_MEANS))
_rollup("dept_sales_stats_rollup", "dept_sales_stats", lambda spark, sf: plain(
    U.dept_stats_of_summary(_summary(spark, sf), view(spark, sf, "cities")), "avg_price", "avg_price_per_sqm"))


def _register_cells(metric: str) -> None:
    def points(spark, sf):
        root = sales_store(spark, sf)
        found = U.heat_points_of_cells(sinks.read_cells(spark, root), BOX, metric, lots=sinks.read_sales(spark, root))
        return plain(found, gridded=[] if metric == "TRANSACTION_COUNT" else ["value"])

    _rollup(f"heat_points_{metric.lower()}_stored", f"heat_points_{metric.lower()}", points)


for _metric in S.HEAT_METRICS:
    _register_cells(_metric)


_rollup("in_viewport_stored", "in_viewport", lambda spark, sf: S.in_viewport(
    sinks.read_sales(spark, sales_store(spark, sf)).select("id", "latitude", "longitude"), *BOX))


@query("page_after", ["tx"], """
    SELECT id, CAST(mutation_date AS STRING) AS mutation_date, city_insee_code FROM tx
    ORDER BY tx.mutation_date, tx.id LIMIT 20 OFFSET 2000""")
def _(spark, sf):
    """Page 100 of all sales by key: what is needed of the page before is its last row."""
    rows = sinks.read_sales(spark, sales_store(spark, sf)).select("id", "mutation_date", "city_insee_code")
    last = rows.orderBy("mutation_date", "id").offset(1999).limit(1).first()
    return plain(P.page_after(rows, ["mutation_date", "id"], [last["mutation_date"], last["id"]]))


def _features_in_view_stored(spark, sf):
    """The viewport over boundaries that were stored with their boxes."""
    path = _input(spark, sf, "boxed-boundaries", lambda path: sinks.write_boundaries(view(spark, sf, "all_boundaries"), path))
    return G.features_in_view(spark.read.parquet(path), *BOX).select("geographic_level", "geographic_code")


_rollup("features_in_view_stored", "features_in_view", _features_in_view_stored)
