"""Registered queries: sales, statistics, places, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import address_line
from ..operators import hierarchy as H
from ..operators import paging as P
from ..operators import runs as J
from ..operators import sales as S
from .fixtures import view
from .registry import plain, query

CITY, DEPT, REGION, YEAR = "00005", "03", "1", 2019
BOX = (41.0, -5.0, 45.0, 0.0)
IMPORT_JOB = "job3"

_SUMMARY = """id, CAST(mutation_date AS STRING) AS mutation_date, mutation_nature,
  CAST(property_value AS DOUBLE) AS property_value, t.postal_code, c.name AS city_name, t.city_insee_code,
  property_type, built_surface, room_count"""


def _job_sales(spark, sf):
    """Sales as the department job sees them."""
    return view(spark, sf, "tx").select(
        F.col("city_insee_code").alias("insee_code"),
        F.col("property_value").cast("double").alias("price"),
        F.col("built_surface").alias("surface"),
    )


def _city_years(spark, sf):
    return S.city_year_stats(view(spark, sf, "tx"))


def _places(spark, sf):
    return (view(spark, sf, n) for n in ("regions", "departments", "cities"))


def city_metric(spark, sf):
    """(code, value): mean price of every commune."""
    cities = view(spark, sf, "cities")
    codes = cities.select(F.col("insee_code").alias("code"))
    rows = H.city_stats(cities, _city_years(spark, sf), codes, max_codes=None)
    return rows.select("code", F.col("average_price").alias("value"))


# --- joins and department statistics --------------------------------------------------------------------------


@query("attach_department", ["tx", "cities"], """
    SELECT t.city_insee_code AS insee_code, CAST(t.property_value AS DOUBLE) AS price, t.built_surface AS surface,
      c.department_code FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code""")
def _(spark, sf):
    return S.attach_department(_job_sales(spark, sf), view(spark, sf, "cities"))


DEPT_STATS_SQL = """
    SELECT c.department_code, count(*) AS transaction_count, round(avg(CAST(t.property_value AS DOUBLE)), 6) AS avg_price,
      round(avg(CASE WHEN t.built_surface > 0 THEN CAST(t.property_value AS DOUBLE) / t.built_surface END), 6)
        AS avg_price_per_sqm,
      quantile_disc(CAST(t.property_value AS DOUBLE), 0.5) AS median_price
    FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code WHERE t.property_value > 0
    GROUP BY c.department_code"""


@query("dept_sales_stats", ["tx", "cities"], DEPT_STATS_SQL)
def _(spark, sf):
    return plain(S.dept_sales_stats(_job_sales(spark, sf), view(spark, sf, "cities")), "avg_price", "avg_price_per_sqm")


@query("precomputed_dept_stats", ["tx", "cities"], f"""
    WITH d AS ({DEPT_STATS_SQL}) SELECT * FROM d WHERE department_code = '{DEPT}'""")
def _(spark, sf):
    stats = S.dept_sales_stats(_job_sales(spark, sf), view(spark, sf, "cities"))
    return plain(H.precomputed_dept_stats(stats, DEPT), "avg_price", "avg_price_per_sqm")


@query("dedup_mutations", ["sale"], """
    SELECT mutation_id, year, CAST(price AS DOUBLE) AS price, surface, city_insee_code
    FROM sale WHERE city_insee_code IS NOT NULL""")
def _(spark, sf):
    return plain(S.dedup_mutations(view(spark, sf, "tx")))


_CITY_YEAR_SQL = """
    SELECT insee_code, year, transaction_count, CAST(total_price AS DOUBLE) AS total_price, total_residential_surface
    FROM city_year"""


@query("city_year_stats", ["city_year"], _CITY_YEAR_SQL)
def _(spark, sf):
    return plain(_city_years(spark, sf))


# --- rollups --------------------------------------------------------------------------------------------------

_ROLLUP = """
    CAST(coalesce(sum(s.transaction_count), 0) AS BIGINT) AS transaction_count,
    CASE WHEN sum(s.transaction_count) > 0
      THEN CAST(sum(s.total_price) AS DOUBLE) / CAST(sum(s.transaction_count) AS DOUBLE) END AS average_price,
    CASE WHEN sum(s.total_residential_surface) > 0
      THEN CAST(sum(s.total_price) AS DOUBLE) / sum(s.total_residential_surface) END AS average_price_per_sqm"""


@query("hierarchy", ["regions", "departments", "cities", "city_year"], """
    SELECT r.code AS region_code, r.name AS region_name, d.code AS department_code, d.name AS department_name,
      c.insee_code, c.name AS city_name, s.year, s.transaction_count, CAST(s.total_price AS DOUBLE) AS total_price,
      s.total_residential_surface
    FROM regions r LEFT JOIN departments d ON d.region_code = r.code LEFT JOIN cities c ON c.department_code = d.code
      LEFT JOIN city_year s ON s.insee_code = c.insee_code""")
def _(spark, sf):
    return plain(H.hierarchy(*_places(spark, sf), _city_years(spark, sf)))


REGION_STATS_SQL = f"""
    SELECT r.code, r.name, {_ROLLUP} FROM regions r LEFT JOIN departments d ON d.region_code = r.code
      LEFT JOIN cities c ON c.department_code = d.code LEFT JOIN city_year s ON s.insee_code = c.insee_code
    GROUP BY r.code, r.name"""
DEPARTMENT_STATS_SQL = f"""
    SELECT d.code, d.name, d.region_code, {_ROLLUP} FROM departments d
      LEFT JOIN cities c ON c.department_code = d.code LEFT JOIN city_year s ON s.insee_code = c.insee_code
    GROUP BY d.code, d.name, d.region_code"""


@query("region_stats", ["regions", "departments", "cities", "city_year"], REGION_STATS_SQL)
def _(spark, sf):
    return plain(H.region_stats(*_places(spark, sf), _city_years(spark, sf)))


@query("department_stats", ["departments", "cities", "city_year"], DEPARTMENT_STATS_SQL)
def _(spark, sf):
    _, departments, cities = _places(spark, sf)
    return plain(H.department_stats(departments, cities, _city_years(spark, sf)))


@query("department_stats_of_region", ["departments", "cities", "city_year"],
       f"WITH d AS ({DEPARTMENT_STATS_SQL}) SELECT * FROM d WHERE region_code = '{REGION}'")
def _(spark, sf):
    _, departments, cities = _places(spark, sf)
    return plain(H.department_stats(departments, cities, _city_years(spark, sf), region=REGION))


@query("city_stats", ["tx", "city_rollup"], f"""
    SELECT * FROM city_rollup WHERE code IN
      (SELECT DISTINCT city_insee_code FROM tx WHERE year = {YEAR})""")
def _(spark, sf):
    codes = view(spark, sf, "tx").filter(F.col("year") == YEAR).select(F.col("city_insee_code").alias("code"))
    return plain(H.city_stats(view(spark, sf, "cities"), _city_years(spark, sf), codes))


@query("distinct_codes", ["tx"], "SELECT DISTINCT city_insee_code AS code FROM tx")
def _(spark, sf):
    return H.distinct_codes(view(spark, sf, "tx").select(F.col("city_insee_code").alias("code")))


@query("recompute_departments", ["departments", "cities"], """
    SELECT d.code, d.name, d.region_code,
      (SELECT CAST(sum(population) AS BIGINT) FROM cities c WHERE c.department_code = d.code) AS population,
      (SELECT sum(area) FROM cities c WHERE c.department_code = d.code) AS area FROM departments d""")
def _(spark, sf):
    _, departments, cities = _places(spark, sf)
    return H.recompute_departments(departments, cities)


@query("recompute_regions", ["regions", "departments", "cities"], """
    SELECT r.code, r.name, CAST(sum(c.population) AS BIGINT) AS population, sum(c.area) AS area
    FROM regions r LEFT JOIN departments d ON d.region_code = r.code LEFT JOIN cities c ON c.department_code = d.code
    GROUP BY r.code, r.name""")
def _(spark, sf):
    regions, departments, cities = _places(spark, sf)
    return H.recompute_regions(regions, H.recompute_departments(departments, cities))


@query("national_totals", ["regions", "departments", "cities"], """
    SELECT (SELECT count(*) FROM regions) AS region_count, CAST(coalesce(sum(c.population), 0) AS BIGINT) AS population,
      coalesce(sum(c.area), 0) AS area FROM cities c JOIN departments d ON d.code = c.department_code""")
def _(spark, sf):
    regions, departments, cities = _places(spark, sf)
    return H.national_totals(H.recompute_regions(regions, H.recompute_departments(departments, cities)))


@query("child_counts", ["departments", "cities"], """
    SELECT d.code, d.name, count(c.insee_code) AS child_count FROM departments d
      LEFT JOIN cities c ON c.department_code = d.code GROUP BY d.code, d.name""")
def _(spark, sf):
    _, departments, cities = _places(spark, sf)
    return H.child_counts(departments, cities, "department_code")


@query("drop_orphans", ["communes_feed", "departments"], """
    SELECT code, department_code FROM communes_feed
    WHERE department_code IN (SELECT code FROM departments)""")
def _(spark, sf):
    feed = view(spark, sf, "communes_feed").select("code", "department_code")
    return H.drop_orphans(feed, view(spark, sf, "departments"), "department_code", "code")


@query("place_metrics", ["cities"], """
    SELECT insee_code AS code, area / CAST(100 AS DOUBLE) AS area_km2,
      CASE WHEN population <> 0 AND area <> 0 THEN round(CAST(population AS DOUBLE) / (area / 100), 6) END AS density,
      CASE WHEN population <> 0 AND area <> 0
        THEN round(area * 3 * 1000000 / CAST(population AS DOUBLE), 6) END AS gdp_per_capita
    FROM cities""")
def _(spark, sf):
    cities = view(spark, sf, "cities").withColumn("gdp", F.col("area") * 3)
    return plain(H.place_metrics(cities, "insee_code", area_unit="ha"), "density", "gdp_per_capita")


# --- place searches -------------------------------------------------------------------------------------------


@query("search_cities", ["cities"], """
    SELECT * FROM cities WHERE lower(name) LIKE '%er#000000%' ORDER BY insee_code LIMIT 20 OFFSET 20""")
def _(spark, sf):
    return H.search_cities(view(spark, sf, "cities"), dept=DEPT, query="ER#000000", number=1)


@query("search_cities_of_department", ["cities"],
       f"SELECT * FROM cities WHERE department_code = '{DEPT}' ORDER BY insee_code LIMIT 20")
def _(spark, sf):
    return H.search_cities(view(spark, sf, "cities"), dept=DEPT, query="  ")


@query("city_detail", ["cities", "departments"], f"""
    SELECT c.insee_code, c.name, c.postal_code, c.department_code, d.name AS department_name, c.population
    FROM cities c LEFT JOIN departments d ON d.code = c.department_code WHERE c.insee_code = '{CITY}'""")
def _(spark, sf):
    return H.city_detail(view(spark, sf, "cities"), view(spark, sf, "departments"), CITY)


@query("list_departments", ["departments", "regions"], f"""
    SELECT d.code, d.name, d.region_code, r.name AS region_name FROM departments d
      LEFT JOIN regions r ON r.code = d.region_code WHERE d.region_code = '{REGION}'""")
def _(spark, sf):
    return H.list_departments(view(spark, sf, "departments"), view(spark, sf, "regions"), region=REGION)


@query("list_regions", ["regions"], "SELECT * FROM regions")
def _(spark, sf):
    return H.list_regions(view(spark, sf, "regions"))


@query("search_regions", ["regions"], "SELECT * FROM regions WHERE lower(name) LIKE '%a%' ORDER BY code LIMIT 8")
def _(spark, sf):
    return H.search_regions(view(spark, sf, "regions"), " A ")


@query("search_places", ["regions", "departments"], """
    SELECT code, name, level FROM (
      SELECT code, name, 'REGION' AS level, 0 AS k FROM regions WHERE lower(name) LIKE '%1%'
      UNION ALL SELECT code, name, 'DEPARTMENT', 1 FROM departments WHERE lower(name) LIKE '%1%' OR code LIKE '%1%')
    ORDER BY k, code LIMIT 8""")
def _(spark, sf):
    return H.search_places(view(spark, sf, "regions"), view(spark, sf, "departments"), "1 ")


# --- sale searches --------------------------------------------------------------------------------------------


@query("transaction_summary", ["tx", "cities"], f"""
    SELECT {_SUMMARY} FROM tx t LEFT JOIN cities c ON c.insee_code = t.city_insee_code""")
def _(spark, sf):
    # types are converted once for a lot, not for each of its communes
    return S.transaction_summary(plain(view(spark, sf, "tx")), view(spark, sf, "cities"))


@query("search_transactions", ["tx", "cities"], f"""
    SELECT {_SUMMARY} FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code
    WHERE c.department_code = '{DEPT}' AND t.year = {YEAR} AND t.property_value BETWEEN 50000 AND 400000
      AND t.property_type = 'MAISON' ORDER BY t.mutation_date DESC, t.id LIMIT 20 OFFSET 20""")
def _(spark, sf):
    return plain(S.search_transactions(
        view(spark, sf, "tx"), view(spark, sf, "cities"), number=1, sort=[F.desc("mutation_date")], city=" ",
        dept=DEPT, year=YEAR, min_price=50_000, max_price=400_000, property_type="MAISON"))


@query("search_transactions_full", ["tx", "cities", "departments"], f"""
    SELECT {_SUMMARY} FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code
      JOIN departments d ON d.code = c.department_code
    WHERE d.region_code = '{REGION}' AND t.room_count >= 3 AND t.built_surface >= 35
    ORDER BY t.mutation_date DESC, t.id LIMIT 20""")
def _(spark, sf):
    return plain(S.search_transactions(
        view(spark, sf, "tx"), view(spark, sf, "cities"), sort=[F.desc("mutation_date")], region=REGION,
        departments=view(spark, sf, "departments"), min_rooms=3, min_surface=35))


@query("transaction_detail", ["tx", "cities"], """
    SELECT id, CAST(mutation_date AS STRING) AS mutation_date, mutation_nature,
      CAST(property_value AS DOUBLE) AS property_value, t.postal_code, c.name AS city_name, t.city_insee_code,
      c.department_code, property_type, built_surface, room_count, lot_count,
      CASE WHEN built_surface > 0 THEN CAST(property_value AS DOUBLE) / built_surface END AS price_per_sqm
    FROM tx t LEFT JOIN cities c ON c.insee_code = t.city_insee_code WHERE id = (SELECT min(id) FROM tx)""")
def _(spark, sf):
    tx = view(spark, sf, "tx")
    return plain(S.transaction_detail(tx, view(spark, sf, "cities"), tx.agg(F.min("id").alias("id")).scalar()))


@query("page", ["tx"], """
    SELECT id, mutation_id, lot_count FROM tx ORDER BY mutation_id DESC, id LIMIT 20 OFFSET 40""")
def _(spark, sf):
    tx = view(spark, sf, "tx").select("id", "mutation_id", "lot_count")
    return P.page(tx, [F.desc("mutation_id"), "id"], number=2)


@query("page_info", ["tx"], f"""
    SELECT CAST(20 AS BIGINT) AS size, count(*) AS total_elements, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages,
      CAST(2 AS BIGINT) AS number FROM tx WHERE year = {YEAR}""")
def _(spark, sf):
    return P.page_info(S.filter_transactions(view(spark, sf, "tx"), year=YEAR), number=2)


@query("address_lines", ["tx", "cities"], """
    SELECT id, CASE WHEN lot_count % 2 = 0 AND lot_count % 3 = 0 THEN '' WHEN lot_count % 2 = 0 THEN 'rue, '
        WHEN lot_count % 3 = 0 THEN concat(CAST(lot_count AS STRING), ', ')
        ELSE concat(CAST(lot_count AS STRING), ' rue, ') END
      || concat_ws(' ', t.postal_code, c.name) AS address
    FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code""")
def _(spark, sf):
    tx = view(spark, sf, "tx")
    cities = view(spark, sf, "cities").select(F.col("insee_code").alias("city_insee_code"), "name")
    number = F.when(F.col("lot_count") % 2 != 0, F.col("lot_count").cast("string"))
    street = F.when(F.col("lot_count") % 3 != 0, F.lit("rue")).otherwise("")
    return tx.join(cities, "city_insee_code").select(
        "id", address_line(number, street, F.col("postal_code"), F.col("name")).alias("address"))


@query("price_per_sqm_rows", ["tx"], """
    SELECT id, CASE WHEN built_surface > 0 THEN CAST(property_value AS DOUBLE) / built_surface END AS price_per_sqm
    FROM tx""")
def _(spark, sf):
    return S.price_per_sqm_rows(view(spark, sf, "tx"))


# --- sale statistics ------------------------------------------------------------------------------------------


def _stats_sql(source: str, keys: str) -> str:
    """Statistics of each group of `source`, which has `keys`, property_value and built_surface."""
    select = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
      WITH scope AS ({source}),
      ranked AS (SELECT *, row_number() OVER ({over} ORDER BY CASE WHEN property_value > 0 THEN property_value END
          NULLS LAST) AS rn,
        count(CASE WHEN property_value > 0 THEN 1 END) OVER ({over}) AS n FROM scope)
      SELECT {select}
        CASE WHEN max(n) > 0 THEN count(*) ELSE 0 END AS total_transactions,
        CASE WHEN max(n) > 0 THEN CAST((2 * CAST(sum(CASE WHEN property_value > 0 THEN property_value END) * 100
          AS HUGEINT) + max(n)) // (2 * max(n)) AS DOUBLE) / 100 ELSE 0 END AS average_price,
        coalesce(CAST(max(CASE WHEN rn = n // 2 + 1 AND property_value > 0 THEN property_value END) AS DOUBLE), 0)
          AS median_price,
        coalesce(CAST(min(CASE WHEN property_value > 0 THEN property_value END) AS DOUBLE), 0) AS min_price,
        coalesce(CAST(max(CASE WHEN property_value > 0 THEN property_value END) AS DOUBLE), 0) AS max_price,
        CASE WHEN max(n) > 0 THEN floor(coalesce(avg(CASE WHEN built_surface > 0 THEN built_surface END), 0) * 1000 + 0.2718281) / 1000
          ELSE 0 END AS average_surface,
        CASE WHEN max(n) > 0 THEN floor(coalesce(avg(CASE WHEN built_surface > 0 AND property_value > 0
          THEN CAST(property_value AS DOUBLE) / built_surface END), 0) * 1000 + 0.2718281) / 1000 ELSE 0 END AS average_price_per_sqm
      FROM ranked {group}"""


_MEANS = ("average_surface", "average_price_per_sqm")


@query("transaction_stats", ["tx", "cities"], _stats_sql(
    f"""SELECT t.* FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code
        WHERE c.department_code = '{DEPT}' AND t.year = {YEAR}""", ""))
def _(spark, sf):
    stats = S.transaction_stats(view(spark, sf, "tx"), view(spark, sf, "cities"), dept=DEPT, year=YEAR)
    return plain(stats, gridded=_MEANS)


@query("transaction_stats_of_region", ["tx", "cities", "departments"], _stats_sql(
    f"""SELECT t.* FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code
        JOIN departments d ON d.code = c.department_code WHERE d.region_code = '{REGION}'""", ""))
def _(spark, sf):
    stats = S.transaction_stats(
        view(spark, sf, "tx"), view(spark, sf, "cities"), region=REGION, departments=view(spark, sf, "departments"))
    return plain(stats, gridded=_MEANS)


@query("transaction_stats_by", ["tx"], _stats_sql("SELECT * FROM tx", "city_insee_code, year"))
def _(spark, sf):
    return plain(S.transaction_stats_by(view(spark, sf, "tx"), ["city_insee_code", "year"]), gridded=_MEANS)


@query("transaction_stats_by_department", ["tx", "cities"], _stats_sql(
    "SELECT t.*, c.department_code FROM tx t JOIN cities c ON c.insee_code = t.city_insee_code", "department_code"))
def _(spark, sf):
    rows = view(spark, sf, "tx").withColumnRenamed("city_insee_code", "insee_code")
    return plain(S.transaction_stats_by(rows, ["department_code"], view(spark, sf, "cities")), gridded=_MEANS)


@query("price_overview", ["tx"], f"""
    WITH st AS ({_stats_sql("SELECT * FROM tx", "city_insee_code")})
    SELECT city_insee_code, label, value FROM (
      SELECT city_insee_code, total_transactions AS n, 'Average' AS label, average_price AS value FROM st
      UNION ALL SELECT city_insee_code, total_transactions, 'Median', median_price FROM st
      UNION ALL SELECT city_insee_code, total_transactions, 'Min', min_price FROM st
      UNION ALL SELECT city_insee_code, total_transactions, 'Max', max_price FROM st) AS u WHERE n > 0""")
def _(spark, sf):
    keys = ["city_insee_code"]
    return plain(S.price_overview(S.transaction_stats_by(view(spark, sf, "tx"), keys), keys))


@query("rows_per_year", ["tx"], "SELECT year, count(*) AS row_count FROM tx GROUP BY year")
def _(spark, sf):
    return S.rows_per_year(view(spark, sf, "tx"))


_IN_BOX = f"latitude BETWEEN {BOX[0]} AND {BOX[2]} AND longitude BETWEEN {BOX[1]} AND {BOX[3]}"


@query("in_viewport", ["tx"], f"SELECT id, latitude, longitude FROM tx WHERE {_IN_BOX}")
def _(spark, sf):
    return S.in_viewport(view(spark, sf, "tx").select("id", "latitude", "longitude"), *BOX)


def heat_sql(value: str, extra: str = "") -> str:
    return f"""
    SELECT round(latitude / CAST(0.001 AS DOUBLE), 0) * CAST(0.001 AS DOUBLE) AS latitude,
      round(longitude / CAST(0.001 AS DOUBLE), 0) * CAST(0.001 AS DOUBLE) AS longitude,
      {value} AS value, count(*) AS samples
    FROM tx WHERE {_IN_BOX} AND property_value > 0 {extra}
    GROUP BY 1, 2"""


@query("heat_points_average_price", ["tx"], heat_sql(
    "floor(avg(CAST(property_value AS DOUBLE)) * 1000 + 0.2718281) / 1000"))
def _(spark, sf):
    return plain(S.heat_points(view(spark, sf, "tx"), BOX, "AVERAGE_PRICE"), gridded=["value"])


@query("heat_points_average_price_per_sqm", ["tx"], heat_sql(
    "floor(avg(CAST(property_value AS DOUBLE) / built_surface) * 1000 + 0.2718281) / 1000", "AND built_surface > 0"))
def _(spark, sf):
    return plain(S.heat_points(view(spark, sf, "tx"), BOX, "AVERAGE_PRICE_PER_SQM"), gridded=["value"])


@query("heat_points_transaction_count", ["tx"], heat_sql("CAST(count(*) AS DOUBLE)"))
def _(spark, sf):
    return S.heat_points(view(spark, sf, "tx"), BOX, "TRANSACTION_COUNT")


# --- geocoding and runs ---------------------------------------------------------------------------------------


@query("resolve_city", ["tx", "cities"], """
    SELECT t.id, c.insee_code AS city_insee_code FROM tx t
      LEFT JOIN cities c ON c.insee_code = t.city_insee_code AND c.population % 3 <> 0""")
def _(spark, sf):
    from ..sources import resolve_city

    known = view(spark, sf, "cities").filter(F.col("population") % 3 != 0)
    return resolve_city(view(spark, sf, "tx").select("id", "city_insee_code"), known)


@query("geocode_backlog", ["tx", "cities"], """
    SELECT t.id, t.year, t.postal_code, c.name AS city_name FROM tx t
      JOIN cities c ON c.insee_code = t.city_insee_code
    WHERE t.latitude IS NULL AND t.postal_code IS NOT NULL""")
def _(spark, sf):
    return S.geocode_backlog(view(spark, sf, "tx"), view(spark, sf, "cities"))


@query("geocode_backlog_size", ["tx"], "SELECT count(*) AS backlog FROM tx WHERE latitude IS NULL")
def _(spark, sf):
    return S.geocode_backlog_size(view(spark, sf, "tx"))


@query("match_geocodes", ["tx_by_sale", "geocodes"], """
    SELECT t.lot_id, t.id, g.latitude, g.longitude, g.score,
      g.latitude IS NOT NULL AND g.longitude IS NOT NULL AND (g.score IS NULL OR g.score >= 0.4) AS resolved
    FROM tx_by_sale t LEFT JOIN geocodes g ON g.id = t.id""")
def _(spark, sf):
    inputs = view(spark, sf, "tx_by_sale").select("lot_id", "id")
    return S.match_geocodes(inputs, view(spark, sf, "geocodes"))


_LATEST = """
    SELECT year, epoch_us(start_time) AS last_run_at,
      (epoch_us(end_time) - epoch_us(start_time)) // 1000 AS last_duration_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY start_time DESC) AS rn FROM job_runs
      WHERE status = 'COMPLETED' AND end_time IS NOT NULL {extra}) AS r WHERE rn = 1"""


@query("latest_runs", ["job_runs"], _LATEST.format(extra=""))
def _(spark, sf):
    return plain(J.latest_runs(view(spark, sf, "job_runs")))


@query("partition_status", ["tx", "job_runs"], f"""
    WITH last AS ({_LATEST.format(extra=f"AND job_name = '{IMPORT_JOB}'")})
    SELECT t.year, t.row_count, last.last_run_at, last.last_duration_ms
    FROM (SELECT year, count(*) AS row_count FROM tx GROUP BY year) AS t LEFT JOIN last ON last.year = t.year""")
def _(spark, sf):
    return plain(J.partition_status(view(spark, sf, "tx"), view(spark, sf, "job_runs"), IMPORT_JOB))


@query("job_status", ["job_runs"], """
    SELECT job_name, CASE WHEN max(CASE WHEN status = 'STARTED' AND end_time IS NULL THEN 1 ELSE 0 END) = 1
        THEN 'RUNNING' ELSE 'IDLE' END AS state,
      epoch_us(max(start_time)) AS last_run_at, arg_max(status, start_time) AS last_status,
      max(CASE WHEN rn = 1 THEN (epoch_us(end_time) - epoch_us(start_time)) // 1000 END) AS last_duration_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY start_time DESC) AS rn FROM job_runs) AS r
    GROUP BY job_name""")
def _(spark, sf):
    return plain(J.job_status(view(spark, sf, "job_runs")))
