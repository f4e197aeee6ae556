"""Registered queries: boundaries, map metrics, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo as G
from ..operators import hierarchy as H
from ..operators import sales as S
from .catalog_sales import BOX, REGION, city_metric, heat_sql
from .fixtures import view
from .registry import plain, query

_AREA = "(radians(x1) - radians(x0)) * (sin(radians(y1)) - sin(radians(y0))) * 6371008.8 * 6371008.8 / 1000000"


@query("boundaries", ["all_boundaries"], "SELECT * FROM all_boundaries WHERE geographic_level = 'CITY'")
def _(spark, sf):
    return G.boundaries(view(spark, sf, "all_boundaries"), "CITY")


@query("dept_boundaries_of_region", ["boundaries", "departments"], f"""
    SELECT * FROM boundaries WHERE geographic_code IN
      (SELECT code FROM departments WHERE region_code = '{REGION}')""")
def _(spark, sf):
    return G.dept_boundaries_of_region(
        view(spark, sf, "all_boundaries"), view(spark, sf, "departments"), REGION)


@query("to_features", ["boundaries"], """
    SELECT geographic_code, concat('{"type":"Feature","properties":{"code":"', geographic_code, '","name":"', name,
      '","level":"', geographic_level, '"},"geometry":{"coordinates":',
      CAST(json_extract(geometry, '$.coordinates') AS STRING), ',"type":', CAST(json_extract(geometry, '$.type') AS STRING),
      '}}') AS feature
    FROM boundaries""")
def _(spark, sf):
    return G.to_features(view(spark, sf, "boundaries"))


@query("parse_geometry", ["boxes"], """
    SELECT level AS geographic_level, code AS geographic_code, count(*) AS part_count, 5 * count(*) AS vertex_count,
      round(sum(3 * x0 + 2 * x1), 6) AS sum_x, round(sum(3 * y0 + 2 * y1), 6) AS sum_y
    FROM boxes GROUP BY level, code""")
def _(spark, sf):
    vertices = F.flatten(F.flatten("parts"))

    def total(i):
        return F.aggregate(vertices, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(i)))

    return plain(
        G.parse_geometry(view(spark, sf, "all_boundaries")).select(
            "geographic_level", "geographic_code", F.size("parts").cast("bigint").alias("part_count"),
            F.size(vertices).cast("bigint").alias("vertex_count"), total(0).alias("sum_x"), total(1).alias("sum_y")),
        "sum_x", "sum_y")


@query("area_km2", ["boxes"], f"""
    SELECT code AS geographic_code, round(sum({_AREA}), 5) AS area_km2 FROM boxes GROUP BY level, code""")
def _(spark, sf):
    return plain(G.area_km2(view(spark, sf, "all_boundaries")), "area_km2", digits=5)


@query("feature_bbox", ["boxes"], """
    SELECT level AS geographic_level, code AS geographic_code, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x,
      max(y1) AS max_y FROM boxes GROUP BY level, code""")
def _(spark, sf):
    return G.feature_bbox(view(spark, sf, "all_boundaries")).drop("name", "geometry")


@query("features_in_view", ["boxes"], """
    SELECT level AS geographic_level, code AS geographic_code FROM boxes GROUP BY level, code
    HAVING min(x0) <= 0 AND max(x1) >= -5 AND min(y0) <= 45 AND max(y1) >= 41""")
def _(spark, sf):
    seen = G.features_in_view(view(spark, sf, "all_boundaries"), *BOX)
    return seen.select("geographic_level", "geographic_code")


@query("tag_points", ["tx", "boxes"], """
    SELECT t.id, min(b.code) AS code FROM tx t JOIN boxes b ON b.level = 'DEPARTMENT'
      AND t.longitude > b.x0 AND t.longitude < b.x1 AND t.latitude > b.y0 AND t.latitude < b.y1 GROUP BY t.id""")
def _(spark, sf):
    return G.tag_points(view(spark, sf, "tx"), view(spark, sf, "boundaries"))


@query("tag_points_communes", ["tx", "boxes"], """
    SELECT t.id, min(b.code) AS code FROM tx t JOIN boxes b ON b.level = 'CITY'
      AND t.longitude > b.x0 AND t.longitude < b.x1 AND t.latitude > b.y0 AND t.latitude < b.y1 GROUP BY t.id""")
def _(spark, sf):
    return G.tag_points(view(spark, sf, "tx"), view(spark, sf, "city_boundaries"), tile=0.25)


@query("swap_layer", ["cities", "departments"], """
    SELECT code, name, 'parent' AS layer FROM departments WHERE code NOT IN
      (SELECT department_code FROM cities WHERE area > 40)
    UNION ALL SELECT insee_code, name, 'child' FROM cities WHERE area > 40""")
def _(spark, sf):
    cities = view(spark, sf, "cities").filter("area > 40")
    parents = view(spark, sf, "departments").select("code", "name", F.lit("parent").alias("layer"))
    children = cities.select(F.col("insee_code").alias("code"), "name", F.lit("child").alias("layer"))
    return G.swap_layer(parents, children, cities.select(F.col("department_code").alias("code")))


def _features(spark, sf):
    return view(spark, sf, "cities").select(F.col("insee_code").alias("code"), "population", "area")


def _known_stats(spark, sf):
    """Statistics of the communes that have sales; the others fall back on their own properties."""
    cities = view(spark, sf, "cities")
    codes = cities.select(F.col("insee_code").alias("code"))
    stats = H.city_stats(cities, S.city_year_stats(view(spark, sf, "tx")), codes, max_codes=None)
    return stats.filter("transaction_count > 0")


_FROM_STATS = {
    "population": "CAST(s.population AS DOUBLE)",
    "density": "CASE WHEN s.area <> 0 THEN CAST(s.population AS DOUBLE) / s.area END",
    "gdp_per_capita": "CAST(NULL AS DOUBLE)",
    "average_price": "s.average_price",
    "average_price_per_sqm": "s.average_price_per_sqm",
    "transaction_count": "CAST(s.transaction_count AS DOUBLE)",
}
_FROM_FEATURE = {
    "population": "CAST(c.population AS DOUBLE)",
    "density": "CASE WHEN c.area <> 0 THEN CAST(c.population AS DOUBLE) / (c.area / 100) END",
}


def _register_metric(metric: str) -> None:
    own = _FROM_FEATURE.get(metric, "CAST(NULL AS DOUBLE)")

    @query(f"metric_by_code_{metric}", ["cities", "city_rollup"], f"""
        SELECT c.insee_code AS code, round(CASE WHEN s.code IS NOT NULL THEN {_FROM_STATS[metric]} ELSE {own} END, 6)
          AS value
        FROM cities c LEFT JOIN city_rollup s ON s.code = c.insee_code AND s.transaction_count > 0""")
    def _(spark, sf):
        return plain(G.metric_by_code(_features(spark, sf), _known_stats(spark, sf), metric), "value")


for _metric in G.MAP_METRICS:
    _register_metric(_metric)


_COUNTRY = {
    "population": "CAST(population AS DOUBLE)",
    "density": "CASE WHEN population <> 0 THEN CAST(population AS DOUBLE) / (k + 7) END",
    "gdp_per_capita": "CASE WHEN population <> 0 THEN gdp_md * 1000000 / CAST(population AS DOUBLE) END",
    "average_price": "CAST(NULL AS DOUBLE)",
}


def _register_country(metric: str) -> None:
    @query(f"country_metric_{metric}", ["countries"], f"""
        SELECT adm0_a3 AS code, round({_COUNTRY[metric]}, 6) AS value FROM countries""")
    def _(spark, sf):
        rows = view(spark, sf, "countries").select(
            F.col("adm0_a3").alias("code"), "population", F.col("gdp_md").alias("gdp"),
            (F.col("k") + 7).cast("double").alias("area"))
        return plain(G.country_metric(rows, metric), "value")


for _metric in _COUNTRY:
    _register_country(_metric)


@query("choropleth_classes", ["city_class"], """
    SELECT code, value, ratio, CASE WHEN ratio IS NOT NULL
      THEN CAST(least(6, floor(ratio * 7)) AS INT) END AS class FROM city_class""")
def _(spark, sf):
    return G.choropleth_classes(city_metric(spark, sf))


@query("heat_weights", ["tx"], f"""
    WITH p AS ({heat_sql("CAST(count(*) AS DOUBLE)")})
    SELECT latitude, longitude, value / (SELECT max(value) FROM p) AS weight FROM p""")
def _(spark, sf):
    return G.heat_weights(S.heat_points(view(spark, sf, "tx"), BOX, "TRANSACTION_COUNT"))


@query("log_ratio", ["cities"], """
    SELECT insee_code, round((log10(CAST(population AS DOUBLE)) - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6)
      AS ratio
    FROM cities, (SELECT log10(CAST(min(population) AS DOUBLE)) AS lo, log10(CAST(max(population) AS DOUBLE)) AS hi
      FROM cities) AS b""")
def _(spark, sf):
    return plain(G.log_ratio(view(spark, sf, "cities")).select("insee_code", "ratio"), "ratio")


@query("feature_centers", ["boxes", "city_class"], """
    SELECT b.code, b.name, round((b.y0 + b.y1) / 2, 6) AS latitude, round((b.x0 + b.x1) / 2, 6) AS longitude,
      c.value, c.ratio
    FROM boxes b JOIN city_class c ON c.code = b.code WHERE b.level = 'CITY' AND c.ratio IS NOT NULL""")
def _(spark, sf):
    centers = G.feature_centers(view(spark, sf, "city_boundaries"), city_metric(spark, sf))
    return plain(centers, "latitude", "longitude")


@query("ring_centroids", ["boxes"], """
    SELECT code, part, round((y0 + y1) / 2, 6) AS latitude, round((x0 + x1) / 2, 6) AS longitude FROM boxes""")
def _(spark, sf):
    return plain(G.ring_centroids(view(spark, sf, "all_boundaries")), "latitude", "longitude")


@query("outline_points", ["boxes", "city_class"], """
    WITH r AS (SELECT b.code, b.part, [y0, y0, y1, y1, y0] AS ys, [x0, x1, x1, x0, x0] AS xs, c.ratio AS weight,
        greatest(1, CAST(floor(c.ratio * 24 + 0.5) AS INT)) AS n
      FROM boxes b JOIN city_class c ON c.code = b.code WHERE b.level = 'CITY' AND c.ratio IS NOT NULL),
    i AS (SELECT *, unnest(range(n)) AS position FROM r),
    k AS (SELECT *, least(4, CAST(floor(position * (CAST(5 AS DOUBLE) / n)) AS INT)) + 1 AS v FROM i)
    SELECT code, part, CAST(position AS INT) AS position, round(ys[v], 6) AS latitude, round(xs[v], 6) AS longitude,
      weight FROM k
    UNION ALL SELECT code, part, -1, round((ys[1] + ys[3]) / 2, 6), round((xs[1] + xs[2]) / 2, 6), weight FROM r""")
def _(spark, sf):
    points = G.outline_points(view(spark, sf, "city_boundaries"), city_metric(spark, sf))
    return plain(points, "latitude", "longitude")
