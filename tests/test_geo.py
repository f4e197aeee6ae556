import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terrascope.operators import geo as G
from terrascope.sources import union_layers


def square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def layer(spark, geometries):
    rows = [("CITY", code, f"n{code}", g if g is None or isinstance(g, str) else json.dumps(g)) for code, g in geometries.items()]
    return spark.createDataFrame(rows, "geographic_level STRING, geographic_code STRING, name STRING, geometry STRING")


def polygon(*rings):
    return {"type": "Polygon", "coordinates": list(rings)}


def multi(*parts):
    return {"type": "MultiPolygon", "coordinates": list(parts)}


def test_area(spark):
    b = layer(spark, {
        "degree": polygon(square(0, 0, 1, 1)), "hole": polygon(square(0, 0, 1, 1), square(0, 0, 1, 1)),
        "big_hole": polygon(square(0, 0, 1, 1), square(0, 0, 2, 2)), "two": multi([square(0, 0, 1, 1)], [square(5, 0, 6, 1)]),
        "open": polygon(square(0, 0, 1, 1)[:-1]), "line": polygon([[0, 0], [1, 1]]),
        "point": {"type": "Point", "coordinates": [1, 2]}, "reverse": polygon(square(0, 0, 1, 1)[::-1])})
    area = {r["geographic_code"]: r["area_km2"] for r in G.area_km2(b).collect()}
    assert area["degree"] == pytest.approx(12363.7, abs=0.1)
    assert area["hole"] == area["big_hole"] == area["line"] == area["point"] == 0.0
    assert area["two"] == pytest.approx(2 * area["degree"])
    assert area["open"] == pytest.approx(area["degree"]) and area["reverse"] == pytest.approx(area["degree"])


def tags(spark, b, points, **kw):
    df = spark.createDataFrame([(i, float(y), float(x)) for i, (x, y) in enumerate(points)],
                               "id BIGINT, latitude DOUBLE, longitude DOUBLE")
    got = {r["id"]: r["code"] for r in G.tag_points(df, b, **kw).collect()}
    return [got.get(i) for i in range(len(points))]


def in_ring(x, y, ring):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[-1:] + ring[:-1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def test_points_on_borders_are_half_open(spark):
    b = layer(spark, {"a": polygon(square(0, 0, 1, 1)), "b": polygon(square(1, 0, 2, 1))})
    assert tags(spark, b, [(0, 0.5), (1, 0.5), (2, 0.5), (0.5, 0), (0.5, 1), (0.5, 0.5)]) == [
        "a", "b", None, "a", None, "a"]


def test_first_feature_wins_and_holes_are_ignored(spark):
    b = layer(spark, {"z": polygon(square(0, 0, 2, 2), square(0.5, 0.5, 1.5, 1.5)), "m": polygon(square(1, 1, 3, 3))})
    assert tags(spark, b, [(1.2, 1.2), (0.7, 0.7), (2.5, 2.5), (9, 9)]) == ["m", "z", "m", None]
    ordered = b.withColumn("position", F.when(F.col("geographic_code") == "z", 0).otherwise(1))
    assert tags(spark, ordered, [(1.2, 1.2)], position="position") == ["z"]


def test_tagging_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rings = {}
    for k in range(12):
        cx, cy = rng.uniform(-3, 3), rng.uniform(-3, 3)
        rings[f"f{k:02d}"] = [[cx + rng.uniform(-2, 2), cy + rng.uniform(-2, 2)] for _ in range(rng.randrange(3, 9))]
    b = layer(spark, {c: polygon(r + r[:1]) for c, r in rings.items()})
    points = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(400)]
    expected = [next((c for c in sorted(rings) if in_ring(x, y, rings[c] + rings[c][:1])), None) for x, y in points]
    for tile in (0.3, 1.0, 50.0):
        assert tags(spark, b, points, tile=tile) == expected


def test_long_codes_a_wide_ring_and_a_crowded_tile(spark):
    country = "ÎLE-DE-FRANCE-12"
    b = layer(spark, {country: polygon(square(-30, 30, 30, 60)), "a-code-of-16-char": polygon(square(1, 41, 1.5, 41.5))})
    crowd = [(1.0 + i % 90 / 100, 41.0 + i // 90 / 100) for i in range(1800)]
    expected = ["a-code-of-16-char" if 1 <= x < 1.5 and 41 <= y < 41.5 else country for x, y in crowd]
    for tile in (0.5, 1.0, 7.0):
        assert tags(spark, b, crowd + [(-29.5, 59.5), (31, 40)], tile=tile) == ["ÎLE-DE-FRANCE-12" if e == country else min(e, country) for e in expected] + [country, None]


def test_stored_boxes_are_not_computed_again(spark):
    b = G.feature_bbox(layer(spark, {"b": polygon(square(1, 1, 2, 2)), "far": polygon(square(8, 8, 9, 9))}))
    stored = b.withColumn("geometry", F.lit("not even JSON"))
    assert [r["geographic_code"] for r in G.features_in_view(stored, 1, 1, 3, 3).collect()] == ["b"]


def test_multipolygon_and_other_types(spark):
    b = layer(spark, {"m": multi([square(0, 0, 1, 1)], [square(5, 5, 6, 6)]), "p": {"type": "Point", "coordinates": [5, 5]}})
    assert tags(spark, b, [(5.5, 5.5), (0.5, 0.5), (3, 3)]) == ["m", "m", None]


def test_views_touching_a_box(spark):
    b = layer(spark, {"b": polygon(square(1, 1, 2, 2)), "a": polygon(square(0, 0, 1, 1)), "far": polygon(square(8, 8, 9, 9))})
    assert [r["geographic_code"] for r in G.features_in_view(b, 1, 1, 3, 3).collect()] == ["a", "b"]


def metric(spark, values):
    return spark.createDataFrame([(k, v) for k, v in values.items()], "code STRING, value DOUBLE")


def test_classes(spark):
    df = metric(spark, {"lo": 1.0, "mid": 4.5, "hi": 8.0, "zero": 0.0, "neg": -4.0, "none": None, "inf": float("inf"),
                        "nan": float("nan")})
    rows = {r["code"]: (r["ratio"], r["class"]) for r in G.choropleth_classes(df).collect()}
    assert rows["lo"] == (0.0, 0) and rows["mid"] == (0.5, 3) and rows["hi"] == (1.0, 6)
    assert {rows[k] for k in ("zero", "neg", "none", "inf", "nan")} == {(None, None)}
    flat = G.choropleth_classes(metric(spark, {"a": 2.0, "b": 2.0})).collect()
    assert {r["class"] for r in flat} == {None}


def test_metric_prefers_statistics_even_when_null(spark):
    features = spark.createDataFrame([("a", 100, 200.0), ("b", 100, 200.0), ("", 1, 1.0)], "code STRING, population BIGINT, area DOUBLE")
    stats = spark.createDataFrame([("a", None, None, None, None, 0)],
                                  "code STRING, population BIGINT, area DOUBLE, average_price DOUBLE, "
                                  "average_price_per_sqm DOUBLE, transaction_count BIGINT")
    def got(name):
        return {r["code"]: r["value"] for r in G.metric_by_code(features, stats, name).collect()}
    assert got("population") == {"a": None, "b": 100.0}
    assert got("density") == {"a": None, "b": 50.0}
    assert got("average_price") == {"a": None, "b": None}
    assert got("transaction_count") == {"a": 0.0, "b": None}


def test_heat_weights_and_log_ratio(spark):
    points = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 3.0, 10.0)], "latitude DOUBLE, longitude DOUBLE, value DOUBLE")
    assert sorted(r["weight"] for r in G.heat_weights(points).collect()) == [0.5, 1.0]
    assert G.heat_weights(points.withColumn("value", F.lit(0.0))).count() == 0
    places = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), ("d", None)], "code STRING, population BIGINT")
    assert {r["code"]: r["ratio"] for r in G.log_ratio(places).collect()} == {"a": 0.0, "b": 1.0, "c": None, "d": None}


def test_outline_and_centers(spark):
    b = layer(spark, {"lo": polygon(square(0, 0, 1, 1)), "hi": polygon(square(2, 2, 4, 4)), "none": polygon(square(0, 0, 1, 1))})
    df = metric(spark, {"lo": 1.0, "hi": 3.0, "none": None})
    points = G.outline_points(b, df).collect()
    assert len([p for p in points if p["code"] == "lo"]) == 2
    assert len([p for p in points if p["code"] == "hi"]) == 25
    assert {(p["latitude"], p["longitude"]) for p in points if p["code"] == "hi" and p["position"] == -1} == {(3.0, 3.0)}
    centers = {r["code"]: (r["latitude"], r["longitude"], r["ratio"]) for r in G.feature_centers(b, df).collect()}
    assert centers == {"lo": (0.5, 0.5, 0.0), "hi": (3.0, 3.0, 1.0)}


def test_swap_layer_keeps_features_without_code(spark):
    parents = spark.createDataFrame([("FRA", "p"), ("DEU", "p"), (None, "p")], "code STRING, layer STRING")
    children = spark.createDataFrame([("11", "c", 5)], "code STRING, layer STRING, population INT")
    codes = spark.createDataFrame([("FRA",), ("FRA",)], "code STRING")
    rows = G.swap_layer(parents, children, codes).collect()
    assert {(r["code"], r["population"]) for r in rows} == {("DEU", None), (None, None), ("11", 5)}
    assert union_layers(parents, children).count() == 4


def test_features(spark):
    b = layer(spark, {"a": polygon(square(0, 0, 1, 1)), "blank": " ", "none": None})
    rows = {r["geographic_code"]: json.loads(r["feature"]) for r in G.to_features(b).collect()}
    assert rows["a"]["geometry"] == polygon(square(0, 0, 1, 1))
    assert rows["a"]["properties"] == {"code": "a", "name": "na", "level": "CITY"}
    assert rows["blank"]["geometry"] is None and rows["none"]["geometry"] is None
    with pytest.raises(Exception):
        G.to_features(layer(spark, {"bad": "{oops"})).collect()


def crowd_of_points(n, seed):
    rng = random.Random(seed)
    points = [(2.3 + rng.random() / 50, 48.8 + rng.random() / 50) for _ in range(int(n * 0.6))]
    points += [(2.35, 48.85)] * int(n * 0.3)
    return points + [(rng.uniform(-4, 8), rng.uniform(42, 51)) for _ in range(n - len(points))]


def test_a_crowded_tile_is_split_and_dealt(spark):
    rng = random.Random(5)
    country = [[2 + 5 * math.cos(a) * rng.uniform(0.8, 1), 46.5 + 4 * math.sin(a)] for a in [i * math.pi / 60 for i in range(120)]]
    shapes = {"z-country": country}
    for k in range(60):  # small many-sided shapes in and around the crowd
        cx, cy, r = 2.3 + rng.random() / 50, 48.8 + rng.random() / 50, rng.uniform(0.0005, 0.004)
        shapes[f"a{k:02d}"] = [[cx + r * math.cos(a), cy + r * math.sin(a)] for a in [i * math.pi / 8 for i in range(16)]]
    shapes["flat"] = square(2.0, 48.0, 2.6, 48.81)  # a level edge through the crowd
    b = layer(spark, {k: polygon([*ring, ring[0]]) for k, ring in shapes.items()})
    points = crowd_of_points(3000, 6)
    expected = [min((k for k, ring in shapes.items() if in_ring(x, y, ring)), default=None) for x, y in points]
    for crowd, tests in ((100, 1 << 40), (10 ** 9, 5000), (10 ** 9, 1 << 60), (1, 1)):
        assert tags(spark, b, points, crowd=crowd, tests=tests) == expected
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)], "id BIGINT, latitude DOUBLE, longitude DOUBLE")
    located = G.locate_points(df, 1.0)
    tiles = spark.range(-10, 10).select(F.col("id").cast("int").alias("_tx")).join(
        spark.range(40, 55).select(F.col("id").cast("int").alias("_ty")))
    placed = G.place_points(located, G.leaf_tiles(located, tiles, crowd=100))
    sizes = [r["count"] for r in placed.groupBy("_level", "_lx", "_ly", "_share").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 150  # nine tenths of all points stand in one base tile
