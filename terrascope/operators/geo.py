"""Boundaries, map metrics and point location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.metrics import density, gdp_per_capita
from .sales import given

CLASSES = 7
OUTLINE_SAMPLES = 24
TILE_DEGREES = 1.0
MAP_METRICS = (
    "population", "density", "gdp_per_capita", "average_price", "average_price_per_sqm", "transaction_count",
)


# --- boundaries -----------------------------------------------------------------------------------------------


def boundaries(b: DataFrame, level: str, code: str | None = None) -> DataFrame:
    rows = b.filter(F.col("geographic_level") == level)
    return rows.filter(F.col("geographic_code") == code) if given(code) else rows


def dept_boundaries_of_region(b: DataFrame, departments: DataFrame, region: str) -> DataFrame:
    wanted = departments.filter(F.col("region_code") == region).select(F.col("code").alias("geographic_code"))
    return boundaries(b, "DEPARTMENT").join(wanted, "geographic_code", "left_semi").select(b.columns)


def to_features(b: DataFrame) -> DataFrame:
    """One GeoJSON feature per boundary; a blank geometry is null, an invalid one is an error."""
    properties = F.struct(
        F.col("geographic_code").alias("code"), F.col("name"), F.col("geographic_level").alias("level")
    )
    geometry = F.parse_json(F.when(F.trim("geometry") != "", F.col("geometry")))
    feature = F.to_json(
        F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")),
        {"ignoreNullFields": "false"},
    )
    return b.select("geographic_code", feature.alias("feature"))


def parse_geometry(b: DataFrame) -> DataFrame:
    """Adds `parts`, the nested coordinates; polygons and multi-polygons look the same."""
    return b.withColumn("parts", G.parse_geometry_column(F.col("geometry")))


def area_km2(b: DataFrame) -> DataFrame:
    return parse_geometry(b).select("geographic_code", G.geometry_area_km2(F.col("parts")).alias("area_km2"))


BOX_COLUMNS = ("min_x", "min_y", "max_x", "max_y")


def feature_bbox(b: DataFrame) -> DataFrame:
    """Adds the bounding box; a table that was stored with its boxes is taken as it is, and nothing is parsed."""
    if set(BOX_COLUMNS) <= set(b.columns):
        return b
    return (
        parse_geometry(b)
        .select(*b.columns, G.bbox(F.col("parts")).alias("_box"))
        .select(*b.columns, "_box.*")
    )


def features_in_view(b: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Features whose bounding box meets the viewport, by code."""
    meets = (
        (F.col("min_x") <= east) & (F.col("max_x") >= west) & (F.col("min_y") <= north) & (F.col("max_y") >= south)
    )
    return feature_bbox(b).filter(meets).orderBy("geographic_code")


def swap_layer(parents: DataFrame, children: DataFrame, parent_codes: DataFrame, key: str = "code") -> DataFrame:
    """Drop the features that finer ones replace, then add the finer ones; features without code stay."""
    kept = parents.join(parent_codes.select(key).distinct(), key, "left_anti").select(parents.columns)
    return kept.unionByName(children, allowMissingColumns=True)


# --- points in polygons ---------------------------------------------------------------------------------------


def _tiles(low: str, high: str, size: float) -> Column:
    """Tiles from `low` up to but not including `high`: no point on the upper border of a box is inside it."""
    first = F.floor(F.col(low) / F.lit(size)).cast("int")
    last = (F.ceil(F.col(high) / F.lit(size)) - 1).cast("int")
    return F.explode(F.sequence(first, F.greatest(first, last)))


#: how often a tile may be quartered, the points that a tile may have, and its box tests (points x rings)
DEPTH, CROWD, TESTS = 6, 50_000, 1 << 19


def leaf_tiles(located: DataFrame, ring_tiles: DataFrame, crowd: int = CROWD, tests: int = TESTS) -> DataFrame:
    """The quadtree of map tiles that hold points and rings: one row per occupied finest tile (`_fx`, `_fy`) with its
    leaf (`_level`, `_lx`, `_ly`), its base tile (`_tx`, `_ty`), and `_shares`, how many ways the leaf's points are dealt.

    A tile is quartered while it has too many points, or too many points for its rings; a leaf that is too full at the
    finest level, as when all points stand in one place, is dealt in shares. The tree is made from counts alone: points
    by finest tile, at most 4^DEPTH a base tile, and rings by base tile.
    """
    half = [F.shiftright(c, DEPTH).alias(n) for c, n in (("_fx", "_tx"), ("_fy", "_ty"))]
    counts = located.groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("_n")).select("_fx", "_fy", "_n", *half)
    rings = ring_tiles.groupBy("_tx", "_ty").agg(F.count(F.lit(1)).alias("_rings"))
    counts = counts.join(rings, ["_tx", "_ty"])

    def inside(level: int) -> Column:
        up = DEPTH - level
        tile = W.partitionBy("_tx", "_ty", F.shiftright("_fx", up), F.shiftright("_fy", up))
        return F.sum("_n").over(tile)

    level = F.lit(DEPTH)
    for k in range(DEPTH - 1, -1, -1):
        n = inside(k)
        fits = (n <= crowd) & (n * F.greatest(F.shiftright("_rings", 2 * k), F.lit(1)) <= tests)
        level = F.when(fits, k).otherwise(level)
    leaves = counts.withColumn("_level", level).withColumns({
        "_lx": F.expr(f"shiftright(_fx, {DEPTH} - _level)"), "_ly": F.expr(f"shiftright(_fy, {DEPTH} - _level)")})
    full = F.sum("_n").over(W.partitionBy("_tx", "_ty", "_level", "_lx", "_ly"))
    return leaves.withColumn("_shares", F.ceil(full / F.lit(crowd)).cast("int")).drop("_n", "_rings")


def place_points(located: DataFrame, leaves: DataFrame) -> DataFrame:
    """The points with their leaf and their share of it. Tiles that were not quartered are not looked up."""
    split = leaves.filter("_level > 0 OR _shares > 1").select("_fx", "_fy", "_level", "_shares")
    return located.join(split, ["_fx", "_fy"], "left").withColumn("_level", F.coalesce("_level", F.lit(0))).select(
        "id", "latitude", "longitude", "_level", F.expr(f"shiftright(_fx, {DEPTH} - _level)").alias("_lx"),
        F.expr(f"shiftright(_fy, {DEPTH} - _level)").alias("_ly"),
        F.pmod(F.xxhash64("id"), F.coalesce("_shares", F.lit(1))).cast("int").alias("_share"))


def locate_points(points: DataFrame, tile: float) -> DataFrame:
    fine = F.lit(tile / (1 << DEPTH))
    return points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "id", "latitude", "longitude", F.floor(F.col("longitude") / fine).cast("int").alias("_fx"),
        F.floor(F.col("latitude") / fine).cast("int").alias("_fy"))


def tag_points(
    points: DataFrame, b: DataFrame, position: str | None = None, tile: float = TILE_DEGREES, crowd: int = CROWD,
    tests: int = TESTS,
) -> DataFrame:
    """(id, code): the first feature whose outer ring holds the point; points outside are left out.

    First means the lowest number in the column `position`, unique per feature, or else the lowest code, of any length.

    Every ring is listed in the leaves of a quadtree of map tiles (`leaf_tiles`) that its box touches and that hold
    points, with only the edges that a point of that leaf can cross: those that meet its band of latitudes and do not end
    west of it. A leaf that no edge touches is inside the ring as a whole, and its points need no test, or outside, and
    the pair is dropped. A point lies in one leaf, so candidates meet in an equi-join, and no leaf's share has more
    points than the tree allows. The box test comes before the even-odd test; holes are ignored. Point ids must be unique.
    """
    rank = F.col(position).cast("bigint") if position else F.col("geographic_code")
    ring_tiles = (
        parse_geometry(b)
        .filter(F.col("geographic_code") != "")
        .select(rank.alias("_rank"), F.explode("parts").alias("_part"))
        .select("_rank", G.outer_ring(F.col("_part")).alias("_ring"))
        .select("_rank", "_ring", G.bbox(F.array(F.array("_ring"))).alias("_box"))
        .select("_rank", "_ring", "_box.*")
        .filter(F.col("min_x").isNotNull())
        .withColumn("_tx", _tiles("min_x", "max_x", tile))
        .withColumn("_ty", _tiles("min_y", "max_y", tile))
    )
    located = locate_points(points, tile)
    leaves = leaf_tiles(located, ring_tiles, crowd, tests)
    size = F.lit(tile) / F.pow(F.lit(2.0), F.col("_level"))
    west, south = F.col("_lx") * F.col("_size"), F.col("_ly") * F.col("_size")
    meets = ((F.col("min_x") <= west + F.col("_size")) & (F.col("max_x") >= west)
             & (F.col("min_y") <= south + F.col("_size")) & (F.col("max_y") >= south))
    edges = G.edges_of_tile(G.ring_edges(F.col("_ring")), west, south, F.col("_size"))
    middle = G.inside_edges(west + F.col("_size") / 2, south + F.col("_size") / 2, F.col("_edges"))
    occupied = leaves.select("_tx", "_ty", "_level", "_lx", "_ly", "_shares").distinct()
    rings = (
        ring_tiles.join(occupied, ["_tx", "_ty"]).withColumn("_size", size).filter(meets)
        .withColumn("_edges", edges).withColumn("_touched", G.ring_touches(F.col("_ring"), west, south, F.col("_size")))
        .withColumn("_whole", ~F.col("_touched") & middle).filter(F.col("_touched") | F.col("_whole"))
        .select("_rank", "min_x", "min_y", "max_x", "max_y", "_whole", F.when(F.col("_touched"), F.col("_edges")).alias("_edges"),
                "_level", "_lx", "_ly", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
    )
    in_box = F.col("longitude").between(F.col("min_x"), F.col("max_x")) & F.col("latitude").between(
        F.col("min_y"), F.col("max_y")
    )
    hits = place_points(located, leaves).join(rings, ["_level", "_lx", "_ly", "_share"]).filter(
        F.col("_whole") | (in_box & G.inside_edges(F.col("longitude"), F.col("latitude"), F.col("_edges")))
    )
    first = hits.groupBy("id").agg(F.min("_rank").alias("_rank"))
    if not position:
        return first.select("id", F.col("_rank").alias("code"))
    names = b.select(F.col(position).cast("bigint").alias("_rank"), F.col("geographic_code").alias("code"))
    return first.join(names, "_rank").select("id", "code")


# --- map metrics ----------------------------------------------------------------------------------------------


def metric_by_code(features: DataFrame, stats: DataFrame, metric: str, area_unit: str = "ha") -> DataFrame:
    """(code, value): the statistics row decides when there is one, even by NULL; otherwise the feature's own
    population and area serve the two metrics they can."""
    if metric not in MAP_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    own = features.filter(F.col("code").isNotNull() & (F.col("code") != "")).select("code", "population", "area")
    known = stats.select(F.col("code").alias("_code"), F.struct(*stats.columns).alias("_s"))
    from_stats = {
        "population": F.col("_s.population"),
        "density": density(F.col("_s.population"), F.col("_s.area")),
        "gdp_per_capita": F.lit(None),
        "average_price": F.col("_s.average_price"),
        "average_price_per_sqm": F.col("_s.average_price_per_sqm"),
        "transaction_count": F.col("_s.transaction_count"),
    }[metric].cast("double")
    from_feature = {
        "population": F.col("population"), "density": density(F.col("population"), F.col("area"), area_unit),
    }.get(metric, F.lit(None)).cast("double")
    value = F.when(F.col("_code").isNotNull(), from_stats).otherwise(from_feature)
    return own.join(known, F.col("code") == F.col("_code"), "left").select("code", value.alias("value"))


def country_metric(countries: DataFrame, metric: str) -> DataFrame:
    """(code, value) of countries; sale figures are unknown there."""
    if metric not in MAP_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    value = {
        "population": F.col("population"),
        "density": density(F.col("population"), F.col("area")),
        "gdp_per_capita": gdp_per_capita(F.col("gdp"), F.col("population")),
    }.get(metric, F.lit(None))
    return countries.filter(F.col("code").isNotNull()).select("code", value.cast("double").alias("value"))


def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def _bounds(rows: DataFrame, value: Column) -> Column:
    """Smallest and largest usable value as a one-row scalar sub-query."""
    ends = rows.filter(_usable(value)).agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("b"))
    return ends.scalar()


def metric_ratio(metric_df: DataFrame) -> DataFrame:
    """Adds `ratio`, the position in the range of usable values; NULL when there is no range."""
    value = F.col("value").cast("double")
    ends = metric_df.withColumn("_b", _bounds(metric_df, value))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    ratio = F.when(_usable(value) & (lo < hi), (value - lo) / (hi - lo))
    return ends.withColumn("ratio", ratio).drop("_b")


def choropleth_classes(metric_df: DataFrame, n: int = CLASSES) -> DataFrame:
    """Equal-width class 0..n-1 of every usable value."""
    highest = F.least(F.lit(n - 1).cast("bigint"), F.floor(F.col("ratio") * n)).cast("int")
    # least() passes over NULL
    return metric_ratio(metric_df).withColumn("class", F.when(F.col("ratio").isNotNull(), highest))


def heat_weights(points: DataFrame) -> DataFrame:
    """Value over the largest value; nothing when no value is positive."""
    top = points.agg(F.max("value").alias("m")).scalar()
    weighed = points.withColumn("_max", top).filter(F.col("_max") > 0)
    return weighed.withColumn("weight", F.col("value") / F.col("_max")).select("latitude", "longitude", "weight")


def log_ratio(places: DataFrame, value: str = "population") -> DataFrame:
    """Position of log10(value) in its range, for positive values."""
    size = F.col(value).cast("double")
    ends = places.withColumn("_b", _bounds(places, size))
    lo, hi = F.log10(F.col("_b.lo")), F.log10(F.col("_b.hi"))
    spread = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return ends.withColumn("ratio", F.when(size > 0, (F.log10(size) - lo) / spread)).drop("_b")


def _with_ratio(b: DataFrame, metric_df: DataFrame) -> DataFrame:
    ratios = metric_ratio(metric_df).filter(F.col("ratio").isNotNull()).select(
        F.col("code").alias("geographic_code"), "value", "ratio"
    )
    return b.join(ratios, "geographic_code")


def feature_centers(b: DataFrame, metric_df: DataFrame) -> DataFrame:
    """Centre of each feature's box, with its value and ratio."""
    boxes = feature_bbox(_with_ratio(b, metric_df))
    return boxes.select(
        F.col("geographic_code").alias("code"), "name",
        ((F.col("min_y") + F.col("max_y")) / 2).alias("latitude"),
        ((F.col("min_x") + F.col("max_x")) / 2).alias("longitude"),
        "value", "ratio",
    )


def outer_rings(b: DataFrame) -> DataFrame:
    """One row per polygon part with its outer ring of at least three vertices."""
    rest = [c for c in b.columns if c != "geometry"]
    return (
        parse_geometry(b)
        .select(*rest, F.posexplode("parts").alias("part", "_part"))
        .select(*rest, "part", G.outer_ring(F.col("_part")).alias("ring"))
        .filter(F.size("ring") >= 3)
    )


def ring_centroids(b: DataFrame) -> DataFrame:
    """Mean vertex of every outer ring, the closing vertex left out."""
    rings = outer_rings(b).withColumn("_c", G.ring_centroid(F.col("ring")))
    return rings.select(F.col("geographic_code").alias("code"), "part", "_c.latitude", "_c.longitude")


def outline_points(b: DataFrame, metric_df: DataFrame, samples: int = OUTLINE_SAMPLES) -> DataFrame:
    """Evenly spaced vertices of each outer ring, the more the higher the ratio, plus the ring centroid."""
    rings = outer_rings(_with_ratio(b, metric_df)).select(
        F.col("geographic_code").alias("code"), "part", "ring",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ratio"))).alias("weight"),
    )
    count = F.greatest(F.lit(1), F.floor(F.col("weight") * samples + 0.5).cast("int"))
    step = F.size("ring").cast("double") / count.cast("double")

    def sample(i: Column) -> Column:
        at = F.least(F.size("ring") - 1, F.floor(i.cast("double") * step).cast("int"))
        vertex = F.get(F.col("ring"), at)
        return F.struct(
            i.alias("position"), F.get(vertex, F.lit(1)).alias("latitude"), F.get(vertex, F.lit(0)).alias("longitude")
        )

    outline = F.transform(F.sequence(F.lit(0), count - 1), sample)
    centre = G.ring_centroid(F.col("ring"))
    anchor = F.array(
        F.struct(
            F.lit(-1).alias("position"), centre["latitude"].alias("latitude"), centre["longitude"].alias("longitude")
        )
    )
    return rings.select("code", "part", F.inline(F.concat(outline, anchor)), "weight")
