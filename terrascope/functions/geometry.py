"""GeoJSON geometry as nested arrays, and measures over it.

A geometry is always array<part>, a part is array<ring>, a ring is array<[lon, lat]>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
_RING = "array<array<double>>"


def parse_geometry_column(c: Column) -> Column:
    """Polygon and MultiPolygon text to nested arrays; other types have no parts."""
    kind = F.get_json_object(c, "$.type")
    coordinates = F.get_json_object(c, "$.coordinates")
    none = F.array().cast(f"array<array<{_RING}>>")
    return (
        F.when(kind == "Polygon", F.array(F.from_json(coordinates, f"array<{_RING}>")))
        .when(kind == "MultiPolygon", F.from_json(coordinates, f"array<array<{_RING}>>"))
        .otherwise(none)
    )


def outer_ring(part: Column) -> Column:
    return F.get(part, F.lit(0))


def _x(point: Column) -> Column:
    return F.get(point, F.lit(0))


def _y(point: Column) -> Column:
    return F.get(point, F.lit(1))


def ring_area_m2(ring: Column) -> Column:
    """Signed spherical area of one ring, its last vertex joined to the first."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return (F.radians(_x(b)) - F.radians(_x(a))) * (
            F.lit(2.0) + F.sin(F.radians(_y(a))) + F.sin(F.radians(_y(b)))
        )

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + edge(i))
    return F.when(n >= 3, total * F.lit(EARTH_RADIUS_M) * F.lit(EARTH_RADIUS_M) / F.lit(2.0)).otherwise(0.0)


def part_area_m2(part: Column) -> Column:
    """Outer ring minus holes, never negative."""
    signed = F.aggregate(
        F.transform(part, lambda ring, i: F.abs(ring_area_m2(ring)) * F.when(i == 0, 1.0).otherwise(-1.0)),
        F.lit(0.0),
        lambda acc, a: acc + a,
    )
    return F.greatest(signed, F.lit(0.0))


def geometry_area_km2(parts: Column) -> Column:
    total = F.aggregate(F.transform(parts, part_area_m2), F.lit(0.0), lambda acc, a: acc + a)
    return total / F.lit(1_000_000.0)


def bbox(parts: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) over every vertex."""
    points = F.flatten(F.flatten(parts))
    xs, ys = F.transform(points, _x), F.transform(points, _y)
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


def ring_centroid(ring: Column) -> Column:
    """Mean vertex of a ring, its last vertex left out: struct(latitude, longitude)."""
    n = F.size(ring) - 1
    open_ring = F.slice(ring, F.lit(1), F.greatest(n, F.lit(0)))

    def mean(coordinate) -> Column:
        total = F.aggregate(open_ring, F.lit(0.0), lambda acc, p: acc + coordinate(p))
        return F.when(n > 0, total / n.cast("double"))

    return F.struct(mean(_y).alias("latitude"), mean(_x).alias("longitude"))


def ring_edges(ring: Column) -> Column:
    """Edges from each vertex back to the one before it; level edges cannot be crossed and are dropped."""
    n = F.size(ring)

    def edge(point: Column, i: Column) -> Column:
        previous = F.get(ring, (i + n - 1) % n)
        return F.struct(
            _x(point).alias("xi"), _y(point).alias("yi"), _x(previous).alias("xj"), _y(previous).alias("yj")
        )

    return F.filter(F.transform(ring, edge), lambda e: e["yi"] != e["yj"])


def ring_touches(ring: Column, west: Column, south: Column, size: Column) -> Column:
    """Whether the box of any edge, level ones too, meets the tile. If none does, the tile is all inside or all outside."""
    n = F.size(ring)

    def touches(point: Column, i: Column) -> Column:
        other = F.get(ring, (i + n - 1) % n)
        return ((F.greatest(_x(point), _x(other)) >= west) & (F.least(_x(point), _x(other)) <= west + size)
                & (F.greatest(_y(point), _y(other)) >= south) & (F.least(_y(point), _y(other)) <= south + size))

    return F.exists(F.transform(ring, touches), lambda t: t)


def edges_of_tile(edges: Column, west: Column, south: Column, size: Column | float) -> Column:
    """The edges that can count for a point of a tile: those over its latitudes, unless they end west of it."""
    return F.filter(
        edges,
        lambda e: (F.greatest(e["yi"], e["yj"]) >= south) & (F.least(e["yi"], e["yj"]) <= south + size)
        & (F.greatest(e["xi"], e["xj"]) >= west),
    )


def inside_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """Even-odd rule; a point on a lower or left border is inside, on an upper or right one outside."""
    crossed = F.filter(
        edges,
        lambda e: ((e["yi"] > lat) != (e["yj"] > lat))
        & (lon < (e["xj"] - e["xi"]) * (lat - e["yi"]) / (e["yj"] - e["yi"]) + e["xi"]),
    )
    return F.size(crossed) % 2 == 1


#: the bits of every byte with a zero after each
_SPREAD = [sum(1 << 2 * k for k in range(8) if byte >> k & 1) for byte in range(256)]
_Z_BITS = 26


def _spread_bits(c: Column) -> Column:
    """The bits of a number below 2^32 with a zero after each, byte by byte from a table: doubling steps would name the
    number twice each, and so compute it 32 times."""
    table, whole = F.lit(_SPREAD), F.lit(0).cast("bigint")
    for k in range(4):
        byte = F.shiftright(c, 8 * k).bitwiseAND(F.lit(255)).cast("int")
        whole = whole.bitwiseOR(F.shiftleft(F.get(table, byte).cast("bigint"), 16 * k))
    return whole


def z_order(latitude: Column, longitude: Column) -> Column:
    """Position on a curve through all places that keeps neighbours together: bits of both degrees in turn, about half a
    metre fine. NULL without a place; degrees out of range count as the nearest in range."""
    def whole(c: Column, most: float) -> Column:
        kept = F.least(F.greatest(c, F.lit(-most)), F.lit(most))
        return F.floor((kept + F.lit(most)) / F.lit(2 * most) * F.lit(float((1 << _Z_BITS) - 1))).cast("bigint")

    there = latitude.isNotNull() & longitude.isNotNull() & ~F.isnan(latitude) & ~F.isnan(longitude)
    y, x = _spread_bits(whole(latitude, 90.0)), _spread_bits(whole(longitude, 180.0))
    return F.when(there, F.shiftleft(y, 1).bitwiseOR(x))
