"""Geometry as columns: shoelace, ray test, segment distance, affine grids, transverse Mercator."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and the metric zone of the sites (transverse Mercator, zone 37 south).
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
MERIDIAN, SCALE, FALSE_EAST, FALSE_NORTH = 39.0, 0.9996, 500_000.0, 10_000_000.0


def _series() -> tuple[float, list[float], list[float], list[float]]:
    """Rectifying radius and the coefficients of the Krueger series (forward, inverse, latitude) in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, forward, inverse, latitude


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: inside lambdas an expression that is named twice is computed twice, a lambda's argument is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _conformal(lat: Column) -> Column:
    n = FLATTENING / (2 - FLATTENING)
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    return F.sinh(F.atanh(s) - e * F.atanh(e * s))


def _sphere(t: Column, dl: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))


def _plane(xi: Column, eta: Column) -> tuple[Column, Column]:
    radius, forward, _, _ = _series()
    east, north = eta, xi
    for k, a in enumerate(forward, 1):
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return FALSE_EAST + SCALE * radius * east, FALSE_NORTH + SCALE * radius * north


def to_metric(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to metres east and north."""
    return _plane(*_sphere(_conformal(lat), F.radians(lon - MERIDIAN)))


def metric_point(p: Column) -> Column:
    """A point (x, y) in degrees as one in metres, for use inside lambdas."""
    pair = lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y"))
    sphere = once(_conformal(p["y"]), lambda t: pair(_sphere(t, F.radians(p["x"] - MERIDIAN))))
    return once(sphere, lambda c: pair(_plane(c["x"], c["y"])))


def to_degrees(east: Column, north: Column) -> tuple[Column, Column]:
    """Metres to longitude and latitude."""
    radius, _, inverse, latitude = _series()
    xi, eta = (north - FALSE_NORTH) / (SCALE * radius), (east - FALSE_EAST) / (SCALE * radius)
    x, y = xi, eta
    for k, b in enumerate(inverse, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, d in enumerate(latitude, 1):
        lat = lat + d * F.sin(2 * k * chi)
    return MERIDIAN + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def pixel_of(x: Column, y: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """row and col (floor) of a point under x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    if abs(det) < 1e-12:
        raise ValueError("the affine transform cannot be inverted")
    col = (e * (x - c) - b * (y - f)) / det
    row = (a * (y - f) - d * (x - c)) / det
    return F.floor(row).cast("int"), F.floor(col).cast("int")


def _corners(ring: Column) -> Column:
    """Each corner of a ring with the next one, whether or not the ring repeats its first corner."""
    after = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    ends = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    return once(ring, lambda r: F.zip_with(r, after(r), ends))


def _local(ring: Column) -> Column:
    """A ring with its first corner as origin: products of coordinates far from zero would lose the digits that areas need."""
    return F.transform(ring, lambda p: F.struct((p["x"] - F.get(ring, F.lit(0))["x"]).alias("x"), (p["y"] - F.get(ring, F.lit(0))["y"]).alias("y")))


def _signed_area(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def ring_area(ring: Column) -> Column:
    """Signed shoelace area."""
    return _signed_area(_corners(_local(ring)))


def _ring_centre(ring: Column) -> Column:
    """area (signed), x and y of a ring: its area centroid; a ring without area has the mean of its corners."""

    def along(k: str, edges: Column, area: Column) -> Column:
        moment = F.aggregate(edges, F.lit(0.0), lambda a, e: a + (e[f"{k}1"] + e[f"{k}2"]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
        mean = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(ring)
        return F.when(F.abs(area) < 1e-12, mean).otherwise(F.get(ring, F.lit(0))[k] + moment / F.when(F.abs(area) >= 1e-12, 6 * area))

    of = lambda edges, area: F.struct(area.alias("area"), along("x", edges, area).alias("x"), along("y", edges, area).alias("y"))
    return once(_corners(_local(ring)), lambda edges: once(_signed_area(edges), lambda area: of(edges, area)))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid; a ring without area has the mean of its corners."""
    centre = _ring_centre(ring)
    return centre["x"], centre["y"]


def _points(edges: Column) -> Column:
    """Corners and the middles of edges."""
    return F.concat(F.transform(edges, lambda e: F.struct(e["x1"].alias("x"), e["y1"].alias("y"))), F.transform(edges, lambda e: F.struct(((e["x1"] + e["x2"]) / 2).alias("x"), ((e["y1"] + e["y2"]) / 2).alias("y"))))


def _edges_within(edges: Column, other: Column) -> Column:
    def strictly(p: Column) -> Column:
        ends = lambda e: [p["x"], p["y"], *[e[c] for c in ("x1", "y1", "x2", "y2")]]
        crossings = F.aggregate(other, F.lit(0), lambda a, e: a + crosses_ray(*ends(e)).cast("int"))
        return (crossings % 2 == 1) & ~F.exists(other, lambda e: on_edge(*ends(e)))

    return F.exists(_points(edges), strictly)


def ring_within(ring: Column, other: Column) -> Column:
    """Whether some corner or middle of an edge of ``ring`` lies inside ``other`` and not on it: for rings that do not cross, whether it lies in it."""
    return once(_corners(other), lambda o: _edges_within(_corners(ring), o))


def ring_facts(rings: Column) -> Column:
    """area, x, y of each ring of a polygon or of several: the centroid, and the area, above zero for outlines and below for holes.

    How a ring turns does not matter: one that lies in an odd number of the others is a hole, so an island in a hole counts again.
    """

    def facts(edges: Column, ring: Column, i: Column) -> Column:
        depth = F.size(F.filter(edges, lambda o, j: (j != i) & _edges_within(F.get(edges, i), o)))
        sign = F.when((F.size(edges) > 1) & (depth % 2 == 1), -1.0).otherwise(1.0)
        return once(_ring_centre(ring), lambda c: F.struct((sign * F.abs(c["area"])).alias("area"), c["x"].alias("x"), c["y"].alias("y")))

    return once(F.transform(rings, _corners), lambda edges: F.transform(rings, lambda ring, i: facts(edges, ring, i)))


def facts_area(facts: Column) -> Column:
    return F.aggregate(facts, F.lit(0.0), lambda a, f: a + f["area"])


def facts_centroid(facts: Column) -> tuple[Column, Column]:
    """Centroid of all rings by ``ring_facts``; NULL without area."""
    area = facts_area(facts)
    along = lambda k: F.aggregate(facts, F.lit(0.0), lambda a, f: a + f["area"] * f[k]) / F.when(F.abs(area) >= 1e-12, area)
    return along("x"), along("y")


def rings_area(rings: Column) -> Column:
    """Area of all rings of a polygon or of several, holes taken off."""
    return facts_area(ring_facts(rings))


def rings_centroid(rings: Column) -> tuple[Column, Column]:
    """Centroid of all rings, holes taken off; without any area it is that of the rings as lines."""
    x, y = facts_centroid(ring_facts(rings))
    return tuple(F.coalesce(a, b) for a, b in zip((x, y), lines_centroid(rings), strict=True))


def lines_centre(lines: Column) -> Column:
    """x and y of the centroid of a line of any number of parts, segments weighed by length; without any length it is the mean of the corners."""
    pairs = lambda line: F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("a"), q.alias("b")))
    long = lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])

    def along(k: str, steps: Column, length: Column) -> Column:
        moment = F.aggregate(steps, F.lit(0.0), lambda a, s: a + long(s) * (s["a"][k] + s["b"][k]) / 2)
        mean = F.aggregate(F.flatten(lines), F.lit(0.0), lambda a, p: a + p[k]) / F.nullif(F.size(F.flatten(lines)), F.lit(0))
        return F.when(length > 0, moment / F.when(length > 0, length)).otherwise(mean)

    of = lambda steps, length: F.struct(along("x", steps, length).alias("x"), along("y", steps, length).alias("y"))
    length = lambda steps: F.aggregate(steps, F.lit(0.0), lambda a, s: a + long(s))
    return once(F.flatten(F.transform(lines, pairs)), lambda steps: once(length(steps), lambda n: of(steps, n)))


def lines_centroid(lines: Column) -> tuple[Column, Column]:
    """``lines_centre`` as two columns."""
    centre = lines_centre(lines)
    return centre["x"], centre["y"]


def line_centroid(line: Column) -> tuple[Column, Column]:
    """``lines_centroid`` of a line of one part."""
    return lines_centroid(F.array(line))


def crosses_ray(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether an edge crosses the ray from the point to the right: an odd number of crossings is inside."""
    spans = (y1 > py) != (y2 > py)
    return spans & (px < x1 + (py - y1) * (x2 - x1) / F.when(spans, y2 - y1))


def on_edge(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, eps: float = 1e-9) -> Column:
    return segment_distance_sq(px, py, x1, y1, x2, y2) <= eps * eps


def segment_distance_sq(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = F.when(length > 0, ((px - x1) * dx + (py - y1) * dy) / F.when(length > 0, length)).otherwise(0.0)
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def segments_meet(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) have a point in common; touching counts."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    apart = (F.greatest(ax, bx) < F.least(cx, dx)) | (F.greatest(cx, dx) < F.least(ax, bx)) | (F.greatest(ay, by) < F.least(cy, dy)) | (F.greatest(cy, dy) < F.least(ay, by))
    return ~apart & (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0)
