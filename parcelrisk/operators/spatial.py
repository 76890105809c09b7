"""Spatial joins as equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions import geo
from parcelrisk.operators.graph import grid, neighbouring
from parcelrisk.operators.numbering import number_within, range_bucket
from parcelrisk.sources.scratch import settle


def nearest_each(nodes: DataFrame, infra: DataFrame, categories: list[str], cell: float | None = None) -> DataFrame:
    """site_id, node_id, category and d, the distance to the nearest feature of each category in the same site; no row where the site has none.

    All categories are one search, in rounds with cells of growing size, the first by the density of targets in their box: a hit no farther
    than the cell is final, since the nine cells around a point hold all that is so near. Targets are sent to the nine cells around them and
    points, which are many more, stay in their own. Only unresolved pairs of point and category go on; the last cell is as large as the
    sites, so all are resolved. Points are dealt out before they get a row for each category, as one task may read them all.
    """
    key = ["site_id", "node_id", "category"]
    targets = infra.filter(F.col("category").isin(*categories)).select("site_id", "category", F.col("x").alias("tx"), F.col("y").alias("ty"))
    box = nodes.select("x", "y", F.lit(0).alias("n")).union(targets.select("tx", "ty", F.lit(1))).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.sum("n")).first()  # one row
    wide, high, share = box[0] or 0.0, box[1] or 0.0, max((box[2] or 0) / len(categories), 1)
    extent = math.hypot(wide, high)
    size = cell or max(math.sqrt(wide * high / share), extent / share, extent * 1e-6, 1e-9)
    there = targets.select("site_id", "category").distinct()  # a row for each site and category: pairs without any target never start
    todo, found = nodes.select("site_id", "node_id", "x", "y").repartition("site_id", "node_id").join(F.broadcast(there), "site_id"), None
    distance = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    while True:
        last = size >= extent
        around = neighbouring(grid(targets, size, "tx", "ty")).drop("own")
        near = grid(todo, size).join(around.hint("merge"), ["site_id", "category", "cx", "cy"]).groupBy(*key).agg(F.min(distance).alias("d"))
        done = near if last else settle(near.filter(F.col("d") <= size))
        found = done if found is None else found.union(done)
        if last:
            return found.select(*key, "d")
        todo = settle(todo.join(done.select(*key).hint("merge"), key, "left_anti"))
        if not todo.limit(1).count():
            return found.select(*key, "d")
        size = min(size * 6, extent)


def nearest(nodes: DataFrame, infra: DataFrame, category: str, cell: float | None = None, out: str | None = None) -> DataFrame:
    """site_id, node_id and the distance to the nearest feature of a category in the same site; NULL if the site has none."""
    found = nearest_each(nodes, infra, [category], cell).select("site_id", "node_id", F.col("d").alias(out or f"dist_{category}_m"))
    return nodes.select("site_id", "node_id").join(found, ["site_id", "node_id"], "left")


def impute(df: DataFrame, column: str | list[str], missing: str = "accessible") -> DataFrame:
    """Missing distances take the site's largest; a site without any takes 0, or infinity with ``missing="deprived"``. Several columns take one pass."""
    if missing not in ("accessible", "deprived"):
        raise ValueError(f"unknown rule for missing categories: {missing}")
    names = [column] if isinstance(column, str) else column
    most = df.groupBy("site_id").agg(*[F.max(c).alias(f"__most_{c}") for c in names])
    filled = {c: F.coalesce(c, f"__most_{c}", F.lit(0.0 if missing == "accessible" else 1e9)) for c in names}
    return df.join(F.broadcast(most), "site_id").withColumns(filled).drop(*[f"__most_{c}" for c in names])  # a row for each site


def sample_pixels(points: DataFrame, pixels: DataFrame, value: str, affine: tuple[float, ...]) -> DataFrame:
    """Points with the value of the pixel they lie in; outside it is NULL."""
    row, col = geo.pixel_of(F.col("x"), F.col("y"), affine)
    return points.withColumn("row", row).withColumn("col", col).join(pixels.select("site_id", "row", "col", value), ["site_id", "row", "col"], "left")


def containing(points: DataFrame, edges: DataFrame, keys: list[str], of: list[str], cell: float = 50.0) -> DataFrame:
    """(keys, of) of every point in or on the boundary of a polygon, given as edges (of, x1, y1, x2, y2).

    An edge is met by points of its rows of cells that lie left of its right end, so each ray test sees all crossings; an odd number
    of crossings of one polygon is inside.
    """
    e = edges.withColumn("ylo", F.least("y1", "y2")).withColumn("yhi", F.greatest("y1", "y2")).withColumn("xhi", F.greatest("x1", "x2"))
    box = edges.groupBy(*of).agg(F.min(F.least("x1", "x2")).alias("zx0"), F.max(F.greatest("x1", "x2")).alias("zx1"))
    e = e.join(box.hint("merge"), of).withColumn("cy", F.explode(F.sequence(F.floor(F.col("ylo") / cell), F.floor(F.col("yhi") / cell))))
    e = e.withColumn("cx", F.explode(F.sequence(F.floor(F.col("zx0") / cell), F.floor(F.col("xhi") / cell))))
    p = grid(points.select(*keys, "x", "y"), cell)
    m = p.join(e, ["cx", "cy"]).filter((F.col("x") <= F.col("xhi")) & F.col("y").between(F.col("ylo"), F.col("yhi")))
    args = [F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]
    hit = m.groupBy(*keys, *of).agg((F.count_if(geo.crosses_ray(*args)) % 2 == 1).alias("odd"), F.bool_or(geo.on_edge(*args)).alias("edge"))
    return hit.filter("odd OR edge").select(*keys, *of)


def in_zone(points: DataFrame, edges: DataFrame, cell: float = 50.0) -> DataFrame:
    """Points with ``inside_zone``: within any polygon, or on its boundary. Polygons come as edges (zone_id, x1, y1, x2, y2). No zones: all false."""
    inside = containing(points, edges, ["site_id", "node_id"], ["zone_id"], cell).select("site_id", "node_id").distinct().withColumn("inside_zone", F.lit(True))
    return points.join(inside, ["site_id", "node_id"], "left").withColumn("inside_zone", F.coalesce("inside_zone", F.lit(False)))


def outline_edges(footprints: DataFrame) -> DataFrame:
    """site_id, node_id, ring, x1, y1, x2, y2, first (whether it is its ring's first) of the edges of ``rings``; rings need not repeat their first corner."""
    r = footprints.select("site_id", "node_id", F.posexplode("rings").alias("ring", "corners")).filter(F.size("corners") > 0)
    next_corner = lambda i: F.get("corners", (i + 1) % F.size("corners"))
    ends = F.transform("corners", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), next_corner(i)["x"].alias("x2"), next_corner(i)["y"].alias("y2"), (i == 0).alias("first")))
    return r.select("site_id", "node_id", "ring", F.explode(ends).alias("e")).select("site_id", "node_id", "ring", "e.*")


def _along(edges: DataFrame, cell: float) -> DataFrame:
    """Each edge in every cell it may pass: those of the boxes of its pieces of a cell's length, so a long one meets cells in proportion to its length."""
    n = F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / cell), F.lit(1))
    d = edges.withColumn("__n", n)
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("__n")
    slack = cell * 1e-6  # the ends of pieces are rounded

    def cells(a: str, b: str, k: Column) -> Column:
        p, q = at(a, b, k), at(a, b, k + 1)
        return F.sequence(F.floor((F.least(p, q) - slack) / cell), F.floor((F.greatest(p, q) + slack) / cell))

    met = lambda k: F.flatten(F.transform(cells("x1", "x2", k), lambda x: F.transform(cells("y1", "y2", k), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    passed = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), met)))
    return d.withColumn("c", F.explode(passed)).select(*edges.columns, "c.cx", "c.cy")


def footprints_in_zone(footprints: DataFrame, edges: DataFrame, cell: float = 50.0) -> DataFrame:
    """site_id, node_id and ``inside_zone``: whether a footprint (``rings``, in metres, of one or more parts, with holes) and any zone have a point in common.

    Zones come as edges (zone_id, x1, y1, x2, y2), several rings to a zone where it has parts or holes. Two areas meet if edges of both
    meet, which is tested in the grid cells that both pass, or if one lies in the other: then a corner of each ring of the one is in the
    other. Touching counts. Footprints without rings and tables without zones give false.
    """
    key = ["site_id", "node_id"]
    footprints = footprints.repartition(*key)  # a file may be read by one task; what is grouped by footprint stays where it is
    own = outline_edges(footprints)
    a = _along(own.select(*key, "x1", "y1", "x2", "y2"), cell)
    b = _along(edges.select("x1", "y1", "x2", "y2"), cell).select(*[F.col(c).alias(f"z{c}") for c in ("x1", "y1", "x2", "y2")], "cx", "cy")
    ends = lambda p: tuple(F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    met = a.join(b, ["cx", "cy"]).filter(geo.segments_meet(ends(""), ends("z"))).select(*key)
    corners = own.filter("first").select(*key, "ring", F.col("x1").alias("x"), F.col("y1").alias("y"))
    within = containing(corners, edges, [*key, "ring"], ["zone_id"], cell).select(*key)
    around = containing(edges.select("zone_id", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct(), own.select(*key, "x1", "y1", "x2", "y2"), ["zone_id", "x", "y"], key, cell).select(*key)
    hit = met.union(within).union(around).distinct().withColumn("inside_zone", F.lit(True))
    return footprints.select(*key).join(hit, key, "left").withColumn("inside_zone", F.coalesce("inside_zone", F.lit(False)))


def in_corridor(points: DataFrame, segments: DataFrame, buffer: float | None = None) -> DataFrame:
    """Points with ``in_corridor``: at most ``buffer`` from any line segment (x1, y1, x2, y2)."""
    b = S.RIVER_BUFFER_M if buffer is None else buffer
    cell = max(b, 1e-9)
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((F.least(lo, hi) - b) / cell), F.floor((F.greatest(lo, hi) + b) / cell)))
    s = segments.select("x1", "y1", "x2", "y2").withColumn("cx", spread(F.col("x1"), F.col("x2"))).withColumn("cy", spread(F.col("y1"), F.col("y2")))
    p = grid(points.select("site_id", "node_id", "x", "y"), cell)
    near = p.join(s, ["cx", "cy"]).filter(geo.segment_distance_sq(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]) <= b * b)
    hit = near.select("site_id", "node_id").distinct().withColumn("in_corridor", F.lit(True))
    return points.join(hit, ["site_id", "node_id"], "left").withColumn("in_corridor", F.coalesce("in_corridor", F.lit(False)))


def zone_mask(pixels: DataFrame, edges: DataFrame, affine: tuple[float, ...]) -> DataFrame:
    """Pixels (site_id, row, col) with ``mask`` 0/1: whether their centre is in a zone."""
    a, b, c, d, e, f = affine
    r, q = F.col("row") + 0.5, F.col("col") + 0.5
    centres = pixels.select("site_id", "row", "col").withColumn("node_id", F.struct("row", "col")).withColumn("x", a * q + b * r + c).withColumn("y", d * q + e * r + f)
    return in_zone(centres, edges).select("site_id", "row", "col", F.col("inside_zone").cast("int").alias("mask"))


def corridor_mask(pixels: DataFrame, segments: DataFrame, affine: tuple[float, ...], buffer: float = 100.0) -> DataFrame:
    a, b, c, d, e, f = affine
    r, q = F.col("row") + 0.5, F.col("col") + 0.5
    centres = pixels.select("site_id", "row", "col").withColumn("node_id", F.struct("row", "col")).withColumn("x", a * q + b * r + c).withColumn("y", d * q + e * r + f)
    return in_corridor(centres, segments, buffer).select("site_id", "row", "col", F.col("in_corridor").cast("int").alias("mask"))


def attach_positions(decisions: DataFrame, positions: DataFrame) -> DataFrame:
    """Decisions with positions by key; a row without partner on either side fails."""
    j = decisions.withColumn("d", F.lit(True)).join(positions.withColumn("p", F.lit(True)), ["site_id", "node_id"], "full_outer")
    alone = F.col("d").isNull() | F.col("p").isNull()
    return j.filter(F.when(alone, F.raise_error(F.concat_ws(" ", F.lit("unmatched parcel"), "site_id", "node_id")).cast("boolean")).otherwise(F.lit(True))).drop("d", "p")


def parcel_rows(decisions: DataFrame, prefixes: dict[int, str], site: int | None = None) -> DataFrame:
    """Rows for a map: numbered id with the site's prefix, class and action names, the largest class probability. Rows without finite coordinates are dropped before numbering."""
    from parcelrisk.functions import heads

    d = decisions.filter(heads.finite(F.col("x")) & heads.finite(F.col("y")))
    d, number = number_within(d, ["site_id"], range_bucket(d, "node_id"), ["node_id"], "__number"), F.col("__number")
    names = F.create_map(*[F.lit(v) for kv in prefixes.items() for v in kv])
    classes = F.array(*map(F.lit, S.CLASSES))
    probs = [F.col(f"p_{c}") for c in S.CLASSES]
    listed = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"p_{c}").alias("value")) for c in S.CLASSES])
    prefix = F.coalesce(F.try_element_at(names, F.col("site_id")), F.lit("P"))
    out = d.select("site_id", "node_id", F.format_string("%s-%05d", prefix, number).alias("parcel_id"), "x", "y", F.get(classes, F.col("deprivation_class")).alias("class_name"), F.greatest(*probs).alias("class_proba"), heads.action_name(F.col("action_index")).alias("action"), listed.alias("probabilities"))
    return out if site is None else out.filter(F.col("site_id") == site)
