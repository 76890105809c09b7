"""Overlapping tiles as arithmetic on pixel keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk import schema as S


def tile_numbers(at: Column, extent: Column, size: int = S.TILE, overlap: int = S.OVERLAP) -> Column:
    """Numbers of the windows that cover a row or column; empty where none fits."""
    stride = size - overlap
    first = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / stride)).cast("int")
    last = F.least(F.floor(at / stride), F.floor((extent - size) / stride)).cast("int")
    return F.when((extent >= size) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def tile(pixels: DataFrame, size: int = S.TILE, overlap: int = S.OVERLAP) -> DataFrame:
    """Pixels once for each window over them: tile_row_off, tile_col_off, local_row, local_col. The extent is each site's."""
    stride = size - overlap
    extent = pixels.groupBy("site_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    d = pixels.join(F.broadcast(extent), "site_id")  # a row for each site
    d = d.withColumn("tr", F.explode(tile_numbers(F.col("row"), F.col("height"), size, overlap))).withColumn("tc", F.explode(tile_numbers(F.col("col"), F.col("width"), size, overlap)))
    d = d.withColumn("tile_row_off", F.col("tr") * stride).withColumn("tile_col_off", F.col("tc") * stride)
    return d.withColumn("local_row", F.col("row") - F.col("tile_row_off")).withColumn("local_col", F.col("col") - F.col("tile_col_off")).drop("tr", "tc", "height", "width")


TILE_KEY = ["site_id", "tile_row_off", "tile_col_off"]


def valid_fractions(tiles: DataFrame, bands: list[str], size: int) -> DataFrame:
    """Share of a window's places that are known in all bands and non-zero in any."""
    known, some = F.lit(True), F.lit(False)
    for b in bands:
        known, some = known & F.col(b).isNotNull(), some | F.coalesce(F.col(b) != 0, F.lit(False))
    return tiles.groupBy(*TILE_KEY).agg((F.count_if(known & some) / (size * size)).alias("valid_fraction"))


def keep_valid(tiles: DataFrame, bands: list[str], size: int, least: float = S.LEAST_VALID) -> DataFrame:
    v = valid_fractions(tiles, bands, size).filter(F.col("valid_fraction") >= least)
    return tiles.join(v, TILE_KEY)


def scale_bands(tiles: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each band of each tile between its 1st and 99th percentile (linear), clipped to [0, 1]; constant or empty bands are 0. Bands named vv or *_vv use the shared decibel window; a label is never scaled."""
    from parcelrisk.functions.raster import clip, unit_db

    keys = keys or TILE_KEY
    optical = [b for b in bands if b != "vv" and not b.endswith("_vv")]
    out = tiles
    if optical:
        q = tiles.groupBy(*keys).agg(*[F.percentile(b, [0.01, 0.99]).alias(f"q_{b}") for b in optical])
        out = out.join(q, keys)
    scaled = {}
    for b in bands:
        if b in optical:
            lo, hi = F.col(f"q_{b}")[0], F.col(f"q_{b}")[1]
            scaled[b] = F.when(hi > lo, clip((F.col(b) - lo) / F.when(hi > lo, hi - lo), 0.0, 1.0)).otherwise(F.when(F.col(b).isNotNull(), 0.0))
        else:
            scaled[b] = unit_db(F.col(b))
    return out.withColumns(scaled).drop(*[f"q_{b}" for b in optical])


def augment(tiles: DataFrame, size: int = S.TILE) -> DataFrame:
    """Each pixel in four variants: as it is, columns flipped, rows flipped, turned counter-clockwise. One scan."""
    r, c, last = F.col("local_row"), F.col("local_col"), size - 1
    variants = [("orig", r, c), ("flip_h", r, last - c), ("flip_v", last - r, c), ("rot90", last - c, r)]
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), a.alias("r"), b.alias("c")) for n, a, b in variants])).alias("v")
    return tiles.select("*", v).withColumn("variant", F.col("v.variant")).withColumn("local_row", F.col("v.r")).withColumn("local_col", F.col("v.c")).drop("v")


def tile_mean_at(points: DataFrame, tiles: DataFrame, value: str, size: int = S.TILE, overlap: int = S.OVERLAP) -> DataFrame:
    """Points (site_id, node_id, row, col) with the mean of ``value`` over every tile that covers their pixel; none: NULL. ``tiles`` has tile offsets and local places of un-augmented tiles."""
    stride = size - overlap
    near = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - (size - 1)) / stride)).cast("int"), F.floor(F.col(c) / stride).cast("int")))
    p = points.filter("row >= 0 AND col >= 0").withColumn("tr", near("row")).withColumn("tc", near("col"))
    p = p.select("site_id", "node_id", (F.col("tr") * stride).alias("tile_row_off"), (F.col("tc") * stride).alias("tile_col_off"), (F.col("row") - F.col("tr") * stride).alias("local_row"), (F.col("col") - F.col("tc") * stride).alias("local_col"))
    m = p.join(tiles, [*TILE_KEY, "local_row", "local_col"]).groupBy("site_id", "node_id").agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(value))
    return points.join(m, ["site_id", "node_id"], "left")


def safe_pixels(pixels: DataFrame, train: DataFrame, size: int, overlap: int) -> DataFrame:
    """Pixels that no training tile covers. ``train`` has site_id, row_off, col_off."""
    stride = size - overlap
    near = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - (size - 1)) / stride)).cast("int"), F.floor(F.col(c) / stride).cast("int")))
    p = pixels.select("site_id", "row", "col").distinct().withColumn("tr", near("row")).withColumn("tc", near("col"))
    p = p.withColumn("row_off", F.col("tr") * stride).withColumn("col_off", F.col("tc") * stride)
    covered = p.join(train.select("site_id", "row_off", "col_off").distinct(), ["site_id", "row_off", "col_off"], "left_semi").select("site_id", "row", "col").distinct()
    return pixels.join(covered, ["site_id", "row", "col"], "left_anti")


def safe_evaluation(pixels: DataFrame, train: DataFrame, size: int, overlap: int) -> DataFrame:
    """Per site on safe pixels (label, pred 0/1): counts, IoU, F1, positive share and the all-flooded baseline."""
    from parcelrisk.operators.metrics import counts, pixel_scores

    safe = safe_pixels(pixels, train, size, overlap)
    c = safe.groupBy("site_id").agg(*counts(F.col("pred") > 0, F.col("label") > 0), F.avg(F.col("label").cast("double")).alias("baseline_iou"))
    return pixel_scores(c)
