"""Scene stacks to flood labels: composites, change, histogram threshold, masks, focal means, blobs."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions import raster as R
from parcelrisk.operators import graph
from parcelrisk.sources.scratch import settle

PIXEL = ["site_id", "row", "col"]


def composite(obs: DataFrame, value: str, reducer: str = "median", out: str | None = None) -> DataFrame:
    """Per-pixel median or minimum over scenes; missing values are ignored."""
    if reducer not in ("median", "min"):
        raise ValueError(f"unknown reducer: {reducer}")
    f = F.median if reducer == "median" else F.min
    return obs.groupBy(*PIXEL).agg(f(value).alias(out or value))


def event_pair(obs: DataFrame, value: str = "vv") -> DataFrame:
    """pre_vv, event_vv and their change per pixel, from one scan."""
    d = obs.groupBy(*PIXEL).agg(F.median(F.when(~F.col("is_event"), F.col(value))).alias("pre_vv"), F.median(F.when(F.col("is_event"), F.col(value))).alias("event_vv"))
    return d.withColumn("change", R.change(F.col("pre_vv"), F.col("event_vv")))


def histogram(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """site_id, bin, n, lo, hi (the site's range): equal-width bins, the last one closed. Sites without values have no rows."""
    d = df.filter(F.col(value).isNotNull())
    span = d.groupBy("site_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins)
    at = F.coalesce(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return d.join(span, "site_id").groupBy("site_id", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def otsu(df: DataFrame, value: str, bins: int = 256, answer: str = "edge") -> DataFrame:
    """site_id, threshold: maximises the variance between what lies below and above. The first maximum wins; the answer is the upper
    edge of its bin or, with ``answer="mean"``, the mean of the values in it. A constant site answers its value."""
    h = histogram(df, value, bins)
    step = (F.col("hi") - F.col("lo")) / bins
    h = h.withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * step)
    upto = W.partitionBy("site_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy("site_id")
    h = h.withColumns({"nb": F.sum("n").over(upto), "sb": F.sum(F.col("n") * F.col("mid")).over(upto), "na_": F.sum("n").over(every), "sa_": F.sum(F.col("n") * F.col("mid")).over(every)})
    above = F.col("na_") - F.col("nb")
    gap = F.col("sb") / F.col("nb") - (F.col("sa_") - F.col("sb")) / F.when(above > 0, above)
    h = h.withColumn("between", F.round(F.col("nb") * above * gap * gap, 6))
    pick = F.struct(F.col("between"), (-F.col("bin")).alias("first"))
    best = h.filter("between IS NOT NULL").groupBy("site_id").agg(F.max_by(F.col("lo") + (F.col("bin") + 1) * step if answer == "edge" else F.col("total") / F.col("n"), pick).alias("threshold"))
    flat = h.filter("hi = lo").select("site_id", F.col("lo").alias("threshold"))
    return best.union(flat)


def drop_threshold(changes: DataFrame, bins: int = 256) -> DataFrame:
    """site_id, threshold, source: Otsu over decreases only; with fewer than two, or two distinct, decreases, or a result that is none, the fixed drop."""
    facts = changes.groupBy("site_id").agg(F.count_if(F.col("change") < 0).alias("n"), F.count_distinct(F.when(F.col("change") < 0, F.col("change"))).alias("kinds"))
    found = otsu(changes.filter("change < 0"), "change", bins)
    ok = (F.col("n") >= 2) & (F.col("kinds") >= 2) & (F.col("threshold") < 0)
    return facts.join(found, "site_id", "left").select("site_id", F.when(ok, F.col("threshold")).otherwise(S.FLOOD_DB).alias("threshold"), F.when(ok, "otsu").otherwise("fixed").alias("source"))


def _block_labels(block: pd.DataFrame) -> pd.DataFrame:
    """The pixels of one block, each with the least (by row, then col) of its 8-connected blob in the block as ``label``."""
    block = block.sort_values(["row", "col"], ignore_index=True)
    r, c = (block[k].to_numpy(np.int64) for k in ("row", "col"))
    n, y, x = len(block), r - r.min() + 1, c - c.min() + 1
    grid, label = np.full((y.max() + 2, x.max() + 2), n), np.arange(n)
    while True:
        grid[y, x] = label
        low = np.min([grid[y + a, x + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        low = low[low]  # a label's own label is at least as low
        if (low == label).all():
            return block.assign(label=r[label] * 2**31 + c[label])
        label = low


def small_blobs_dropped(mask: DataFrame, least: int = S.LEAST_BLOB, block: int = 64) -> DataFrame:
    """site_id, row, col of true pixels in 8-connected blobs of at least ``least`` pixels; ``least`` <= 1 keeps all.

    Blobs are labelled inside blocks of ``block`` x ``block`` pixels first, so that only labels that touch across the blocks' borders,
    a row for each pair, go through the components of a graph. Pixels must not repeat.
    """
    if least <= 1:
        return mask.select(*PIXEL)
    at = lambda k: F.floor(F.col(k) / block).alias(f"block_{k}")
    px = mask.select(*[F.col(k).cast("int") for k in PIXEL]).groupBy("site_id", at("row"), at("col")).applyInPandas(lambda g: _block_labels(g[PIXEL]), "site_id int, row int, col int, label long")
    px = settle(px)
    inner = lambda k: F.pmod(F.col(k), F.lit(block)).isin(0, block - 1)
    rim = px.filter(inner("row") | inner("col"))
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("o")
    step = rim.select("site_id", F.col("label").alias("src"), "row", "col", ahead).select("site_id", "src", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    edges = settle(step.join(rim.withColumnRenamed("label", "dst"), PIXEL).filter("src <> dst").select("site_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    sizes = px.groupBy("site_id", "label").agg(F.count("*").alias("n"))
    touching = edges.select("site_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    whole = graph.components(touching, edges).select("site_id", F.col("node_id").alias("label"), "component")
    blobs = settle(sizes.join(whole, ["site_id", "label"], "left").withColumn("component", F.coalesce("component", "label")))
    kept = blobs.groupBy("site_id", "component").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("site_id", "component")
    return px.join(blobs.join(kept, ["site_id", "component"]).select("site_id", "label"), ["site_id", "label"], "left_semi").select(*PIXEL)


def event_flood_label(pixels: DataFrame, bins: int = 256, least: int = S.LEAST_BLOB) -> tuple[DataFrame, DataFrame]:
    """Label and report from pre_vv, event_vv, slope, occurrence.

    Steps in fixed order: threshold on the drop, steep land, permanent water, small blobs; the report counts pixels after each and the
    flooded share of pixels whose change is known.
    """
    d = pixels.withColumn("change", R.change(F.col("pre_vv"), F.col("event_vv")))
    t = drop_threshold(d, bins)
    d = d.join(t, "site_id")
    d = d.withColumn("s1", R.below(F.col("change"), F.col("threshold"))).withColumn("s2", F.col("s1") & ~R.too_steep(F.col("slope"))).withColumn("s3", F.col("s2") & ~R.permanent_water(F.col("occurrence")))
    kept = small_blobs_dropped(d.filter("s3"), least).withColumn("keep", F.lit(1))
    label = d.join(kept, PIXEL, "left").withColumn("flood", F.coalesce("keep", F.lit(0)))
    report = label.groupBy("site_id", "threshold", "source").agg(F.count_if("s1").alias("after_threshold"), F.count_if("s2").alias("after_slope"), F.count_if("s3").alias("after_water"), F.sum("flood").alias("after_blobs"), F.count("change").alias("valid_pixels"))
    report = report.withColumn("flooded_fraction", F.col("after_blobs") / F.greatest("valid_pixels", F.lit(1)))
    return label.select(*PIXEL, "flood"), report


def seasonal_flood_label(obs: DataFrame, value: str = "vv", bins: int = 256) -> DataFrame:
    """The older label: rainy-season minimum, threshold at the mean of the chosen bin over the whole scene, strictly below."""
    low = composite(obs.filter(F.month("ts").isin(*S.RAINY_MONTHS)), value, "min")
    return low.join(otsu(low, value, bins, "mean"), "site_id").select(*PIXEL, F.coalesce(F.col(value) < F.col("threshold"), F.lit(False)).cast("int").alias("flood"))


def focal_mean(pixels: DataFrame, value: str, radius: int, out: str = "focal") -> DataFrame:
    """Mean of the known values within ``radius`` pixels (a disk); NULL where none is known.

    A disk is one run of columns in each of its 2 radius + 1 rows. Each pixel asks for a place in each of these rows, in its own column;
    frames over the columns of a row give the sums of all runs around a place, and each place answers once for each row: so rows in
    proportion to the radius are shuffled, twice, not to the disk's area.
    """
    reach = {a: math.isqrt(radius * radius - a * a) for a in range(-radius, radius + 1)}
    rows = F.explode(F.array(*map(F.lit, reach))).alias("a")
    asked = pixels.select("site_id", F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).alias("v"), rows)
    places = asked.select("site_id", (F.col("row") + F.col("a")).alias("row"), "col", F.when(F.col("a") == 0, F.col("v")).alias("v")).repartition("site_id", "row").groupBy(*PIXEL).agg(F.max("v").alias("v"))
    along = W.partitionBy("site_id", "row").orderBy("col")
    runs = {w: F.struct(F.sum("v").over(along.rangeBetween(-w, w)).alias("s"), F.count("v").over(along.rangeBetween(-w, w)).alias("n")) for w in sorted({*reach.values()})}
    summed = places.select(*PIXEL, *[run.alias(f"run{w}") for w, run in runs.items()])
    answers = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"run{w}.s").alias("s"), F.col(f"run{w}.n").alias("n")) for a, w in reach.items()])).alias("r")
    means = summed.select("site_id", "row", "col", answers).filter("r.n > 0").groupBy("site_id", (F.col("row") - F.col("r.a")).alias("row"), "col").agg((F.sum("r.s") / F.sum("r.n")).alias(out))
    return pixels.join(means, PIXEL, "left")


def wetness_index(terrain: DataFrame, radius: int = 3) -> DataFrame:
    f = focal_mean(terrain, "elevation", radius)
    return f.select(*PIXEL, R.wetness(F.col("focal"), F.col("elevation"), F.col("slope")).alias("twi"))


def build_stack(bands: dict[str, DataFrame], label: DataFrame, label_mode: str, include_s1: bool = True) -> DataFrame:
    """Bands (site_id, row, col and value columns each) aligned by pixel, with the label; pixels are those of the first band.

    ``label`` is the event's or the season's, which ``label_mode`` names; without ``include_s1`` the radar bands pre_vv and event_vv are
    left out. All tables are laid under each other and meet in one aggregate by pixel; a pixel must not repeat within a band.
    """
    if label_mode not in ("event", "seasonal"):
        raise ValueError(f"unknown label mode: {label_mode}")
    radar = () if include_s1 else ("pre_vv", "event_vv")
    parts = [d.drop(*radar) for d in bands.values()] + [label.select(*PIXEL, F.col("flood").alias("flood_label"))]
    values = [c for p in parts for c in p.columns if c not in PIXEL]
    if len({*values}) < len(values):
        raise ValueError(f"bands share column names: {values}")
    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("__first", F.lit(k == 0)) for k, p in enumerate(parts)])
    met = long.groupBy(*PIXEL).agg(*[F.max(c).alias(c) for c in values], F.bool_or("__first").alias("__first"))
    return met.filter("__first").drop("__first")


def layout(stack: DataFrame, inputs: list[str], label: str) -> DataFrame:
    """Inputs and label in order, missing as 0."""
    return stack.select(*PIXEL, *inputs, label).fillna(0, [*inputs, label])


def feature_matrix(stack: DataFrame, inputs: list[str], label: str, rows: int | None = None, seed: int = 0) -> DataFrame:
    """Pixels known in all inputs and the label, label > 0.5; optionally exactly ``rows`` of them, drawn without replacement by hash."""
    d = stack.dropna(subset=[*inputs, label]).select(*PIXEL, *inputs, (F.col(label) > 0.5).cast("int").alias("y"))
    return d if rows is None else d.orderBy(F.xxhash64(F.lit(seed), *PIXEL), *PIXEL).limit(rows)


def stack_profile(stack: DataFrame, bands: list[str], label: str) -> DataFrame:
    """Per site: share of missing values of each band, distinct labels, flooded share."""
    share = lambda b: F.avg(F.col(b).isNull().cast("double")).alias(f"missing_{b}")
    return stack.groupBy("site_id").agg(*map(share, bands), F.array_sort(F.collect_set(label)).alias("labels"), F.avg((F.col(label) > 0.5).cast("double")).alias("flooded"))


def label_profile(labels: DataFrame, location: list[str], label: str = "flood") -> DataFrame:
    return labels.groupBy(*location).agg(F.count("*").alias("pixels"), F.sum(label).alias("flooded"), F.avg(F.col(label).cast("double")).alias("fraction"))


