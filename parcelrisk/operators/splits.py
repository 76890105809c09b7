"""Leakage-free splits and manifest rules. Draws are by a hash order of the key, so a split is the same on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk.operators.numbering import number_within

LOCATION = ["row_off", "col_off"]


def draw(key: Column, seed: int | Column) -> Column:
    """An arithmetic hash that other engines can repeat."""
    return F.pmod(key * 7919 + seed, F.lit(1_000_003))


def stratified_split(df: DataFrame, by_site: bool = False, fractions: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 0) -> DataFrame:
    """Adds ``split`` (train, val, test) within each class, or each site and class; sizes round half to even, the rest is test, and val shrinks first if that is negative."""
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    keys = ["site_id", "y"] if by_site else ["y"]
    n_train = F.bround(F.col("__all") * fractions[0])
    n_val = F.greatest(F.least(F.bround(F.col("__all") * fractions[1]), F.col("__all") - n_train), F.lit(0))
    drawn = draw(F.col("id"), F.col("site_id") + seed if by_site else F.lit(seed))
    d = number_within(df.dropna(subset=keys), keys, F.coalesce(F.floor(drawn / 4_096), F.lit(-1)), [drawn, F.col("id")], "__k", "__all")  # 245 ranges of draws
    return d.withColumn("split", F.when(F.col("__k") <= n_train, "train").when(F.col("__k") <= n_train + n_val, "val").otherwise("test")).drop("__k", "__all")


def locations(manifest: DataFrame) -> DataFrame:
    """Sorted distinct (site_id, row_off, col_off)."""
    return manifest.select("site_id", *LOCATION).distinct().orderBy("site_id", *LOCATION)


def holdout_one(manifest: DataFrame, index: int = -1) -> DataFrame:
    """One site: location number ``index`` of the sorted ones is val, the others train; fewer than two locations fail."""
    order = W.partitionBy("site_id").orderBy(*LOCATION)
    distinct = manifest.select("site_id", *LOCATION).distinct()
    d = distinct.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(W.partitionBy("site_id")))
    few = F.raise_error(F.lit("a spatial holdout needs two locations")).cast("string")
    picked = F.when(F.col("n") < 2, few).when(F.col("k") == F.pmod(F.lit(index), F.col("n")), "val").otherwise("train")
    return manifest.join(d.select("site_id", *LOCATION, picked.alias("split")), ["site_id", *LOCATION])


def holdout_sites(manifest: DataFrame, fraction: float = 0.25, least_train: int = 1, seed: int = 0) -> DataFrame:
    """Per site max(1, round(fraction n)) locations are val, at most n - ``least_train``; all variants of a location stay together; sites with fewer than two locations are left out."""
    distinct = manifest.select("site_id", *LOCATION).distinct()
    order = W.partitionBy("site_id").orderBy(draw(F.col("row_off") * 10_007 + F.col("col_off"), seed), *LOCATION)
    d = distinct.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("site_id"))).filter("n >= 2")
    held = F.least(F.greatest(F.bround(F.col("n") * fraction), F.lit(1)), F.col("n") - least_train)
    return manifest.join(d.select("site_id", *LOCATION, F.when(F.col("k") <= held, "val").otherwise("train").alias("split")), ["site_id", *LOCATION])


def usable_sites(manifest: DataFrame, least: int = 2) -> int:
    """Sites with at least two locations; fewer than ``least`` of them fail."""
    n = manifest.select("site_id", *LOCATION).distinct().groupBy("site_id").count().filter("count >= 2").count()
    if n < least:
        raise ValueError(f"{n} usable sites, {least} needed")
    return n


def prefer_original(manifest: DataFrame) -> DataFrame:
    """Rows of the original variant where a location has one, else all its rows."""
    has = F.max((F.col("variant") == "orig").cast("int")).over(W.partitionBy("site_id", *LOCATION))
    return manifest.withColumn("__has", has).filter((F.col("__has") == 0) | (F.col("variant") == "orig")).drop("__has")


def first_original(manifest: DataFrame) -> DataFrame:
    """The first original row of each location; locations without one are left out."""
    k = F.row_number().over(W.partitionBy("site_id", *LOCATION).orderBy("entry_id"))
    return manifest.filter("variant = 'orig'").withColumn("__k", k).filter("__k = 1").drop("__k")


def check_split(df: DataFrame, ids: list[str], split: str = "split") -> DataFrame:
    """One row per site: its ids, those in more than one split (shared) and those with a row that has no split (missing), and whether the split is exclusive and complete."""
    each = df.groupBy("site_id", *ids).agg(F.count_distinct(split).alias("splits"), F.max(F.col(split).isNull().cast("int")).alias("without"))
    report = each.groupBy("site_id").agg(F.count("*").alias("ids"), F.count_if(F.col("splits") > 1).alias("shared"), F.count_if(F.col("without") == 1).alias("missing"))
    return report.withColumns({"exclusive": F.col("shared") == 0, "complete": F.col("missing") == 0})


def by_site(manifest: DataFrame) -> DataFrame:
    """Entries per site; a row without site fails."""
    key = F.coalesce("site_id", F.raise_error(F.lit("manifest entry without site")).cast("int"))
    return manifest.groupBy(key.alias("site_id")).agg(F.count("*").alias("entries"))


def resolve_sites(keys: list | None, known: list) -> list:
    """All known sites by default; unknown keys and an empty list fail."""
    if keys is None:
        return list(known)
    if not keys or set(keys) - set(known):
        raise ValueError(f"unknown or no sites: {keys}")
    return list(keys)
