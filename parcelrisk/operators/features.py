"""Parcel features to severity classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.functions import parcels as P
from parcelrisk.operators import spatial
from parcelrisk.operators.quantiles import percentiles
from parcelrisk.sources.scratch import settle

DISTANCES = {"water": "dist_to_water_m", "sanitation": "dist_to_sanitation_m", "road": "dist_to_road_m"}
FEATURES = ["area_m2", *DISTANCES.values(), "roof_score"]


def with_distances(parcels: DataFrame, infra: DataFrame, missing: str = "accessible") -> DataFrame:
    """A distance column for each category, from one search."""
    found = spatial.nearest_each(parcels, infra, list(DISTANCES))
    wide = found.groupBy("site_id", "node_id").agg(*[F.min(F.when(F.col("category") == category, F.col("d"))).alias(name) for category, name in DISTANCES.items()])
    out = settle(parcels.join(wide.hint("merge"), ["site_id", "node_id"], "left"))  # read for the largest distances, the cuts and the rows
    return spatial.impute(out, list(DISTANCES.values()), missing)


def enrich(parcels: DataFrame, infra: DataFrame) -> DataFrame:
    """Distances, roof score, deprivation score and class."""
    d = with_distances(parcels, infra).withColumn("roof_score", P.roof_score(F.col("roof_material")))
    d = d.withColumn("score", P.deprivation(F.col("area_m2"), *[F.col(c) for c in DISTANCES.values()], F.col("roof_score")))
    return severity(d, "score")


def severity(df: DataFrame, score: str, classes: int = 3, cuts: list[float] | None = None, out: str = "severity") -> DataFrame:
    """Class 0..classes-1 by the site's quantile cuts (linear, left-closed); colliding cuts become equal widths, a constant site is 0. Explicit cuts apply to all."""
    if cuts is not None:
        if len(cuts) != classes - 1:
            raise ValueError(f"{classes} classes need {classes - 1} cuts")
        return df.withColumn(out, sum(((F.col(score) >= c).cast("int") for c in cuts[1:]), (F.col(score) >= cuts[0]).cast("int")))
    q = [k / classes for k in range(1, classes)]
    facts = percentiles(df, ["site_id"], score, q).withColumnRenamed("percentiles", "cuts")
    collide = F.size(F.array_distinct("cuts")) < classes - 1
    even = F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * x for x in q])
    facts = facts.select("site_id", F.when(collide, even).otherwise(F.col("cuts")).alias("cuts"), (F.col("hi") <= F.col("lo")).alias("flat"))
    d = df.join(F.broadcast(facts), "site_id")  # a row for each site
    level = F.size(F.filter("cuts", lambda c: F.col(score) >= c))
    return d.withColumn(out, F.when(F.col("flat"), 0).otherwise(level)).drop("cuts", "flat")
