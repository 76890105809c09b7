"""Parcel indicators as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions.raster import clip


def roof_score(material: Column) -> Column:
    """Worst known material of a semicolon list; missing and unknown are neutral (0.5)."""
    scores = F.create_map(*[F.lit(v) for kv in S.ROOF_SCORES.items() for v in kv])
    known = F.transform(F.split(F.lower(F.trim(material)), ";"), lambda m: F.try_element_at(scores, F.trim(m)))
    return F.coalesce(F.array_max(known), F.lit(0.5))


def roof_tag(columns: list[str]) -> Column:
    """The roof column if the table has one, else the building column; a choice of columns, not of rows."""
    return F.col("roof:material") if "roof:material" in columns else F.col("building:material") if "building:material" in columns else F.lit(None).cast("string")


def deprivation(area: Column, water: Column, sanitation: Column, road: Column, roof: Column) -> Column:
    """Mean of five deficits in [0, 1]."""
    parts = [clip(water / S.WATER_M, 0.0, 1.0), clip(sanitation / S.SANITATION_M, 0.0, 1.0), clip(road / S.ROAD_M, 0.0, 1.0), clip(S.CROWDED_M2 / F.greatest(area, F.lit(1e-6)), 0.0, 1.0), roof]
    return sum(parts[1:], parts[0]) / 5


def infra_categories(tags: Column) -> Column:
    """Array of the categories a feature belongs to."""
    kinds = [F.when(tags["amenity"] == "drinking_water", "water"), F.when(tags["amenity"] == "toilets", "sanitation"), F.when(tags["highway"].isNotNull(), "road")]
    return F.filter(F.array(*kinds), lambda k: k.isNotNull())


def export_buffer(width_m: Column, height_m: Column, base: float, tiles: int = 2, scale_m: float = 10.0, slack: float = 1.10) -> Column:
    """Metres to add on each side so that ``tiles`` windows fit both ways."""
    needed = (S.TILE + (tiles - 1) * (S.TILE - S.OVERLAP)) * scale_m * slack
    return F.greatest(F.lit(base), (needed - width_m) / 2, (needed - height_m) / 2)


def boundary(area_km2: Column, polygon: Column, box: Column, least: float = 0.1, most: float = 20.0) -> Column:
    return F.when(area_km2.between(least, most), polygon).otherwise(box)
