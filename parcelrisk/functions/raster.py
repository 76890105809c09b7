"""Pixel formulas as columns. Missing is NULL everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelrisk import schema as S


def clear_sky(qa: Column) -> Column:
    """Neither cloud (bit 10) nor cirrus (bit 11)."""
    return qa.bitwiseAND(3072) == 0


def reflectance(qa: Column, value: Column) -> Column:
    return F.when(clear_sky(qa), value / 10000)


def scene_filter(ts: Column, cloud_pct: Column, mode: Column, polarisations: Column, start: str, end: str, months: tuple[int, ...], most_cloud: float = 20.0) -> Column:
    """Scenes of a date window [start, end) and season, clear enough, in the wide mode and with the vertical band; missing properties do not exclude."""
    when = (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")) & F.month(ts).isin(*months)
    return when & F.coalesce(cloud_pct <= most_cloud, F.lit(True)) & F.coalesce(mode == "IW", F.lit(True)) & F.coalesce(F.array_contains(polarisations, "VV"), F.lit(True))


def unit_db(value: Column, low: float = S.DB_RANGE[0], high: float = S.DB_RANGE[1]) -> Column:
    return clip((value - low) / (high - low), 0.0, 1.0)


def clip(value: Column, low: float, high: float) -> Column:
    """Value held in [low, high]; NULL stays NULL."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def change(pre: Column, event: Column) -> Column:
    return event - pre


def below(value: Column, threshold: Column | float) -> Column:
    """Inclusive; missing is false."""
    return F.coalesce(value <= threshold, F.lit(False))


def too_steep(slope: Column, most: float = S.STEEP_DEG) -> Column:
    """Unknown slope is not too steep."""
    return F.coalesce(slope > most, F.lit(False))


def permanent_water(occurrence: Column, least: float = S.PERMANENT_PCT) -> Column:
    return F.coalesce(occurrence >= least, F.lit(False))


def wetness(focal_elevation: Column, elevation: Column, slope: Column) -> Column:
    rad = F.coalesce(slope, F.lit(0.0)) * (3.14159265 / 180)
    return F.ln(F.greatest(focal_elevation - elevation, F.lit(0.01)) / F.greatest(F.tan(rad), F.lit(0.001)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax(scores: Column) -> Column:
    """Of an array of doubles; shifted by the largest, so it cannot overflow."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def argmax(scores: Column) -> Column:
    """Zero-based place of the largest; the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
