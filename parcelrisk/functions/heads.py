"""Decision formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions.raster import clip


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def flood_usable(flood: Column) -> Column:
    return finite(flood) & F.coalesce(flood.between(-1e-6, 1 + 1e-6), F.lit(False))


def class_usable(p: list[Column]) -> Column:
    ok = finite(p[0]) & (p[0] >= -1e-6)
    for c in p[1:]:
        ok = ok & finite(c) & (c >= -1e-6)
    return F.coalesce(ok & (_mass(p) > 1e-8), F.lit(False))


def _mass(p: list[Column]) -> Column:
    return sum((clip(c, 0.0, 1.0) for c in p[1:]), clip(p[0], 0.0, 1.0))


def normalised(p: list[Column]) -> list[Column]:
    """Clipped and scaled to sum 1; 0 on unusable rows."""
    ok, total = class_usable(p), _mass(p)
    return [F.when(ok, clip(c, 0.0, 1.0) / total).otherwise(0.0) for c in p]


def matrix_action(flood_high: Column, deprivation: Column) -> Column:
    rows = [F.element_at(F.array(*map(F.lit, row)), deprivation + 1) for row in S.MATRIX]
    return F.when(flood_high, rows[1]).otherwise(rows[0])


def gate_applies(action: Column, p_high: Column) -> Column:
    """Resettlement needs a strict majority for the highest class."""
    return (action == S.RESETTLE) & ~(p_high > 0.5)


def gated(action: Column, p_high: Column) -> Column:
    return F.when(gate_applies(action, p_high), S.RESILIENT).otherwise(action)


def action_mass(flood: Column, p: list[Column]) -> Column:
    dry = 1 - flood
    return F.array(dry * p[0], dry * p[1], dry * p[2], flood * (p[0] + p[1]), flood * p[2])


def action_name(index: Column) -> Column:
    """Negative is insufficient evidence; an index past the last action fails."""
    names = F.array(*map(F.lit, S.ACTIONS))
    bad = F.raise_error(F.concat(F.lit("action index out of range: "), index.cast("string"))).cast("string")
    return F.when(index < 0, S.INSUFFICIENT).when(index >= len(S.ACTIONS), bad).otherwise(F.try_element_at(names, index + 1))
