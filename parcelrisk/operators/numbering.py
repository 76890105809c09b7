"""Row numbers within groups of any size: ranges are numbered by themselves, and each begins where the one before it ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 16  # edges are looked up in two steps of this many


def range_bucket(df: DataFrame, column: str) -> Column:
    """0 to WIDTH^2 - 1: which of so many quantile ranges of the whole table a number lies in; -1 for NULL. Larger numbers never lie in a lower range. Only the edges reach the driver."""
    n = WIDTH * WIDTH
    edges = df.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    parts = [edges[k : k + WIDTH] for k in range(0, len(edges), WIDTH)]
    if not parts:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    under = lambda listed: F.size(F.filter(listed, lambda e: e < F.col(column)))
    whole = under(F.array(*[F.lit(p[-1]) for p in parts]))
    inside = F.get(F.array(*[F.array(*map(F.lit, p)) for p in parts]), whole)
    return F.when(F.col(column).isNull(), -1).otherwise(whole * WIDTH + F.coalesce(F.when(inside.isNotNull(), under(inside)), F.lit(0)))


def number_within(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str = "number", size: str | None = None) -> DataFrame:
    """Adds ``name``, 1, 2, ... within ``keys`` in ``order``, and with ``size`` the rows of the group. ``bucket`` must not fall in that order.

    A task numbers one bucket of one group. The table of buckets, one row for each bucket of each group, is broadcast: groups are sites or classes.
    """
    d = df.withColumn("__bucket", bucket)
    every = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    counted = d.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    counted = counted.select(
        *[F.col(c).alias(f"__key_{c}") for c in keys],
        F.col("__bucket").alias("__key_bucket"),
        F.coalesce(F.sum("__n").over(every.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(every).alias("__size"),
    )
    out = d.withColumn("__row", F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy(*order)))
    same = reduce(lambda a, b: a & b, [out[c].eqNullSafe(counted[f"__key_{c}"]) for c in keys], out["__bucket"] == counted["__key_bucket"])
    number = (F.col("__row") + F.col("__before")).alias(name)
    return out.join(F.broadcast(counted), same).select(*[F.col(c) for c in df.columns if c not in (name, size)], number, *([F.col("__size").alias(size)] if size else []))
