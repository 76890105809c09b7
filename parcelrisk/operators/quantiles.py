"""Exact percentiles of groups of any size, by counting: no task holds or sorts a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk.sources.scratch import settle


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """keys, n (known values), lo, hi (least and greatest), percentiles (array by ``shares``, linear between ranks, as ``percentile`` gives).

    A sketch of bounded size brackets each wanted rank; values below a bracket are counted, and only values inside, about four in
    ``accuracy`` of a group, are counted by value to find the rank. A group that is small for the sketch, or whose sketch should miss, is
    bracketed by its least and greatest value. NULL does not count; a group without values has no row. ``keys`` must name few groups,
    such as sites: their brackets are broadcast.
    """
    if not all(0 <= q <= 1 for q in shares):
        raise ValueError(f"shares of a group lie in [0, 1]: {shares}")
    d = settle(df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL"))  # read three times
    slack = 2 / accuracy
    near = [min(max(q + e, 0.0), 1.0) for q in shares for e in (-slack, slack)]
    facts = d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", near, accuracy).alias("near"))
    small = F.col("n") < 4 * accuracy
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.get("near", F.lit(2 * i)).alias("a"), F.get("near", F.lit(2 * i + 1)).alias("b")) for i, q in enumerate(shares)])
    brackets = facts.select(*keys, "n", "lo", "hi", F.explode(wanted).alias("w")).select(*keys, "n", "lo", "hi", "w.i", ((F.col("n") - 1) * F.col("w.q")).alias("place"), F.when(small, F.col("lo")).otherwise(F.col("w.a")).alias("a"), F.when(small, F.col("hi")).otherwise(F.col("w.b")).alias("b"))
    brackets = settle(brackets)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = lambda of: d.alias("d").join(F.broadcast(of).alias("b"), [*same, F.col("v") <= F.col("b.b")] if same else F.col("v") <= F.col("b.b"))
    named = [F.col(f"b.{k}").alias(k) for k in keys]
    counted = met(brackets).groupBy(*named, "i").agg(F.count_if(F.col("v") < F.col("a")).alias("below"), F.count("*").alias("upto"))
    joined = brackets.alias("x").join(F.broadcast(counted).alias("y"), [*[F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys], F.col("x.i") == F.col("y.i")])
    missed = (F.col("below") > F.floor("place")) | (F.col("upto") < F.ceil("place") + 1)
    brackets = settle(joined.select(*[F.col(f"x.{k}").alias(k) for k in keys], "n", "lo", "hi", F.col("x.i").alias("i"), "place", F.when(missed, F.col("lo")).otherwise(F.col("a")).alias("a"), F.when(missed, F.col("hi")).otherwise(F.col("b")).alias("b"), F.when(missed, 0).otherwise(F.col("below")).alias("below")))
    inside = met(brackets).filter(F.col("v") >= F.col("a")).groupBy(*named, "i", "below", "place", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(W.partitionBy(*keys, "i").orderBy("v"))
    ranked = inside.select(*keys, "i", "place", "v", upto.alias("upto"))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    ends = ranked.groupBy(*keys, "i", "place").agg(at(F.floor("place")).alias("u"), at(F.ceil("place")).alias("w"))
    answer = F.when(F.floor("place") == F.ceil("place"), F.col("u")).otherwise((F.ceil("place") - F.col("place")) * F.col("u") + (F.col("place") - F.floor("place")) * F.col("w"))
    listed = ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", answer.alias("p")))), lambda s: s["p"]).alias("percentiles"))  # one a share
    out = facts.select(*keys, "n", "lo", "hi").alias("f").join(F.broadcast(listed).alias("l"), [F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys] or F.lit(True))
    return out.select(*[F.col(f"f.{k}").alias(k) for k in keys], "n", "lo", "hi", "percentiles")

