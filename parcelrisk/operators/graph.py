"""Proximity graphs: radius join, components, integrity, pruning, neighbour means. Nodes are keyed (site_id, node_id), edges (site_id, src, dst) with src < dst.

Joins of nodes and edges ask for a sort-merge: the files of a few numeric columns are so small that tables of millions of rows would be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.operators.numbering import number_within, range_bucket
from parcelrisk.sources.scratch import settle


def grid(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("cx", F.floor(F.col(x) / size)).withColumn("cy", F.floor(F.col(y) / size))


def neighbouring(df: DataFrame, forward: bool = False) -> DataFrame:
    """Each row once for its own cell and those around it; ``forward``: only half of those around it, so two cells meet once."""
    steps = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)] if forward else [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    d = df.withColumn("o", F.explode(offsets))
    return d.withColumn("cx", F.col("cx") + F.col("o.a")).withColumn("cy", F.col("cy") + F.col("o.b")).withColumn("own", (F.col("o.a") == 0) & (F.col("o.b") == 0)).drop("o")


def proximity_edges(nodes: DataFrame, radius: float | None = None) -> DataFrame:
    """Undirected pairs of a site at most ``radius`` apart (inclusive); an equi-join on grid cells of that size.

    Nodes are dealt out before each is sent to several cells: a file of one row group is read by one task, which would hold all these rows for the shuffle.
    """
    r = S.EDGE_M if radius is None else radius
    n = grid(nodes.select("site_id", "node_id", "x", "y").repartition("site_id", "node_id"), max(r, 1e-9))
    a = neighbouring(n, forward=True).select("site_id", "cx", "cy", "own", F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = n.select("site_id", "cx", "cy", F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    met = a.join(b.hint("merge"), ["site_id", "cx", "cy"]).filter((dx * dx + dy * dy <= r * r) & (~F.col("own") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
    return met.select("site_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return edges.select("site_id", F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e")).select("site_id", "e.src", "e.dst")


def spots(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes at one position as one: (site_id, node_id, spot), where ``spot`` is the smallest node_id there, and (site_id, node_id, x, y, n), a row for each spot with its nodes counted.

    Nodes at one position are linked with each other and with the same others, so a graph of spots tells degrees, components and counts of
    edges without listing the pairs of copies. A node without finite position is a spot of its own.
    """
    key = ["site_id", "x", "y"]
    placed = nodes.select("site_id", "node_id", *[F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in ("x", "y")])
    first = placed.dropna(subset=["x", "y"]).groupBy(*key).agg(F.min("node_id").alias("spot"))
    members = settle(placed.join(first.hint("merge"), key, "left").withColumn("spot", F.coalesce("spot", "node_id")))
    return members.drop("x", "y"), members.groupBy("site_id", F.col("spot").alias("node_id")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.count("*").alias("n"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """site_id, node_id, component: the smallest node_id reachable.

    Each round takes the smallest neighbour of a node and then that of this one, and goes on with the edges between what was taken, each
    once; loops go, so rounds shrink and end by themselves. They are tables in the shared folder, and only whether edges are left
    reaches the driver. The labels are then handed back from the last round to the first.
    """
    left, steps = settle(edges.select("site_id", "src", "dst")), []
    while left.limit(1).count():
        low = both_ways(left).groupBy("site_id", F.col("src").alias("node_id")).agg(F.min("dst").alias("to")).withColumn("to", F.least("node_id", "to"))
        further = low.select("site_id", F.col("node_id").alias("to"), F.col("to").alias("component"))
        step = settle(low.join(further.hint("merge"), ["site_id", "to"]).select("site_id", "node_id", "component"))
        for end in ("src", "dst"):
            at = step.select("site_id", F.col("node_id").alias(end), F.col("component").alias("now"))
            left = left.join(at.hint("merge"), ["site_id", end]).drop(end).withColumnRenamed("now", end)
        left = settle(left.filter("src <> dst").select("site_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        steps.append(step)
    ids = nodes.select("site_id", "node_id")
    if not steps:
        return ids.withColumn("component", F.col("node_id"))
    found = steps.pop()
    for step in [*reversed(steps), ids.withColumn("component", F.col("node_id"))]:
        last = found.select("site_id", F.col("node_id").alias("component"), F.col("component").alias("last"))
        found = step.join(last.hint("merge"), ["site_id", "component"], "left").select("site_id", "node_id", F.coalesce("last", "component").alias("component"))
    return settle(found)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """site_id, node_id, degree; 0 for isolated nodes."""
    d = both_ways(edges).groupBy("site_id", F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("site_id", "node_id").join(d.hint("merge"), ["site_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def integrity(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per site: nodes, edges, components, isolated nodes, share of the largest component. A row of ``nodes`` may stand for ``n`` nodes at one position, as in ``spots``."""
    sized = nodes.select("site_id", "node_id", (F.col("n") if "n" in nodes.columns else F.lit(1)).cast("long").alias("n"))
    near = both_ways(edges).join(sized.withColumnRenamed("node_id", "dst").hint("merge"), ["site_id", "dst"]).groupBy("site_id", F.col("src").alias("node_id")).agg(F.sum("n").alias("near"))
    d = labels.join(sized.hint("merge"), ["site_id", "node_id"]).join(near.hint("merge"), ["site_id", "node_id"], "left").withColumn("degree", F.col("n") - 1 + F.coalesce("near", F.lit(0)))
    parts = d.groupBy("site_id", "component").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("degree")).alias("ends"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"))
    per = parts.groupBy("site_id").agg(F.sum("n").alias("nodes"), (F.sum("ends") / 2).cast("long").alias("edges"), F.count("*").alias("components"), F.sum("isolated").alias("isolated"), F.max("n").alias("largest"))
    return per.select("site_id", "nodes", "edges", "components", "isolated", (F.col("largest") / F.col("nodes")).alias("largest_share"))


def isolated_sample(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """The first isolated nodes, for a log."""
    return degrees(nodes, edges).filter("degree = 0").orderBy("site_id", "node_id").limit(most).select("site_id", "node_id")


def large(nodes: DataFrame, labels: DataFrame, least: int | None = None) -> DataFrame:
    """site_id, node_id of components of at least ``least`` nodes; a row of ``nodes`` may stand for ``n`` nodes at one position."""
    least = S.LEAST_COMPONENT if least is None else least
    sized = labels.withColumn("n", F.lit(1)) if "n" not in nodes.columns else labels.join(nodes.select("site_id", "node_id", "n").hint("merge"), ["site_id", "node_id"])
    kept = sized.groupBy("site_id", "component").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return labels.join(kept.hint("merge"), ["site_id", "component"], "left_semi").select("site_id", "node_id")


def prune(nodes: DataFrame, edges: DataFrame, labels: DataFrame, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of components of at least ``least`` nodes, and the edges between them."""
    ids = large(labels, labels, least)
    ends = ids.withColumnRenamed("node_id", "src")  # an edge never leaves its component
    return nodes.join(ids.hint("merge"), ["site_id", "node_id"], "left_semi"), edges.join(ends.hint("merge"), ["site_id", "src"], "left_semi")


def neighbour_mean(nodes: DataFrame, edges: DataFrame, features: list[str], prefix: str = "mean_") -> DataFrame:
    """Nodes with the mean of their neighbours' features; 0 for isolated nodes."""
    far = nodes.select("site_id", F.col("node_id").alias("dst"), *features)
    means = both_ways(edges).join(far.hint("merge"), ["site_id", "dst"]).groupBy("site_id", F.col("src").alias("node_id")).agg(*[F.avg(f).alias(prefix + f) for f in features])
    out = nodes.join(means.hint("merge"), ["site_id", "node_id"], "left")
    return out.fillna(0.0, [prefix + f for f in features])


def standardise(df: DataFrame, features: list[str], keys: list[str], prefix: str = "z_") -> DataFrame:
    """z-scores per key with the sample deviation, at least 1e-6."""
    facts = df.groupBy(*keys).agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.coalesce(F.greatest(F.stddev_samp(f), F.lit(1e-6)), F.lit(1e-6)).alias(f"s_{f}"))])
    d = df.join(F.broadcast(facts), keys)  # a row for each site
    return d.select(*df.columns, *[((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}")).alias(prefix + f) for f in features])


def feature_table(nodes: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Keys, z-scored features in order, the label if there is one, and the position, which is no feature."""
    z = standardise(nodes.withColumn("label", F.col(label)) if label else nodes, features, ["site_id"])
    return z.select("site_id", "node_id", *[F.col(f"z_{f}").alias(f) for f in features], *([F.col("label").alias("y")] if label else []), F.col("x").alias("pos_x"), F.col("y").alias("pos_y"))


def union_sites(parts: list[DataFrame]) -> DataFrame:
    """Disjoint union of site tables with a flat id: sites in order, nodes by node_id inside."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    sizes = whole.groupBy("site_id").agg(F.count("*").alias("n"))
    first = sizes.select("site_id", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("site_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))  # a row for each site
    numbered = number_within(whole, ["site_id"], range_bucket(whole, "node_id"), ["node_id"], "__k")
    return numbered.join(F.broadcast(first), "site_id").withColumn("flat_id", F.col("__first") + F.col("__k") - 1).drop("__first", "__k")


def align_positions(old: DataFrame, new: DataFrame, features: list[str], atol: float = 1e-4, rtol: float = 1e-4) -> DataFrame:
    """One row per site: status ``present`` (old has positions), ``aligned`` (same nodes and features: new positions can be taken over) or ``replaced``."""
    o = old.select("site_id", "node_id", F.col("x").alias("ox"), *[F.col(f).alias(f"o_{f}") for f in features], F.lit(True).alias("in_old"))
    n = new.select("site_id", "node_id", *[F.col(f).alias(f"n_{f}") for f in features], F.lit(True).alias("in_new"))
    close = F.lit(True)
    for f in features:
        close = close & (F.abs(F.col(f"o_{f}") - F.col(f"n_{f}")) <= atol + rtol * F.abs(F.col(f"n_{f}")))
    j = o.join(n, ["site_id", "node_id"], "full_outer")
    same = F.coalesce(F.col("in_old") & F.col("in_new") & close, F.lit(False))
    out = j.groupBy("site_id").agg(F.every(F.coalesce(F.col("ox").isNotNull(), F.lit(False))).alias("present"), F.every(same).alias("same"))
    return out.select("site_id", F.when(F.col("present"), "present").when(F.col("same"), "aligned").otherwise("replaced").alias("status"))
