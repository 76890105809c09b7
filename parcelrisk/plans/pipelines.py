"""The domain's pipelines: graph branch, raster branch, fusion; all sites at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions import heads
from parcelrisk.operators import features, graph, metrics, policy, raster, spatial, splits, tiles
from parcelrisk.sources.scratch import settle


def graph_branch(parcels: DataFrame, infra: DataFrame, radius: float = S.EDGE_M, least: int = S.LEAST_COMPONENT) -> dict[str, DataFrame]:
    """nodes (features, y), edges, integrity. Classes are cut before pruning, z-scores taken after it, and the report is of the graph before it.

    The report and the pruning come from the graph of positions, so parcels at one position cost no pairs; only ``edges`` lists them, when asked.
    """
    nodes = settle(features.enrich(parcels, infra))
    members, places = graph.spots(nodes)
    places = settle(places)
    near = settle(graph.proximity_edges(places, radius))
    labels = graph.components(places, near)
    report = graph.integrity(places, near, labels)
    spots = graph.large(places, labels, least).withColumnRenamed("node_id", "spot")
    ids = members.join(spots.hint("merge"), ["site_id", "spot"], "left_semi").drop("spot")
    kept = nodes.join(ids.hint("merge"), ["site_id", "node_id"], "left_semi")
    table = graph.standardise(kept, features.FEATURES, ["site_id"])
    table = table.select("site_id", "node_id", *[F.col(f"z_{f}").alias(f) for f in features.FEATURES], F.col("severity").alias("y"), F.col("x").alias("pos_x"), F.col("y").alias("pos_y"))
    return {"nodes": table, "edges": graph.proximity_edges(kept, radius), "integrity": report}  # an edge never leaves its component


def run_status(parcels: DataFrame, infra: DataFrame, sites: list[int]) -> DataFrame:
    """One row per site: ok, or why it cannot run. A site without parcels or without any infrastructure does not stop the others."""
    want = parcels.sparkSession.createDataFrame([(s,) for s in sites], "site_id int")
    n = parcels.groupBy("site_id").agg(F.count("*").alias("parcels"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("bad"))
    k = infra.groupBy("site_id").agg(F.count_distinct("category").alias("categories"))
    d = want.join(n, "site_id", "left").join(k, "site_id", "left").fillna(0)
    status = F.when(F.col("parcels") == 0, "no parcels").when(F.col("bad") > 0, "parcels without position").when(F.col("categories") == 0, "no infrastructure").otherwise("ok")
    return d.withColumn("status", status)


PARCEL_CHECKS = {
    "node_id is no number": lambda: F.col("node_id").isNull(),
    "no position": lambda: ~(heads.finite(F.col("x")) & heads.finite(F.col("y"))),
    "no area": lambda: ~(heads.finite(F.col("area_m2")) & (F.col("area_m2") > 0)),
}
INFRA_CHECKS = {"no position": lambda: ~(heads.finite(F.col("x")) & heads.finite(F.col("y"))), "no category": lambda: F.col("category").isNull()}


def _checked(raw: DataFrame, types: dict[str, str], checks: dict[str, Callable[[], Column]]) -> DataFrame:
    """``raw`` with its columns as numbers where they can be read as such, and ``reason``: the first check that a row fails."""
    d = raw.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    failed = F.coalesce(*[F.when(F.coalesce(check(), F.lit(True)), name) for name, check in checks.items()])
    return d.withColumn("reason", F.coalesce(failed, F.when(F.col("site_id").isNull(), "site_id is no number")))


def check_sites(parcels: DataFrame, infra: DataFrame, sites: list[int], tolerated: float = 0.0) -> dict[str, DataFrame]:
    """Rows that can be used of sites that can run (``parcels``, ``infra``), the others in ``rejected``, and ``status``, one row for each of ``sites``.

    ``parcels`` (site_id, node_id, x, y, area_m2, roof_material) and ``infra`` (site_id, infra_id, category, x, y) may hold what cannot
    be read: text for numbers, missing or infinite positions, repeated ids. Such rows go to ``rejected`` (source, site_id, key, reason).
    A site fails if more than ``tolerated`` of its parcels are rejected, or if it has none; infrastructure that cannot be read is only
    left out, as a category that is missing has a rule of its own. ``status``: site_id, status (ok or failed), reason (of a failure: the
    most frequent one), parcels, rejected. Sites that were not asked for are not run.
    """
    p = _checked(parcels, {"site_id": "int", "node_id": "long", "x": "double", "y": "double", "area_m2": "double"}, PARCEL_CHECKS)
    twice = p.filter("reason IS NULL").groupBy("site_id", "node_id").agg(F.count("*").alias("n")).filter("n > 1").drop("n").withColumn("again", F.lit("repeated node_id"))
    p = settle(p.join(twice, ["site_id", "node_id"], "left").withColumn("reason", F.coalesce("reason", "again")).drop("again"))
    i = settle(_checked(infra, {"site_id": "int", "infra_id": "long", "x": "double", "y": "double"}, INFRA_CHECKS))
    bad = lambda d, source, key: d.filter("reason IS NOT NULL").select(F.lit(source).alias("source"), "site_id", F.col(key).cast("string").alias("key"), "reason")
    rejected = bad(p, "parcels", "node_id").union(bad(i, "infra", "infra_id"))
    want = parcels.sparkSession.createDataFrame([(s,) for s in sites], "site_id int")
    first = F.min_by("reason", F.struct(-F.col("n"), "reason"))  # the most frequent reason
    why = p.filter("reason IS NOT NULL").groupBy("site_id", "reason").agg(F.count("*").alias("n")).groupBy("site_id").agg(F.sum("n").alias("rejected"), first.alias("why"))
    status = want.join(p.groupBy("site_id").agg(F.count("*").alias("parcels")), "site_id", "left").join(why, "site_id", "left").fillna(0, ["parcels", "rejected"])
    reason = F.when(F.col("parcels") == 0, "no parcels").when(F.col("rejected") > F.col("parcels") * tolerated, F.col("why"))
    status = settle(status.select("site_id", F.when(reason.isNull(), "ok").otherwise("failed").alias("status"), reason.alias("reason"), "parcels", "rejected"))
    ok = F.broadcast(status.filter("status = 'ok'").select("site_id"))  # a row for each site
    good = lambda d: d.filter("reason IS NULL").drop("reason").join(ok, "site_id", "left_semi")
    return {"parcels": good(p), "infra": good(i), "rejected": rejected, "status": status}


def run_all_sites(parcels: DataFrame, infra: DataFrame, sites: list[int], tolerated: float = 0.0, radius: float = S.EDGE_M, least: int = S.LEAST_COMPONENT) -> dict[str, DataFrame]:
    """The graph branch of all sites that ``check_sites`` passes, at once: a failing site does not stop the others. nodes, edges, integrity, rejected, status."""
    checked = check_sites(parcels, infra, sites, tolerated)
    return graph_branch(settle(checked["parcels"]), settle(checked["infra"]), radius, least) | {k: checked[k] for k in ("rejected", "status")}


def raster_branch(obs: DataFrame, terrain: DataFrame, size: int = S.TILE, overlap: int = S.OVERLAP, bins: int = 256, least_valid: float = S.LEAST_VALID) -> DataFrame:
    """Scaled tile pixels with the event label and the wetness index: stack, tile, filter, scale."""
    pair = raster.event_pair(obs)
    px = pair.join(terrain, raster.PIXEL, "left")
    label, _ = raster.event_flood_label(settle(px), bins)
    stack = raster.build_stack({"vv": px.drop("change"), "twi": raster.wetness_index(terrain)}, label, "event")
    bands = ["pre_vv", "event_vv", "elevation", "slope", "twi"]
    kept = tiles.keep_valid(tiles.tile(stack, size, overlap), bands, size, least_valid)
    return tiles.scale_bands(settle(kept), bands)


def label_ingredients(obs: DataFrame, terrain: DataFrame) -> DataFrame:
    """What the label is made of, so that it can be made again with other thresholds."""
    return raster.event_pair(obs).drop("change").join(terrain.select(*raster.PIXEL, "slope", "occurrence", "elevation"), raster.PIXEL, "left")


def fusion(parcels: DataFrame, heads: DataFrame, zones: DataFrame, reference: DataFrame | None = None, footprints: DataFrame | None = None) -> dict[str, DataFrame]:
    """decisions, summary, audit, lift. ``heads`` has flood_proba and class probabilities by parcel; zones override, a corridor never does.
    A parcel without a row in ``heads`` stays, without a valid decision. With ``footprints`` (site_id, node_id, rings) a parcel is in a zone if
    any part of it is, else if its point is.

    A failing audit raises. Lift is reported only if every fused site has reference parcels.
    """
    placed = spatial.in_zone(parcels, zones) if footprints is None else parcels.join(spatial.footprints_in_zone(footprints, zones), ["site_id", "node_id"], "left").fillna(False, ["inside_zone"])
    joined = placed.join(heads.drop("inside_zone"), ["site_id", "node_id"], "left")
    decisions = settle(policy.decide_policy(joined))
    audit = policy.justice_audit(decisions)
    if not audit.first()["passes"]:
        raise RuntimeError("the justice audit failed")
    ref = decisions if reference is None else decisions.drop("inside_zone").join(reference.select("site_id", "node_id", F.col("in_reference").alias("inside_zone")), ["site_id", "node_id"], "left")
    covered = ref.groupBy("site_id").agg(F.count_if("inside_zone").alias("n")).filter("n = 0").limit(1).count() == 0
    out = {"decisions": decisions, "summary": policy.policy_summary(decisions), "audit": audit}
    return out | ({"lift": policy.action_lift(ref)} if covered else {})


def prepare_sites(parts: list[DataFrame], seed: int = 0) -> DataFrame:
    """Site tables (site_id, node_id, y, ...) as one with a flat id and a split inside each site and class."""
    whole = graph.union_sites(parts).withColumn("id", F.col("node_id"))
    return splits.stratified_split(whole, by_site=True, seed=seed).drop("id")


def evaluate_split(df: DataFrame, split: str) -> DataFrame:
    """The multiclass report of one split (y, pred), per site and pooled."""
    return metrics.class_report(df.filter(F.col("split") == split), by_site=True)


def site_report(df: DataFrame, targets: dict[str, float]) -> dict[str, DataFrame]:
    """Multiclass report per site and pooled, with a table of flags for each target score."""
    report = metrics.class_report(df, by_site=True)
    return {"report": report} | {score: metrics.target_flags(report, score, target) for score, target in targets.items()}
