"""The decision operator and what is reported about its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions import heads
from parcelrisk.functions.raster import argmax, clip
from parcelrisk.operators.metrics import agreement_columns


def decide_policy(parcels: DataFrame, flood_threshold: float = S.FLOOD_THRESHOLD, zone_overrides: bool = True) -> DataFrame:
    """One action per parcel (flood_proba, p_low, p_medium, p_high, inside_zone): one select, no shuffle.

    A zone lifts the policy's flood probability to 1, also where the model's is missing, but never where it is out of range. Index -1
    is insufficient evidence.
    """
    if not 0 < flood_threshold <= 1:
        raise ValueError("flood_threshold must lie in (0, 1]")
    p_in = [F.col(f"p_{c}") for c in S.CLASSES]
    inside = F.coalesce(F.col("inside_zone"), F.lit(False))
    missing = ~heads.finite(F.col("flood_proba"))
    d = parcels.withColumns({
        "_inside": inside,
        "_flood_ok": heads.flood_usable(F.col("flood_proba")),
        "_dep_ok": heads.class_usable(p_in),
        "_p": F.array(*heads.normalised(p_in)),
        "_missing": missing,
    }).withColumn("_f", F.when(F.col("_flood_ok"), clip(F.col("flood_proba"), 0.0, 1.0)))
    lifted = F.col("_inside") & F.lit(zone_overrides)
    d = d.withColumn("_pf", F.when(lifted & (F.col("_flood_ok") | F.col("_missing")), 1.0).otherwise(F.col("_f")))
    d = d.withColumns({"model_valid": F.col("_flood_ok") & F.col("_dep_ok"), "valid": F.col("_pf").isNotNull() & F.col("_dep_ok"), "_class": argmax(F.col("_p"))})
    d = d.withColumns({"model_flood_high": F.coalesce(F.col("model_valid") & (F.col("_f") >= flood_threshold), F.lit(False)), "policy_flood_high": F.coalesce(F.col("valid") & (F.col("_pf") >= flood_threshold), F.lit(False))})
    high = F.col("_p")[2]
    d = d.withColumns({"_model_raw": heads.matrix_action(F.col("model_flood_high"), F.col("_class")), "_raw": heads.matrix_action(F.col("policy_flood_high"), F.col("_class"))})
    none = lambda ok, c: F.when(ok, c).otherwise(-1)
    d = d.withColumns({
        "model_action_index": none(F.col("model_valid"), heads.gated(F.col("_model_raw"), high)),
        "matrix_action_index": none(F.col("valid"), F.col("_raw")),
        "action_index": none(F.col("valid"), heads.gated(F.col("_raw"), high)),
        "majority_gate_applied": F.col("valid") & heads.gate_applies(F.col("_raw"), high),
    })
    zero = F.array(*[F.lit(0.0)] * len(S.ACTIONS))
    p = [F.col("_p")[k] for k in range(3)]
    d = d.withColumns({"model_action_proba": F.when(F.col("model_valid"), heads.action_mass(F.col("_f"), p)).otherwise(zero), "action_proba": F.when(F.col("valid"), heads.action_mass(F.col("_pf"), p)).otherwise(zero)})
    responsive = lambda c: F.col(c).isin(S.RESILIENT, S.RESETTLE)
    d = d.withColumns({
        "confidence": F.when(F.col("action_index") >= 0, F.try_element_at(F.col("action_proba"), F.col("action_index") + 1)).otherwise(0.0),
        "override_applied": F.col("valid") & lifted & (F.col("action_index") != F.col("model_action_index")),
        "model_flood_responsive": responsive("model_action_index"),
        "flood_responsive": responsive("action_index"),
        "displacement": F.col("action_index") == S.RESETTLE,
        "deprivation_class": none(F.col("_dep_ok"), F.col("_class")),
    })
    keep = [c for c in parcels.columns if c not in ("flood_proba", "p_low", "p_medium", "p_high", "inside_zone")]
    fused = F.array(F.col("_f"), *[F.when(F.col("_dep_ok"), x) for x in p])
    return d.select(
        *keep, "valid", "model_valid", F.col("_f").alias("flood_proba"), *[x.alias(f"p_{c}") for x, c in zip(p, S.CLASSES, strict=True)], fused.alias("fused_features"), "deprivation_class",
        F.col("_inside").alias("inside_zone"), "model_flood_high", "policy_flood_high", "override_applied", "majority_gate_applied", "model_action_index", "matrix_action_index", "action_index", "action_proba",
        "model_action_proba", "confidence", "model_flood_responsive", "flood_responsive", "displacement",
    )


def policy_summary(decisions: DataFrame) -> DataFrame:
    """Per site and pooled (site_id NULL): counts and fractions per action, displacement, overrides, gates. Fractions are over valid parcels, the insufficient share over all."""
    counts = [F.count_if(F.col("action_index") == k).alias(name) for k, name in enumerate(S.ACTIONS)]
    s = decisions.rollup("site_id").agg(
        F.count("*").alias("parcels"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("insufficient"), *counts,
        F.count_if("displacement").alias("displaced"), F.count_if("override_applied").alias("overrides"), F.count_if("majority_gate_applied").alias("gated"),
    )
    share = lambda c: (F.col(c) / F.greatest("valid", F.lit(1))).alias(f"{c}_fraction")
    return s.select("*", *[share(a) for a in S.ACTIONS], share("displaced"), (F.col("insufficient") / F.greatest("parcels", F.lit(1))).alias("insufficient_fraction"))


def action_counts(decisions: DataFrame) -> DataFrame:
    """Count of every action, zeroes and insufficient evidence included."""
    names = decisions.sparkSession.range(-1, len(S.ACTIONS)).select(F.col("id").cast("int").alias("action_index"))
    counts = decisions.groupBy("action_index").agg(F.count("*").alias("n"))
    return names.join(counts, "action_index", "left").select("action_index", heads.action_name(F.col("action_index")).alias("action"), F.coalesce("n", F.lit(0)).alias("n"))


def justice_audit(decisions: DataFrame) -> DataFrame:
    """One row: displaced parcels that break a rule; passes if there are none."""
    moved = F.col("displacement")
    rules = {"not_high_class": F.col("deprivation_class") != 2, "no_majority": ~(F.col("p_high") > 0.5), "no_high_flood": ~F.col("policy_flood_high"), "not_valid": ~F.col("valid")}
    s = decisions.agg(F.count_if(moved).alias("displaced"), *[F.count_if(moved & r).alias(k) for k, r in rules.items()])
    return s.withColumn("passes", sum((F.col(k) for k in list(rules)[1:]), F.col("not_high_class")) == 0)


def action_lift(decisions: DataFrame, reference: Column | str = "inside_zone", bar: float = S.LIFT_BAR) -> DataFrame:
    """Whether flood-responsive actions concentrate in the reference: for the model's actions (before any override) and the policy's."""
    ref = F.col(reference) if isinstance(reference, str) else reference
    rows = []
    for name, label, mask in (("model", "model_flood_responsive", "model_valid"), ("policy", "flood_responsive", "valid")):
        a = decisions.filter(F.col(mask)).agg(*agreement_columns(F.col(label), ref), F.count("*").alias("rows"))
        rows.append(a.select(F.lit(name).alias("action_source"), "*"))
    both = rows[0].union(rows[1])
    return both.withColumn("meets_bar", F.coalesce((F.col("rows") > 0) & (F.col("reference_fraction") > 0) & (F.col("lift") > bar), F.lit(False)))
