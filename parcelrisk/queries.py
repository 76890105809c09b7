"""The operators over the derived tables, one query each, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.fixtures import fixture, with_fixtures
from parcelrisk.functions import geo, heads
from parcelrisk.functions import parcels as P
from parcelrisk.functions import raster as R
from parcelrisk.operators import features, graph, metrics, ml, policy, quantiles, raster, spatial, splits, tiles
from parcelrisk.plans import pipelines
from parcelrisk.sources import readers
from parcelrisk.sources.scratch import folder, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return register


def r(column: str | object, digits: int = 6):
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as sums of floats depend on the order of rows."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


# --- decisions -------------------------------------------------------------------------------------------------------------------

DECIDE = """
h AS (SELECT *, coalesce(flood_proba BETWEEN -1e-6 AND 1 + 1e-6, false) AS fok, greatest(0e0, least(1e0, p_low)) AS a, greatest(0e0, least(1e0, p_medium)) AS b, greatest(0e0, least(1e0, p_high)) AS c FROM parcel_heads),
g AS (SELECT *, coalesce(p_low >= -1e-6 AND p_medium >= -1e-6 AND p_high >= -1e-6 AND a + b + c > 1e-8, false) AS dok FROM h),
n AS (SELECT *, CASE WHEN dok THEN a / (a + b + c) ELSE 0e0 END AS q0, CASE WHEN dok THEN b / (a + b + c) ELSE 0e0 END AS q1, CASE WHEN dok THEN c / (a + b + c) ELSE 0e0 END AS q2,
  CASE WHEN fok THEN greatest(0e0, least(1e0, flood_proba)) END AS f FROM g),
m AS (SELECT *, CASE WHEN inside_zone AND (fok OR flood_proba IS NULL) THEN 1e0 ELSE f END AS pf, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS k FROM n),
v AS (SELECT *, fok AND dok AS model_valid, pf IS NOT NULL AND dok AS valid FROM m),
w AS (SELECT *, coalesce(model_valid AND f >= 0.5, false) AS mhigh, coalesce(valid AND pf >= 0.5, false) AS phigh FROM v),
x AS (SELECT *, CASE WHEN mhigh THEN CASE WHEN k = 2 THEN 4 ELSE 3 END ELSE k END AS mraw, CASE WHEN phigh THEN CASE WHEN k = 2 THEN 4 ELSE 3 END ELSE k END AS praw FROM w),
d AS (SELECT *, CASE WHEN NOT model_valid THEN -1 WHEN mraw = 4 AND NOT q2 > 0.5 THEN 3 ELSE mraw END AS mact, CASE WHEN NOT valid THEN -1 WHEN praw = 4 AND NOT q2 > 0.5 THEN 3 ELSE praw END AS pact FROM x),
decided AS (SELECT *, pact = 4 AS displacement, valid AND inside_zone AND pact <> mact AS override_applied, valid AND praw = 4 AND NOT q2 > 0.5 AS gate,
  CASE pact WHEN 0 THEN (1 - pf) * q0 WHEN 1 THEN (1 - pf) * q1 WHEN 2 THEN (1 - pf) * q2 WHEN 3 THEN pf * (q0 + q1) WHEN 4 THEN pf * q2 ELSE 0e0 END AS confidence FROM d)
"""
NAMES = "CASE {c} WHEN 0 THEN 'retain_formalise' WHEN 1 THEN 'retain_upgrade' WHEN 2 THEN 'in_situ_upgrade_priority' WHEN 3 THEN 'flood_resilient_upgrade' WHEN 4 THEN 'compensated_resettlement' ELSE 'insufficient_evidence' END"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decide_policy(fixture(spark, sf_dir, "parcel_heads"))


@query(f"WITH {DECIDE} SELECT site_id, node_id, valid, model_valid, round(f, 6) AS flood_proba, round(q0, 6) AS p_low, round(q1, 6) AS p_medium, round(q2, 6) AS p_high, CASE WHEN dok THEN k ELSE -1 END AS deprivation_class, inside_zone, mhigh AS model_flood_high, phigh AS policy_flood_high, override_applied, gate AS majority_gate_applied, mact AS model_action_index, CASE WHEN valid THEN praw ELSE -1 END AS matrix_action_index, pact AS action_index, round(confidence, 6) AS confidence, pact IN (3, 4) AS flood_responsive, mact IN (3, 4) AS model_flood_responsive, displacement, {NAMES.format(c='pact')} AS action FROM decided")
def policy_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    return rounded(d.drop("fused_features", "action_proba", "model_action_proba").withColumn("action", heads.action_name(F.col("action_index"))))


@query(f"WITH {DECIDE} SELECT node_id, round(f, 9) AS f0, CASE WHEN dok THEN round(q0, 9) END AS f1, CASE WHEN dok THEN round(q1, 9) END AS f2, CASE WHEN dok THEN round(q2, 9) END AS f3, round(CASE WHEN valid THEN (1 - pf) * q0 ELSE 0e0 END, 9) AS m0, round(CASE WHEN valid THEN (1 - pf) * q1 ELSE 0e0 END, 9) AS m1, round(CASE WHEN valid THEN (1 - pf) * q2 ELSE 0e0 END, 9) AS m2, round(CASE WHEN valid THEN pf * (q0 + q1) ELSE 0e0 END, 9) AS m3, round(CASE WHEN valid THEN pf * q2 ELSE 0e0 END, 9) AS m4 FROM decided")
def action_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(spark, sf_dir)
    return rounded(d.select("node_id", *[F.col("fused_features")[k].alias(f"f{k}") for k in range(4)], *[F.col("action_proba")[k].alias(f"m{k}") for k in range(5)]), 9)


SUMMARY = """t AS (SELECT site_id, count(*) AS parcels, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS insufficient, count(*) FILTER (pact = 0) AS retain_formalise, count(*) FILTER (pact = 1) AS retain_upgrade, count(*) FILTER (pact = 2) AS in_situ_upgrade_priority, count(*) FILTER (pact = 3) AS flood_resilient_upgrade, count(*) FILTER (pact = 4) AS compensated_resettlement, count(*) FILTER (displacement) AS displaced, count(*) FILTER (override_applied) AS overrides, count(*) FILTER (gate) AS gated FROM decided GROUP BY ROLLUP (site_id))
SELECT *, round(retain_formalise / greatest(valid, 1), 6) AS retain_formalise_fraction, round(retain_upgrade / greatest(valid, 1), 6) AS retain_upgrade_fraction, round(in_situ_upgrade_priority / greatest(valid, 1), 6) AS in_situ_upgrade_priority_fraction, round(flood_resilient_upgrade / greatest(valid, 1), 6) AS flood_resilient_upgrade_fraction, round(compensated_resettlement / greatest(valid, 1), 6) AS compensated_resettlement_fraction, round(displaced / greatest(valid, 1), 6) AS displaced_fraction, round(insufficient / greatest(parcels, 1), 6) AS insufficient_fraction FROM t"""


@query(f"WITH {DECIDE}, {SUMMARY}")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.policy_summary(decided(spark, sf_dir)))


@query(f"WITH {DECIDE}, i AS (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS action_index) SELECT i.action_index, {NAMES.format(c='i.action_index')} AS action, count(decided.pact) AS n FROM i LEFT JOIN decided ON decided.pact = i.action_index GROUP BY i.action_index")
def policy_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.action_counts(decided(spark, sf_dir))


@query(f"WITH {DECIDE} SELECT count(*) FILTER (displacement) AS displaced, count(*) FILTER (displacement AND k <> 2) AS not_high_class, count(*) FILTER (displacement AND NOT q2 > 0.5) AS no_majority, count(*) FILTER (displacement AND NOT phigh) AS no_high_flood, count(*) FILTER (displacement AND NOT valid) AS not_valid, count(*) FILTER (displacement AND (k <> 2 OR NOT q2 > 0.5 OR NOT phigh OR NOT valid)) = 0 AS passes FROM decided")
def policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.justice_audit(decided(spark, sf_dir))


AGREE = "round(tp / (tp + fp + fn + 1e-9), 6) AS iou, round(tp / (tp + fp + 1e-9), 6) AS precision, round(tp / (tp + fn + 1e-9), 6) AS recall, round(2 * tp / (2 * tp + fp + fn + 1e-9), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn + 1e-9), 6) AS label_fraction, round((tp + fn) / (tp + fp + fn + tn + 1e-9), 6) AS reference_fraction, round(tp / (tp + fp + 1e-9) / ((tp + fn) / (tp + fp + fn + tn + 1e-9) + 1e-9), 6) AS lift"
COUNTS = "count(*) FILTER ({ok} AND {a} AND {b}) AS tp, count(*) FILTER ({ok} AND {a} AND NOT {b}) AS fp, count(*) FILTER ({ok} AND NOT {a} AND {b}) AS fn, count(*) FILTER ({ok} AND NOT {a} AND NOT {b}) AS tn"


@query(f"""WITH {DECIDE}, c AS (SELECT 'model' AS action_source, {COUNTS.format(ok='model_valid', a='mact IN (3, 4)', b='inside_zone')}, count(*) FILTER (model_valid) AS rows FROM decided
UNION ALL SELECT 'policy', {COUNTS.format(ok='valid', a='pact IN (3, 4)', b='inside_zone')}, count(*) FILTER (valid) FROM decided) SELECT action_source, tp, fp, fn, tn, {AGREE}, rows, rows > 0 AND tp + fn > 0 AND tp / (tp + fp + 1e-9) / ((tp + fn) / (tp + fp + fn + tn + 1e-9) + 1e-9) > 1 AS meets_bar FROM c""")
def policy_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policy.action_lift(decided(spark, sf_dir)))


# --- metrics ---------------------------------------------------------------------------------------------------------------------

PAIR = {"ok": "valid", "a": "(label > 0.5)", "b": "(reference > 0)"}


@query(f"WITH c AS (SELECT site, {COUNTS.format(**PAIR)} FROM label_pairs GROUP BY site) SELECT site, tp, fp, fn, tn, {AGREE} FROM c")
def agreement_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.agreement(fixture(spark, sf_dir, "label_pairs"), ["site"], F.col("label") > 0.5, F.col("reference") > 0, F.col("valid")))


@query(f"WITH c AS (SELECT 'first' AS label_name, {COUNTS.format(**PAIR)} FROM label_pairs UNION ALL SELECT 'second', {COUNTS.format(**PAIR | {'a': '(other_label > 0.5)'})} FROM label_pairs) SELECT label_name, tp, fp, fn, tn, {AGREE} FROM c")
def compare_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compare_labels(fixture(spark, sf_dir, "label_pairs"), {"first": F.col("label") > 0.5, "second": F.col("other_label") > 0.5}, F.col("reference") > 0, F.col("valid")))


PIXEL = "round(tp / (tp + fp + fn + 1e-7), 6) AS iou, round(2 * tp / (2 * tp + fp + fn + 1e-7), 6) AS f1, round(2 * tp / (2 * tp + fp + fn + 1e-7), 6) AS dice, round(tp / (tp + fp + 1e-7), 6) AS precision, round(tp / (tp + fn + 1e-7), 6) AS recall"


@query(f"WITH c AS (SELECT site AS site_id, {COUNTS.format(**PAIR)} FROM label_pairs GROUP BY ROLLUP (site)) SELECT site_id, tp, fp, fn, tn, {PIXEL} FROM c")
def binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "label_pairs").withColumn("site_id", F.col("site"))
    return rounded(metrics.binary_report(d.groupBy("site_id").agg(*metrics.counts(F.col("label") > 0.5, F.col("reference") > 0, F.col("valid")))))


@query("WITH g AS (SELECT a.y, b.y AS pred FROM (VALUES (0), (1), (2)) a(y), (VALUES (0), (1), (2)) b(y)) SELECT g.y, g.pred, count(p.id) AS n FROM g LEFT JOIN class_pairs p ON p.y = g.y AND p.pred = g.pred GROUP BY g.y, g.pred")
def multiclass_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multiclass_confusion(fixture(spark, sf_dir, "class_pairs"))


_K = ", ".join(f"count(*) FILTER (y = {k} AND pred = {k}) AS tp{k}, count(*) FILTER (y <> {k} AND pred = {k}) AS fp{k}, count(*) FILTER (y = {k} AND pred <> {k}) AS fn{k}" for k in range(3))
_PR = [(f"(tp{k} / (tp{k} + fp{k} + 1e-9))", f"(tp{k} / (tp{k} + fn{k} + 1e-9))") for k in range(3)]
_F1 = [f"2 * {p} * {q} / ({p} + {q} + 1e-9)" for p, q in _PR]
REPORT = f"c AS (SELECT site_id, count(*) AS n, count(*) FILTER (y = pred) AS correct, {_K} FROM class_pairs GROUP BY ROLLUP (site_id)), report AS (SELECT site_id, n, round(correct / (n + 1e-9), 6) AS accuracy, round(({' + '.join(_F1)}) / 3, 6) AS macro_f1, {', '.join(f'round({f}, 6) AS f1_{k}' for k, f in enumerate(_F1))}, {', '.join(f'tp{k} + fn{k} AS support_{k}' for k in range(3))} FROM c)"


@query(f"WITH {REPORT} SELECT * FROM report")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(fixture(spark, sf_dir, "class_pairs"), by_site=True))


@query(f"WITH {REPORT} SELECT site_id, macro_f1, macro_f1 >= 0.7 AS meets, (SELECT bool_and(macro_f1 >= 0.7) FROM report WHERE site_id IS NOT NULL) AS all_sites_meet FROM report")
def target_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.target_flags(rounded(metrics.class_report(fixture(spark, sf_dir, "class_pairs"), by_site=True)), "macro_f1", 0.7)


@query("""WITH p AS (SELECT site, id % 7 AS t, label AS y, greatest(least(score, 1 - 1e-7), 1e-7) AS q, score FROM label_pairs),
t AS (SELECT site, t, sum(score * y) AS pt, sum(score) AS sp, sum(y) AS st, sum(-(y * ln(q) + (1 - y) * ln(1 - q))) AS e, count(*) AS n FROM p GROUP BY site, t)
SELECT round(sum(e) / sum(n), 6) AS bce, round(avg(1 - (2 * pt + 1) / (sp + st + 1)), 6) AS dice_loss, round(0.5 * sum(e) / sum(n) + 0.5 * avg(1 - (2 * pt + 1) / (sp + st + 1)), 6) AS loss FROM t""")
def tile_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "label_pairs").withColumn("t", F.col("id") % 7)
    return rounded(metrics.tile_loss(d, ["site", "t"], "score", "label"))


@query("""WITH k AS (SELECT site, score, reference, rank() OVER (PARTITION BY site ORDER BY score) + (count(*) OVER (PARTITION BY site, score) - 1) / 2 AS rk FROM label_pairs),
s AS (SELECT site, sum(rk) FILTER (reference > 0) AS rs, count(*) FILTER (reference > 0) AS positives, count(*) AS n FROM k GROUP BY site)
SELECT site, CASE WHEN positives > 0 AND positives < n THEN round((rs - positives * (positives + 1) / 2) / (positives * (n - positives)), 6) END AS auc, positives, n FROM s""")
def auc_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(fixture(spark, sf_dir, "label_pairs"), ["site"], "score", "reference"))


@query("WITH t AS (SELECT count(*) AS total FROM class_pairs) SELECT y, count(*) AS n, round(count(*) / any_value(total), 6) AS fraction FROM class_pairs, t GROUP BY y")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_distribution(fixture(spark, sf_dir, "class_pairs"), "y"))


@query("WITH t AS (SELECT y, sum(count(*)) OVER () / count(*) AS raw FROM class_pairs GROUP BY y) SELECT y, round(raw / avg(raw) OVER (), 6) AS weight FROM t")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_weights(fixture(spark, sf_dir, "class_pairs"), "y"))


@query("SELECT site, round(avg(reference::DOUBLE), 6) AS baseline_iou FROM label_pairs WHERE valid GROUP BY site")
def flooded_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.flooded_baseline(fixture(spark, sf_dir, "label_pairs").filter("valid"), ["site"], "reference"))


# --- parcel features -------------------------------------------------------------------------------------------------------------

ROOF = "CASE roof_material WHEN 'Wood' THEN 0.55e0 WHEN 'metal;thatch' THEN 0.85e0 WHEN ' tin ' THEN 0.3e0 WHEN 'concrete' THEN 0e0 ELSE 0.5e0 END"


@query(f"SELECT site_id, node_id, {ROOF} AS roof_score FROM parcel")
def roof_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "parcel").select("site_id", "node_id", P.roof_score(F.col("roof_material")).alias("roof_score"))


def _near(c: str) -> str:
    return f"near_{c} AS (SELECT p.site_id, p.node_id, min(sqrt((p.x - i.x) ** 2 + (p.y - i.y) ** 2)) AS d FROM parcel p LEFT JOIN infra i ON i.site_id = p.site_id AND i.category = '{c}' GROUP BY p.site_id, p.node_id)"


DIST = ", ".join(map(_near, ("water", "sanitation", "road")))
ENRICHED = f"""{DIST}, e AS (SELECT p.*, coalesce(w.d, max(w.d) OVER (PARTITION BY p.site_id), 0) AS dw, coalesce(s.d, max(s.d) OVER (PARTITION BY p.site_id), 0) AS ds, coalesce(r.d, max(r.d) OVER (PARTITION BY p.site_id), 0) AS dr, {ROOF} AS roof
  FROM parcel p JOIN near_water w USING (site_id, node_id) JOIN near_sanitation s USING (site_id, node_id) JOIN near_road r USING (site_id, node_id)),
scored AS (SELECT *, (least(dw / 200, 1) + least(ds / 200, 1) + least(dr / 50, 1) + least(25 / greatest(area_m2, 1e-6), 1) + roof) / 5 AS score FROM e)"""


@query(f"WITH {_near('water')} SELECT site_id, node_id, round(d, 6) AS dist_water_m FROM near_water")
def nearest_infra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "infra"), "water"))


@query(f"WITH {_near('sanitation')} SELECT site_id, node_id, round(coalesce(d, max(d) OVER (PARTITION BY site_id), 0), 6) AS dist_sanitation_m FROM near_sanitation")
def impute_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spatial.nearest(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "infra"), "sanitation")
    return rounded(spatial.impute(d, "dist_sanitation_m").select("site_id", "node_id", "dist_sanitation_m"))


@query(f"WITH {ENRICHED}, q AS (SELECT site_id, quantile_cont(score, 1 / 3) AS c1, quantile_cont(score, 2 / 3) AS c2, min(score) AS lo, max(score) AS hi FROM scored GROUP BY site_id) SELECT s.site_id, s.node_id, round(dw, 6) AS dist_to_water_m, round(ds, 6) AS dist_to_sanitation_m, round(dr, 6) AS dist_to_road_m, roof AS roof_score, round(score, 6) AS score, CASE WHEN hi <= lo THEN 0 ELSE (score >= c1)::INT + (score >= c2)::INT END AS severity FROM scored s JOIN q USING (site_id)")
def severity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features.enrich(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "infra"))
    return rounded(d.select("site_id", "node_id", *features.DISTANCES.values(), "roof_score", "score", "severity"))


@query("SELECT site_id, node_id, round((area_m2 - avg(area_m2) OVER w) / greatest(stddev_samp(area_m2) OVER w, 1e-6), 6) AS z_area_m2, round((x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 1e-6), 6) AS z_x FROM parcel WINDOW w AS (PARTITION BY site_id)")
def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.standardise(fixture(spark, sf_dir, "parcel"), ["area_m2", "x"], ["site_id"]).select("site_id", "node_id", "z_area_m2", "z_x"))


# --- rasters ---------------------------------------------------------------------------------------------------------------------


@query("SELECT site_id, \"row\", col, round(median(vv), 6) AS median_vv, min(vv) AS min_vv FROM scene_obs WHERE (qa & 3072) = 0 GROUP BY site_id, \"row\", col")
def composite_median_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "scene_obs").filter(R.clear_sky(F.col("qa")))
    return rounded(raster.composite(d, "vv", "median", "median_vv").join(raster.composite(d, "vv", "min", "min_vv"), raster.PIXEL))


@query("SELECT qa, count(*) AS n, count(*) FILTER ((qa & 3072) = 0) AS clear, round(sum(CASE WHEN (qa & 3072) = 0 THEN vv / 10000 END), 6) AS scaled FROM scene_obs GROUP BY qa")
def cloud_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "scene_obs")
    return rounded(d.groupBy("qa").agg(F.count("*").alias("n"), F.count_if(R.clear_sky(F.col("qa"))).alias("clear"), F.sum(R.reflectance(F.col("qa"), F.col("vv"))).alias("scaled")))


@query("SELECT site_id, month(ts) AS m, count(*) AS n FROM scene_obs WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1998-01-01' AND month(ts) IN (3, 4, 5, 10, 11) AND (qa * 7 % 41) <= 20 GROUP BY site_id, month(ts)")
def scene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = R.scene_filter(F.col("ts"), (F.col("qa") * 7 % 41).cast("double"), F.lit("IW"), F.array(F.lit("VV"), F.lit("VH")), "1995-01-01 00:00:00", "1998-01-01 00:00:00", S.RAINY_MONTHS)
    return fixture(spark, sf_dir, "scene_obs").filter(keep).groupBy("site_id", F.month("ts").alias("m")).agg(F.count("*").alias("n"))


PAIRED = 'pair AS (SELECT site_id, "row", col, median(vv) FILTER (NOT is_event) AS pre_vv, median(vv) FILTER (is_event) AS event_vv FROM scene_obs GROUP BY site_id, "row", col), ch AS (SELECT *, event_vv - pre_vv AS change FROM pair)'
HIST = """span AS (SELECT site_id, min(change) AS lo, max(change) AS hi FROM {src} WHERE change IS NOT NULL GROUP BY site_id),
hist AS (SELECT site_id, lo, hi, coalesce(least(floor((change - lo) / ((hi - lo) / 256)), 255), 0)::INT AS bin, count(*) AS n FROM {src} JOIN span USING (site_id) WHERE change IS NOT NULL GROUP BY ALL),
mid AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS m FROM hist),
cum AS (SELECT *, sum(n) OVER w AS nb, sum(n * m) OVER w AS sb, sum(n) OVER e AS na, sum(n * m) OVER e AS sa FROM mid WINDOW w AS (PARTITION BY site_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY site_id)),
btw AS (SELECT *, round(nb * (na - nb) * (sb / nb - (sa - sb) / (na - nb)) ** 2, 6) AS b FROM cum WHERE na > nb),
thr AS (SELECT site_id, arg_max(lo + (bin + 1) * ((hi - lo) / 256), struct_pack(b := b, k := -bin)) AS threshold FROM btw GROUP BY site_id)"""


@query(f'WITH {PAIRED} SELECT site_id, "row", col, round(change, 6) AS change, coalesce(change <= -3, false) AS dropped FROM ch')
def change_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.event_pair(fixture(spark, sf_dir, "scene_obs"))
    return rounded(d.select(*raster.PIXEL, "change", R.below(F.col("change"), S.FLOOD_DB).alias("dropped")))


@query(f"WITH {PAIRED}, {HIST.format(src='ch')} SELECT site_id, bin, n FROM hist")
def change_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.histogram(raster.event_pair(fixture(spark, sf_dir, "scene_obs")), "change").select("site_id", "bin", "n")


@query(f"WITH {PAIRED}, {HIST.format(src='ch')} SELECT site_id, round(threshold, 6) AS threshold FROM thr")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.otsu(raster.event_pair(fixture(spark, sf_dir, "scene_obs")), "change"))


DROPS = f"{PAIRED}, neg AS (SELECT * FROM ch WHERE change < 0), {HIST.format(src='neg')}, chosen AS (SELECT s.site_id, CASE WHEN n >= 2 AND kinds >= 2 AND threshold < 0 THEN threshold ELSE -3e0 END AS threshold, CASE WHEN n >= 2 AND kinds >= 2 AND threshold < 0 THEN 'otsu' ELSE 'fixed' END AS source FROM (SELECT site_id, count(*) FILTER (change < 0) AS n, count(DISTINCT change) FILTER (change < 0) AS kinds FROM ch GROUP BY site_id) s LEFT JOIN thr USING (site_id))"


@query(f"WITH {DROPS} SELECT site_id, round(threshold, 6) AS threshold, source FROM chosen")
def drop_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.drop_threshold(raster.event_pair(fixture(spark, sf_dir, "scene_obs"))))


BLOBS = """m AS (SELECT site_id, "row", col FROM {src}), adj AS (SELECT a.site_id, a.row AS r, a.col AS c, b.row AS r2, b.col AS c2 FROM m a JOIN m b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT site_id, r, c, r2, c2 FROM adj UNION SELECT p.site_id, p.r, p.c, q.r2, q.c2 FROM reach p JOIN adj q ON p.site_id = q.site_id AND p.r2 = q.r AND p.c2 = q.c),
kept AS (SELECT site_id, r AS "row", c AS col FROM reach GROUP BY site_id, r, c HAVING count(*) >= 8)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.event_pair(fixture(spark, sf_dir, "scene_obs")).drop("change").join(fixture(spark, sf_dir, "terrain"), raster.PIXEL, "left")


STEPS = f"{DROPS}, st AS (SELECT ch.*, chosen.threshold, chosen.source, coalesce(change <= threshold, false) AS s1, t.slope, t.occurrence FROM ch JOIN chosen USING (site_id) LEFT JOIN terrain t USING (site_id, \"row\", col)), s2 AS (SELECT *, s1 AND NOT coalesce(slope > 5, false) AS f2 FROM st), s3 AS (SELECT *, f2 AND NOT coalesce(occurrence >= 50, false) AS f3 FROM s2)"
EVENT = f"{STEPS}, left3 AS (SELECT * FROM s3 WHERE f3), {BLOBS.format(src='left3')}"
_WET = 'wet AS (SELECT a.site_id, a.row, a.col, a.elevation, a.slope, avg(b.elevation) AS focal FROM terrain a JOIN terrain b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9 GROUP BY ALL), twi AS (SELECT site_id, "row", col, ln(greatest(focal - elevation, 0.01) / greatest(tan(coalesce(slope, 0) * (3.14159265 / 180)), 0.001)) AS twi FROM wet)'


@query(f"WITH RECURSIVE {EVENT}, k AS (SELECT site_id, count(*) AS after_blobs FROM kept GROUP BY site_id), z AS (SELECT site_id, threshold, source, count(*) FILTER (s1) AS after_threshold, count(*) FILTER (f2) AS after_slope, count(*) FILTER (f3) AS after_water, count(change) AS valid_pixels FROM s3 GROUP BY site_id, threshold, source) SELECT site_id, round(threshold, 6) AS threshold, source, after_threshold, after_slope, after_water, coalesce(after_blobs, 0) AS after_blobs, valid_pixels, round(coalesce(after_blobs, 0) / greatest(valid_pixels, 1), 6) AS flooded_fraction FROM z LEFT JOIN k USING (site_id)")
def event_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.event_flood_label(settle(pixels(spark, sf_dir)))[1])


@query("WITH RECURSIVE wet AS (SELECT site_id, \"row\", col FROM terrain WHERE coalesce(occurrence < 22, false)), " + BLOBS.format(src="wet") + ' SELECT site_id, "row", col FROM kept')
def small_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.small_blobs_dropped(fixture(spark, sf_dir, "terrain").filter("occurrence < 22"))


@query('WITH v AS (SELECT DISTINCT a.site_id, a.row, a.col, b.row AS r2, b.col AS c2, b.elevation FROM terrain a JOIN terrain b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9) SELECT site_id, "row", col, round(avg(elevation), 6) AS focal FROM v GROUP BY ALL')
def focal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.focal_mean(fixture(spark, sf_dir, "terrain"), "elevation", 3).select(*raster.PIXEL, "focal"))


@query('WITH v AS (SELECT a.site_id, a.row, a.col, a.elevation, a.slope, avg(b.elevation) AS focal FROM terrain a JOIN terrain b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9 GROUP BY ALL) SELECT site_id, "row", col, round(ln(greatest(focal - elevation, 0.01) / greatest(tan(coalesce(slope, 0) * (3.14159265 / 180)), 0.001)), 5) AS twi FROM v')
def wetness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.wetness_index(fixture(spark, sf_dir, "terrain")), 5)


SEASONAL = f"""ch AS (SELECT site_id, "row", col, min(vv) AS change FROM scene_obs WHERE month(ts) IN (3, 4, 5, 10, 11) GROUP BY ALL), {HIST.format(src='ch')},
tot AS (SELECT site_id, coalesce(least(floor((change - lo) / ((hi - lo) / 256)), 255), 0)::INT AS bin, avg(change) AS mean FROM ch JOIN span USING (site_id) GROUP BY ALL),
best AS (SELECT site_id, arg_max(bin, struct_pack(b := b, k := -bin)) AS bin FROM btw GROUP BY site_id),
season AS (SELECT ch.site_id, ch.row, ch.col, (change < mean - 1e-9)::INT AS flood FROM ch JOIN best USING (site_id) JOIN tot ON tot.site_id = best.site_id AND tot.bin = best.bin)"""


@query(f"WITH {SEASONAL} SELECT * FROM season")
def seasonal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.seasonal_flood_label(fixture(spark, sf_dir, "scene_obs"))


@query(f'WITH {PAIRED} SELECT site_id, "row", col, round(pre_vv, 6) AS pre_vv, round(event_vv, 6) AS event_vv, t.slope, t.occurrence, round(t.elevation, 6) AS elevation FROM pair LEFT JOIN terrain t USING (site_id, "row", col)')
def label_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipelines.label_ingredients(fixture(spark, sf_dir, "scene_obs"), fixture(spark, sf_dir, "terrain")))


@query(f"WITH RECURSIVE {EVENT} SELECT site_id, round(avg((pre_vv IS NULL)::INT), 6) AS missing_pre_vv, round(avg((slope IS NULL)::INT), 6) AS missing_slope, round(avg(CASE WHEN kept.row IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS flooded FROM s3 LEFT JOIN kept USING (site_id, \"row\", col) GROUP BY site_id")
def stack_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = settle(pixels(spark, sf_dir))
    stack = raster.build_stack({"px": px}, raster.event_flood_label(px)[0], "event")
    return rounded(raster.stack_profile(stack, ["pre_vv", "slope"], "flood_label").drop("labels"))


# --- graphs ----------------------------------------------------------------------------------------------------------------------

EDGES = "edge AS (SELECT a.site_id, a.node_id AS src, b.node_id AS dst FROM parcel a JOIN parcel b ON a.site_id = b.site_id AND a.node_id < b.node_id AND abs(a.x - b.x) <= 15 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 225), both_ways AS (SELECT * FROM edge UNION ALL SELECT site_id, dst, src FROM edge)"
COMP = f"{EDGES}, reach AS (SELECT site_id, node_id, node_id AS far FROM parcel UNION SELECT r.site_id, r.node_id, b.dst FROM reach r JOIN both_ways b ON b.site_id = r.site_id AND b.src = r.far), comp AS (SELECT site_id, node_id, min(far) AS component FROM reach GROUP BY site_id, node_id)"


def parcel_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = fixture(spark, sf_dir, "parcel")
    return nodes, graph.proximity_edges(nodes)


@query(f"WITH {EDGES} SELECT * FROM edge")
def proximity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcel_graph(spark, sf_dir)[1]


@query(f"WITH {EDGES} SELECT p.site_id, p.node_id, count(b.dst) AS degree FROM parcel p LEFT JOIN both_ways b ON b.site_id = p.site_id AND b.src = p.node_id GROUP BY p.site_id, p.node_id")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*parcel_graph(spark, sf_dir))


@query(f"WITH {EDGES} SELECT p.site_id, p.node_id FROM parcel p LEFT JOIN both_ways b ON b.site_id = p.site_id AND b.src = p.node_id WHERE b.dst IS NULL ORDER BY p.site_id, p.node_id LIMIT 20")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.isolated_sample(*parcel_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {COMP} SELECT * FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*parcel_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {COMP}, z AS (SELECT site_id, component, count(*) AS n FROM comp GROUP BY ALL), y AS (SELECT site_id, count(*) AS components, max(n) AS largest, sum(n) AS nodes FROM z GROUP BY site_id), e AS (SELECT site_id, count(*) AS edges FROM edge GROUP BY site_id), i AS (SELECT p.site_id, count(*) AS isolated FROM parcel p WHERE NOT EXISTS (SELECT 1 FROM both_ways b WHERE b.site_id = p.site_id AND b.src = p.node_id) GROUP BY p.site_id) SELECT site_id, nodes::BIGINT AS nodes, coalesce(edges, 0) AS edges, components, coalesce(isolated, 0) AS isolated, round(largest / nodes, 6) AS largest_share FROM y LEFT JOIN e USING (site_id) LEFT JOIN i USING (site_id)")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = parcel_graph(spark, sf_dir)
    edges = settle(edges)  # read for the components and after them
    return rounded(graph.integrity(nodes, edges, graph.components(nodes, edges)))


@query(f"WITH RECURSIVE {COMP}, big AS (SELECT site_id, component FROM comp GROUP BY ALL HAVING count(*) >= 20) SELECT site_id, node_id, count(b.dst) AS degree FROM comp JOIN big USING (site_id, component) LEFT JOIN both_ways b ON b.site_id = comp.site_id AND b.src = comp.node_id GROUP BY comp.site_id, node_id")
def pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = parcel_graph(spark, sf_dir)
    edges = settle(edges)  # read for the components and after them
    return graph.degrees(*graph.prune(nodes, edges, graph.components(nodes, edges)))


@query(f"WITH {EDGES} SELECT p.site_id, p.node_id, round(coalesce(avg(q.area_m2), 0), 9) AS mean_area_m2, round(coalesce(avg(q.x), 0), 9) AS mean_x FROM parcel p LEFT JOIN both_ways b ON b.site_id = p.site_id AND b.src = p.node_id LEFT JOIN parcel q ON q.site_id = b.site_id AND q.node_id = b.dst GROUP BY p.site_id, p.node_id")
def neighbour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.neighbour_mean(*parcel_graph(spark, sf_dir), ["area_m2", "x"]).select("site_id", "node_id", "mean_area_m2", "mean_x"), 9)


@query("SELECT site_id, node_id, row_number() OVER (ORDER BY site_id, node_id) - 1 AS flat_id FROM parcel")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.union_sites([fixture(spark, sf_dir, "parcel")]).select("site_id", "node_id", "flat_id")  # its sites are parts of one table


@query("SELECT site_id, CASE site_id WHEN 0 THEN 'present' WHEN 1 THEN 'aligned' ELSE 'replaced' END AS status FROM parcel GROUP BY site_id")
def align_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "parcel")
    old = p.withColumn("x", F.when(F.col("site_id") == 0, F.col("x")))
    return graph.align_positions(old, p.withColumn("area_m2", F.col("area_m2") + F.when(F.col("site_id") == 2, 1.0).otherwise(1e-6)), ["area_m2"])


# --- splits and tiles ------------------------------------------------------------------------------------------------------------


def _split_sql(keys: str, seed: str) -> str:
    return f"WITH c AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS size, row_number() OVER (PARTITION BY {keys} ORDER BY (id * 7919 + {seed}) % 1000003, id) AS k FROM class_pairs), b AS (SELECT *, round_even(size * 0.6, 0) AS a, greatest(least(round_even(size * 0.2, 0), size - round_even(size * 0.6, 0)), 0) AS v FROM c) SELECT site_id, id, y, CASE WHEN k <= a THEN 'train' WHEN k <= a + v THEN 'val' ELSE 'test' END AS split FROM b"


@query(_split_sql("y", "0"))
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(fixture(spark, sf_dir, "class_pairs")).select("site_id", "id", "y", "split")


@query(_split_sql("site_id, y", "site_id"))
def stratified_split_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(fixture(spark, sf_dir, "class_pairs"), by_site=True).select("site_id", "id", "y", "split")


@query(f"WITH sp AS ({_split_sql('site_id, y', 'site_id')}), f AS (SELECT site_id, id, row_number() OVER (ORDER BY site_id, id) - 1 AS flat_id FROM class_pairs) SELECT site_id, id AS node_id, y, flat_id, split FROM sp JOIN f USING (site_id, id)")
def prepared_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "class_pairs").withColumnRenamed("id", "node_id")
    return pipelines.prepare_sites([d]).select("site_id", "node_id", "y", "flat_id", "split")


@query(f"WITH sp AS ({_split_sql('site_id, y', 'site_id')}), {REPORT.replace('FROM class_pairs', 'FROM (SELECT p.* FROM class_pairs p JOIN sp USING (site_id, id) WHERE split = ' + repr('test') + ') t')} SELECT * FROM report")
def split_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipelines.evaluate_split(splits.stratified_split(fixture(spark, sf_dir, "class_pairs"), by_site=True), "test"))


@query("WITH l AS (SELECT DISTINCT site_id, row_off, col_off FROM manifest), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY row_off, col_off) AS i, count(*) OVER (PARTITION BY site_id) AS n FROM l) SELECT m.site_id, entry_id, CASE WHEN i = n THEN 'val' ELSE 'train' END AS split FROM manifest m JOIN k USING (site_id, row_off, col_off)")
def spatial_holdout_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout_one(fixture(spark, sf_dir, "manifest")).select("site_id", "entry_id", "split")


@query("WITH l AS (SELECT DISTINCT site_id, row_off, col_off FROM manifest), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ((row_off * 10007 + col_off)::BIGINT * 7919) % 1000003, row_off, col_off) AS i, count(*) OVER (PARTITION BY site_id) AS n FROM l) SELECT m.site_id, entry_id, CASE WHEN i <= least(greatest(round_even(n * 0.25, 0), 1), n - 1) THEN 'val' ELSE 'train' END AS split FROM manifest m JOIN k USING (site_id, row_off, col_off) WHERE n >= 2")
def spatial_holdout_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "manifest").withColumn("row_off", F.col("row_off").cast("long"))
    return splits.holdout_sites(m).select("site_id", "entry_id", "split")


@query("WITH h AS (SELECT *, max((variant = 'orig')::INT) OVER (PARTITION BY site_id, row_off, col_off) AS has FROM manifest) SELECT site_id, entry_id, variant FROM h WHERE has = 0 OR variant = 'orig'")
def prefer_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.prefer_original(fixture(spark, sf_dir, "manifest")).select("site_id", "entry_id", "variant")


@query("WITH e AS (SELECT site_id, row_off, col_off, count(DISTINCT nullif(entry_id % 4, 3)) AS n, bool_or(entry_id % 4 = 3) AS without FROM manifest GROUP BY ALL) SELECT site_id, count(*) AS ids, count(*) FILTER (n > 1) AS shared, count(*) FILTER (without) AS missing, count(*) FILTER (n > 1) = 0 AS exclusive, count(*) FILTER (without) = 0 AS complete FROM e GROUP BY site_id")
def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("entry_id") % 4 < 3, F.array(F.lit("train"), F.lit("val"), F.lit("test"))[(F.col("entry_id") % 4).cast("int")])
    return splits.check_split(fixture(spark, sf_dir, "manifest").withColumn("split", split), ["row_off", "col_off"])


@query("SELECT site_id, row_off, col_off, min(entry_id) AS entry_id FROM manifest WHERE variant = 'orig' GROUP BY ALL")
def first_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.first_original(fixture(spark, sf_dir, "manifest")).select("site_id", "row_off", "col_off", "entry_id")


@query("SELECT DISTINCT site_id, row_off, col_off FROM manifest ORDER BY ALL")
def tile_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.locations(fixture(spark, sf_dir, "manifest"))


TILED = 'ext AS (SELECT site_id, max("row") + 1 AS h, max(col) + 1 AS w FROM terrain GROUP BY site_id), ax AS (SELECT unnest(range(0, 8)) AS k), tiled AS (SELECT t.*, a.k * 12 AS tile_row_off, b.k * 12 AS tile_col_off, t.row - a.k * 12 AS local_row, t.col - b.k * 12 AS local_col FROM terrain t JOIN ext USING (site_id) JOIN ax a ON t.row BETWEEN a.k * 12 AND a.k * 12 + 15 AND a.k * 12 + 16 <= h JOIN ax b ON t.col BETWEEN b.k * 12 AND b.k * 12 + 15 AND b.k * 12 + 16 <= w)'


def tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tile(fixture(spark, sf_dir, "terrain"), 16, 4)


@query(f"WITH {TILED} SELECT site_id, tile_row_off, tile_col_off, round(count(*) FILTER (elevation IS NOT NULL AND slope IS NOT NULL AND (elevation <> 0 OR slope <> 0)) / 256, 6) AS valid_fraction FROM tiled GROUP BY ALL")
def tile_valid_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tiles.valid_fractions(tiled(spark, sf_dir), ["elevation", "slope"], 16))


@query(f'WITH {TILED}, q AS (SELECT site_id, tile_row_off, tile_col_off, quantile_cont(slope, 0.01) AS lo, quantile_cont(slope, 0.99) AS hi FROM tiled GROUP BY ALL) SELECT site_id, tile_row_off, tile_col_off, local_row, local_col, round(CASE WHEN hi > lo THEN CASE WHEN slope < lo THEN 0 WHEN slope > hi THEN 1 ELSE (slope - lo) / (hi - lo) END WHEN slope IS NOT NULL THEN 0 END, 6) AS slope FROM tiled JOIN q USING (site_id, tile_row_off, tile_col_off)')
def tile_scaled_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tiles.scale_bands(tiled(spark, sf_dir), ["slope"])
    return rounded(d.select(*tiles.TILE_KEY, "local_row", "local_col", "slope"))


@query(f"WITH {TILED}, v AS (SELECT 'orig' AS variant, local_row AS a, local_col AS b, elevation FROM tiled UNION ALL SELECT 'flip_h', local_row, 15 - local_col, elevation FROM tiled UNION ALL SELECT 'flip_v', 15 - local_row, local_col, elevation FROM tiled UNION ALL SELECT 'rot90', 15 - local_col, local_row, elevation FROM tiled) SELECT variant, a AS local_row, b AS local_col, count(*) AS n, round(sum(elevation), 4) AS total FROM v GROUP BY ALL")
def augmented_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tiles.augment(tiled(spark, sf_dir), 16)
    return rounded(d.groupBy("variant", "local_row", "local_col").agg(F.count("*").alias("n"), F.sum("elevation").alias("total")), 4)


SAFE = "train AS (SELECT DISTINCT site_id, (row_off / 206)::INT * 12 AS ro, (col_off / 206)::INT * 12 AS co FROM manifest WHERE entry_id % 5 < 2 AND row_off < 500), safe AS (SELECT t.* FROM terrain t WHERE NOT EXISTS (SELECT 1 FROM train k WHERE k.site_id = t.site_id AND t.row BETWEEN k.ro AND k.ro + 15 AND t.col BETWEEN k.co AND k.co + 15))"


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixture(spark, sf_dir, "manifest").filter("entry_id % 5 < 2 AND row_off < 500")
    return m.select("site_id", (F.col("row_off") / 206).cast("int").alias("a"), (F.col("col_off") / 206).cast("int").alias("b")).select("site_id", (F.col("a") * 12).alias("row_off"), (F.col("b") * 12).alias("col_off"))


@query(f'WITH {SAFE} SELECT site_id, "row", col FROM safe')
def safe_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.safe_pixels(fixture(spark, sf_dir, "terrain"), _train(spark, sf_dir), 16, 4).select(*raster.PIXEL)


@query(f"WITH {SAFE}, p AS (SELECT site_id, coalesce(occurrence >= 50, false) AS b, coalesce(slope <= 5, false) AS a FROM safe), c AS (SELECT site_id, count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (NOT a AND b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn, round(avg(b::INT), 6) AS baseline_iou FROM p GROUP BY site_id) SELECT site_id, tp, fp, fn, tn, baseline_iou, {PIXEL} FROM c")
def safe_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "terrain").withColumn("label", F.coalesce(F.col("occurrence") >= 50, F.lit(False)).cast("int")).withColumn("pred", F.coalesce(F.col("slope") <= 5, F.lit(False)).cast("int"))
    return rounded(tiles.safe_evaluation(d, _train(spark, sf_dir), 16, 4))


# --- geometry --------------------------------------------------------------------------------------------------------------------

AFFINE = (8.0, 0.0, 0.0, 0.0, -8.0, 384.0)
POINTS = "pt AS (SELECT *, floor((384 - y) / 8)::INT AS pr, floor(x / 8)::INT AS pc FROM parcel)"


@query(f'WITH {POINTS} SELECT pt.site_id, node_id, pr AS "row", pc AS col, round(elevation, 6) AS elevation FROM pt LEFT JOIN terrain t ON t.site_id = pt.site_id AND t.row = pr AND t.col = pc')
def sample_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spatial.sample_pixels(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "terrain"), "elevation", AFFINE)
    return rounded(d.select("site_id", "node_id", "row", "col", "elevation"))


@query(f"WITH {POINTS}, {TILED} SELECT pt.site_id, node_id, round(avg(t.slope), 6) AS slope FROM pt LEFT JOIN tiled t ON t.site_id = pt.site_id AND t.row = pr AND t.col = pc GROUP BY pt.site_id, node_id")
def tile_mean_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = geo.pixel_of(F.col("x"), F.col("y"), AFFINE)
    p = fixture(spark, sf_dir, "parcel").select("site_id", "node_id", row.alias("row"), col.alias("col"))
    return rounded(tiles.tile_mean_at(p, tiled(spark, sf_dir).select(*tiles.TILE_KEY, "local_row", "local_col", "slope"), "slope", 16, 4).select("site_id", "node_id", "slope"))


CROSS = "(y1 > {y}) <> (y2 > {y}) AND {x} < x1 + ({y} - y1) * (x2 - x1) / nullif(y2 - y1, 0)"


@query(f"WITH z AS (SELECT site_id, node_id, zone_id, count(*) % 2 AS odd FROM parcel p, zone_edge WHERE {CROSS.format(x='p.x', y='p.y')} GROUP BY ALL) SELECT site_id, node_id, EXISTS (SELECT 1 FROM z WHERE z.site_id = p.site_id AND z.node_id = p.node_id AND odd = 1) AS inside_zone FROM parcel p")
def in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_zone(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "zone_edge")).select("site_id", "node_id", "inside_zone")


@query("WITH t AS (SELECT site_id, node_id, x, y, s.*, greatest(0, least(1, ((x - s.x1) * (s.x2 - s.x1) + (y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2))) AS t FROM parcel, line_segment s) SELECT site_id, node_id, min((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) <= 144 AS in_corridor FROM t GROUP BY site_id, node_id")
def in_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_corridor(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "line_segment"), 12.0).select("site_id", "node_id", "in_corridor")


@query(f'WITH c AS (SELECT site_id, "row", col, (col + 0.5) * 8 AS px, 384 - ("row" + 0.5) * 8 AS py FROM terrain), z AS (SELECT site_id, "row", col, zone_id, count(*) % 2 AS odd FROM c, zone_edge WHERE {CROSS.format(x="px", y="py")} GROUP BY ALL) SELECT site_id, "row", col, (EXISTS (SELECT 1 FROM z WHERE z.site_id = c.site_id AND z.row = c.row AND z.col = c.col AND odd = 1))::INT AS mask FROM c')
def zone_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.zone_mask(fixture(spark, sf_dir, "terrain"), fixture(spark, sf_dir, "zone_edge"), AFFINE)


@query("SELECT site_id, node_id, round(36.8 + x * 1e-5, 9) AS lon, round(-1.3 + y * 1e-5, 9) AS lat FROM parcel")
def reproject_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to metres and back gives the degrees again."""
    p = fixture(spark, sf_dir, "parcel")
    e, n = geo.to_metric(36.8 + F.col("x") * 1e-5, -1.3 + F.col("y") * 1e-5)
    d = p.select("site_id", "node_id", e.alias("e"), n.alias("n"))
    lon, lat = geo.to_degrees(F.col("e"), F.col("n"))
    return d.select("site_id", "node_id", r(lon, 9).alias("lon"), r(lat, 9).alias("lat"))


# Rings by kind of outline, as shares of its side: (kind, ring, from x, from y, to x, to y, hole, turned the other way). Kind 4 has no rings but a line of two parts.
RINGS = [
    (0, 0, 0.0, 0.0, 1.0, 1.0, False, False), (1, 0, 0.0, 0.0, 1.0, 1.0, False, True), (1, 1, 0.25, 0.25, 0.75, 0.5, True, True), (2, 0, 0.0, 0.0, 1.0, 1.0, False, False), (2, 1, 1.5, 0.0, 2.0, 1.0, False, True),
    (3, 0, 0.125, 0.125, 0.875, 0.875, True, False), (3, 1, 0.0, 0.0, 1.0, 1.0, False, False), (3, 2, 0.25, 0.25, 0.5, 0.5, False, True), (4, 0, 0.0, 0.0, 1.0, 0.0, False, False), (4, 1, 0.0, 2.0, 0.0, 5.0, False, False),
]
RING_SQL = "ring(kind, ring, lo_x, lo_y, hi_x, hi_y, hole) AS (VALUES " + ", ".join(f"({k}, {i}, {a}e0, {b}e0, {c}e0, {d}e0, {h})" for k, i, a, b, c, d, h, _ in RINGS) + ")"
_DEGREES = 1e-5  # of a metre, about


def outlines(spark: SparkSession, sf_dir: str, x: str, y: str, side: str) -> DataFrame:
    """site_id, feature_id, kind, rings of the outlines; those that turn the other way do so, whatever they are."""
    at = lambda fx, fy: F.struct((F.col(x) + fx * F.expr(side)).alias("x"), (F.col(y) + fy * F.expr(side)).alias("y"))

    def ring(k: int, a: float, b: float, c: float, d: float, back: bool):
        corners = [at(a, b), at(c, d)] if k == 4 else [at(a, b), at(c, b), at(c, d), at(a, d)]
        return F.array(*(corners[::-1] if back else corners))

    rings = lambda k: F.array(*[ring(k, a, b, c, d, back) for kind, _, a, b, c, d, _, back in RINGS if kind == k])
    of_kind = F.when(F.col("kind") == 0, rings(0))
    for k in range(1, 5):
        of_kind = of_kind.when(F.col("kind") == k, rings(k))
    return fixture(spark, sf_dir, "outline").select("site_id", F.col("node_id").alias("feature_id"), "kind", of_kind.alias("rings"))


def features_file(spark: SparkSession, sf_dir: str) -> str:
    """A written table of features in degrees: polygons of the first kinds, lines of the last."""
    d = outlines(spark, sf_dir, "lon", "lat", f"side * {_DEGREES}")
    kinds = F.when(F.col("kind") == 4, "MultiLineString").when(F.col("kind") == 2, "MultiPolygon").otherwise("Polygon")
    tags = F.map_filter(F.create_map(F.lit("building"), F.when(F.col("kind") < 4, "yes"), F.lit("highway"), F.when(F.col("kind") == 4, "path"), F.lit("amenity"), F.when(F.col("kind") == 3, "toilets")), lambda k, v: v.isNotNull())
    return written(d.select("site_id", "feature_id", kinds.alias("geom_type"), "rings", tags.alias("tags")))


def written(df: DataFrame) -> str:
    path = f"{folder(df.sparkSession)}/source-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def metric_sql(lon: str, lat: str) -> str:
    """x, y in metres of degrees, in SQL: the forward Krueger series to the third order."""
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    radius, e = geo.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * n**0.5 / (1 + n)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos(radians({lon} - {geo.MERIDIAN})))", f"atanh(sin(radians({lon} - {geo.MERIDIAN})) / sqrt(1 + {t} * {t}))"
    east = f"{geo.FALSE_EAST} + {geo.SCALE * radius!r} * ({eta} + {' + '.join(f'{c!r} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})' for k, c in enumerate(a, 1))})"
    north = f"{geo.FALSE_NORTH} + {geo.SCALE * radius!r} * ({xi} + {' + '.join(f'{c!r} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})' for k, c in enumerate(a, 1))})"
    return f"{east} AS x, {north} AS y"


_CORNER = "corner(k, right_, up) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1))"
_METRIC_RINGS = f"""{RING_SQL}, {_CORNER}, deg AS (SELECT site_id, node_id, o.kind, ring, k, hole, lon + (CASE right_ WHEN 1 THEN hi_x ELSE lo_x END) * side * {_DEGREES} AS px, lat + (CASE up WHEN 1 THEN hi_y ELSE lo_y END) * side * {_DEGREES} AS py FROM outline o JOIN ring USING (kind), corner WHERE o.kind < 4 OR k % 2 = 0),
far AS (SELECT site_id, node_id, kind, ring, k, hole, {metric_sql('px', 'py')} FROM deg), origin AS (SELECT site_id, node_id, min(x) AS ox, min(y) AS oy FROM far GROUP BY ALL), met AS (SELECT far.* REPLACE (x - ox AS x, y - oy AS y), ox, oy FROM far JOIN origin USING (site_id, node_id)),
edge AS (SELECT a.*, b.x AS x2, b.y AS y2, a.x * b.y - b.x * a.y AS w FROM met a JOIN met b ON a.site_id = b.site_id AND a.node_id = b.node_id AND a.ring = b.ring AND b.k = CASE a.kind WHEN 4 THEN 2 - a.k ELSE (a.k + 1) % 4 END),
rings AS (SELECT site_id, node_id, kind, ring, any_value(hole) AS hole, CASE WHEN any_value(hole) THEN -1 ELSE 1 END * abs(sum(w)) / 2 AS area, any_value(ox) + sum((x + x2) * w) / (3 * sum(w)) AS cx, any_value(oy) + sum((y + y2) * w) / (3 * sum(w)) AS cy FROM edge WHERE kind < 4 GROUP BY ALL),
areas AS (SELECT site_id, node_id, kind, sum(area) AS area_m2, sum(area * cx) / sum(area) AS x, sum(area * cy) / sum(area) AS y FROM rings GROUP BY ALL)"""


@query(f"WITH {_METRIC_RINGS} SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY node_id) - 1 AS node_id, round(x, 4) AS x, round(y, 4) AS y, round(area_m2, 4) AS area_m2 FROM areas")
def read_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines with holes, islands and several parts, whichever way their rings turn."""
    return rounded(readers.read_footprints(spark, features_file(spark, sf_dir)).select("site_id", "node_id", "x", "y", "area_m2"), 4)


@query(f"""WITH {_METRIC_RINGS}, lines AS (SELECT site_id, node_id, any_value(ox) + sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2) * (x + x2) / 2) / sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS x, any_value(oy) + sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2) * (y + y2) / 2) / sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS y FROM edge WHERE kind = 4 GROUP BY ALL)
SELECT site_id, node_id AS infra_id, 'road' AS category, round(x, 4) AS x, round(y, 4) AS y FROM lines UNION ALL SELECT site_id, node_id, 'sanitation', round(x, 4), round(y, 4) FROM areas WHERE kind = 3""")
def read_infra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of two parts, weighed by length, and areas with a hole and an island."""
    return rounded(readers.read_infra(spark, features_file(spark, sf_dir)), 4)


@query(f"WITH placed AS (SELECT site_id, node_id, {metric_sql('lon', 'lat')} FROM (SELECT site_id, node_id, lon, lat FROM outline)) SELECT site_id, node_id, round(x, 4) AS x, round(y, 4) AS y FROM placed")
def project_to_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.to_metric(F.col("lon"), F.col("lat"))
    return rounded(fixture(spark, sf_dir, "outline").select("site_id", "node_id", x.alias("x"), y.alias("y")), 4)


_SIDE = "sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"
_SIDES = [_SIDE.format(px=f"{p}.x1", py=f"{p}.y1", qx=f"{p}.x2", qy=f"{p}.y2", rx=f"{q}.x{k}", ry=f"{q}.y{k}") for p, q in (("e", "z"), ("z", "e")) for k in (1, 2)]


@query(f"""WITH {RING_SQL}, {_CORNER}, c AS (SELECT site_id, node_id, ring, k, x + (CASE right_ WHEN 1 THEN hi_x ELSE lo_x END) * side AS x1, y + (CASE up WHEN 1 THEN hi_y ELSE lo_y END) * side AS y1 FROM outline o JOIN ring USING (kind), corner WHERE o.kind < 4),
e AS (SELECT a.*, b.x1 AS x2, b.y1 AS y2 FROM c a JOIN c b ON a.site_id = b.site_id AND a.node_id = b.node_id AND a.ring = b.ring AND b.k = (a.k + 1) % 4),
hits AS (SELECT DISTINCT site_id, node_id FROM e, zone_edge z WHERE greatest(e.x1, e.x2) >= least(z.x1, z.x2) AND greatest(z.x1, z.x2) >= least(e.x1, e.x2) AND greatest(e.y1, e.y2) >= least(z.y1, z.y2) AND greatest(z.y1, z.y2) >= least(e.y1, e.y2)
  AND {_SIDES[0]} * {_SIDES[1]} <= 0 AND {_SIDES[2]} * {_SIDES[3]} <= 0
UNION SELECT site_id, node_id FROM (SELECT c.site_id, c.node_id, c.ring, zone_id FROM c, zone_edge WHERE c.k = 0 AND {CROSS.format(x='c.x1', y='c.y1').replace("(y1 >", "(zone_edge.y1 >").replace("(y2 >", "(zone_edge.y2 >").replace("< x1 +", "< zone_edge.x1 +").replace("- y1) * (x2 - x1) / nullif(y2 - y1, 0)", "- zone_edge.y1) * (zone_edge.x2 - zone_edge.x1) / nullif(zone_edge.y2 - zone_edge.y1, 0)")} GROUP BY ALL HAVING count(*) % 2 = 1)
UNION SELECT site_id, node_id FROM (SELECT e.site_id, e.node_id, z.zone_id, z.edge_no FROM zone_edge z, e WHERE (e.y1 > z.y1) <> (e.y2 > z.y1) AND z.x1 < e.x1 + (z.y1 - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0) GROUP BY ALL HAVING count(*) % 2 = 1))
SELECT site_id, node_id, EXISTS (SELECT 1 FROM hits h WHERE h.site_id = o.site_id AND h.node_id = o.node_id) AS inside_zone FROM outline o WHERE o.kind < 4""")
def footprints_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of one or two parts, with holes and islands, that any zone meets."""
    d = outlines(spark, sf_dir, "x", "y", "side").filter("kind < 4").withColumnRenamed("feature_id", "node_id")
    return spatial.footprints_in_zone(settle(d.select("site_id", "node_id", "rings")), fixture(spark, sf_dir, "zone_edge"))


@query(f"WITH {DECIDE} SELECT p.site_id, p.node_id, CASE p.site_id WHEN 0 THEN 'KB' WHEN 1 THEN 'MT' ELSE 'P' END || '-' || lpad((row_number() OVER (PARTITION BY p.site_id ORDER BY p.node_id))::VARCHAR, 5, '0') AS parcel_id, CASE WHEN dok THEN ['low', 'medium', 'high'][k + 1] END AS class_name, round(greatest(q0, q1, q2), 6) AS class_proba, {NAMES.format(c='pact')} AS action FROM parcel p JOIN decided USING (site_id, node_id)")
def parcel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = spatial.attach_positions(decided(spark, sf_dir), fixture(spark, sf_dir, "parcel").select("site_id", "node_id", "x", "y"))
    return rounded(spatial.parcel_rows(placed, {0: "KB", 1: "MT"}).drop("x", "y", "probabilities"))


@query("SELECT site_id, round(greatest(500, (5082 - (max(x) - min(x))) / 2, (5082 - (max(y) - min(y))) / 2), 6) AS buffer_m FROM parcel GROUP BY site_id")
def export_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = fixture(spark, sf_dir, "parcel").groupBy("site_id").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return rounded(box.select("site_id", P.export_buffer(F.col("w"), F.col("h"), 500.0).alias("buffer_m")))


@query("SELECT site_id, CASE WHEN (max(x) - min(x)) * (max(y) - min(y)) / 1e6 BETWEEN 0.1 AND 20 THEN 'polygon' ELSE 'box' END AS boundary FROM parcel GROUP BY site_id")
def boundary_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = fixture(spark, sf_dir, "parcel").groupBy("site_id").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / 1e6).alias("km2"))
    return box.select("site_id", P.boundary(F.col("km2"), F.lit("polygon"), F.lit("box")).alias("boundary"))


@query("WITH t AS (SELECT infra_id, unnest(CASE category WHEN 'water' THEN ['water', 'road'] WHEN 'sanitation' THEN ['sanitation'] ELSE ['road'] END) AS category FROM infra) SELECT infra_id, category FROM t")
def infra_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags made from the category; a tap beside a road is in two."""
    c = F.col("category")
    amenity = F.when(c == "water", "drinking_water").when(c == "sanitation", "toilets").otherwise("bench")
    tags = F.map_filter(F.create_map(F.lit("amenity"), amenity, F.lit("highway"), F.when(c != "sanitation", "path"), F.lit("man_made"), F.lit("water_tap")), lambda k, v: v.isNotNull())
    return fixture(spark, sf_dir, "infra").select("infra_id", F.explode(P.infra_categories(tags)).alias("category"))


@query("SELECT site_id, \"row\", col, coalesce(slope, 0) AS slope, coalesce(occurrence, 0) AS occurrence FROM terrain")
def layout_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.layout(fixture(spark, sf_dir, "terrain"), ["slope"], "occurrence")


@query("SELECT site_id, \"row\", col, slope, round(elevation, 6) AS elevation, (occurrence > 0.5)::INT AS y FROM terrain WHERE slope IS NOT NULL AND elevation IS NOT NULL AND occurrence IS NOT NULL")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.feature_matrix(fixture(spark, sf_dir, "terrain"), ["slope", "elevation"], "occurrence"))


@query("WITH c AS (SELECT site_id, \"row\", col, (col + 0.5) * 8 AS px, 384 - (\"row\" + 0.5) * 8 AS py FROM terrain), t AS (SELECT c.*, s.*, greatest(0, least(1, ((px - s.x1) * (s.x2 - s.x1) + (py - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2))) AS t FROM c, line_segment s) SELECT site_id, \"row\", col, (min((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) <= 225.0001)::INT AS mask FROM t GROUP BY site_id, \"row\", col")
def corridor_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.corridor_mask(fixture(spark, sf_dir, "terrain"), fixture(spark, sf_dir, "line_segment"), AFFINE, 225.0001**0.5)


@query("SELECT round(avg(y), 6) AS lat, round(avg(x), 6) AS lon FROM parcel WHERE site_id = 1")
def site_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.site_centre(fixture(spark, sf_dir, "parcel").filter("site_id = 1"), "y", "x", (-1.3, 36.8)))


@query("SELECT node_id, round(1 / (1 + exp(-(p_low * 4 - 2))), 6) AS s, round(exp(p_low) / (exp(p_low) + exp(p_medium) + exp(p_high)), 6) AS p0, CASE WHEN p_low >= p_medium AND p_low >= p_high THEN 0 WHEN p_medium >= p_high THEN 1 ELSE 2 END AS k FROM parcel_heads")
def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.array("p_low", "p_medium", "p_high")
    return rounded(fixture(spark, sf_dir, "parcel_heads").select("node_id", R.sigmoid(F.col("p_low") * 4 - 2).alias("s"), R.softmax(z)[0].alias("p0"), R.argmax(z).alias("k")))


@query("SELECT site_id, count(*) AS pixels, sum((occurrence >= 50)::INT)::BIGINT AS flooded, round(avg((occurrence >= 50)::INT), 6) AS fraction FROM terrain WHERE occurrence IS NOT NULL GROUP BY site_id")
def label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "terrain").filter("occurrence IS NOT NULL").withColumn("flood", R.permanent_water(F.col("occurrence")).cast("int"))
    return rounded(raster.label_profile(d, ["site_id"]))


@query("SELECT site_id, count(*) AS entries FROM manifest GROUP BY site_id")
def manifest_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.by_site(fixture(spark, sf_dir, "manifest"))


@query("SELECT site_id, \"row\", col, round(avg(greatest(0, least(1, (vv + 30) / 30))), 6) AS vv FROM scene_obs GROUP BY ALL")
def unit_decibels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixture(spark, sf_dir, "scene_obs").withColumn("vv", R.unit_db(F.col("vv")))
    return rounded(d.groupBy(*raster.PIXEL).agg(F.avg("vv").alias("vv")))


@query(f'WITH RECURSIVE {EVENT} SELECT site_id, "row", col, CASE WHEN kept.row IS NULL THEN 0 ELSE 1 END AS flood FROM s3 LEFT JOIN kept USING (site_id, "row", col)')
def event_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.event_flood_label(settle(pixels(spark, sf_dir)))[0]


@query("SELECT site_id, node_id, flood_proba IS NOT NULL AND flood_proba BETWEEN -1e-6 AND 1 + 1e-6 AS flood_ok, p_low + p_medium + p_high > 1e-8 AS class_ok FROM parcel_heads")
def usable_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [F.col(f"p_{c}") for c in S.CLASSES]
    return fixture(spark, sf_dir, "parcel_heads").select("site_id", "node_id", heads.flood_usable(F.col("flood_proba")).alias("flood_ok"), heads.class_usable(p).alias("class_ok"))


@query("WITH m AS (SELECT site_id, avg(area_m2) AS m, greatest(coalesce(stddev_samp(area_m2), 1e-6), 1e-6) AS s FROM parcel GROUP BY site_id) SELECT site_id, node_id, round((area_m2 - m) / s, 6) AS area_m2, round(p.y, 6) AS y, round(x, 6) AS pos_x, round(p.y, 6) AS pos_y FROM parcel p JOIN m USING (site_id)")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.feature_table(fixture(spark, sf_dir, "parcel"), ["area_m2"], "y"))


# --- models ----------------------------------------------------------------------------------------------------------------------

WEIGHTS = ([[0.02, 0.01], [-0.01, 0.03]], [[0.01, -0.02], [0.02, 0.01]], [0.1, -0.2])
HEAD = ([[0.5, -0.3], [0.1, 0.2], [-0.4, 0.6]], [0.0, 0.1, -0.1])
_Z = ["0.5 * a - 0.3 * b", "0.1 * a + 0.2 * b + 0.1", "-0.4 * a + 0.6 * b - 0.1"]


@query(f"WITH {EDGES}, m AS (SELECT p.site_id, p.node_id, p.area_m2 AS x0, p.y AS x1, coalesce(avg(q.area_m2), 0) AS m0, coalesce(avg(q.y), 0) AS m1 FROM parcel p LEFT JOIN both_ways b ON b.site_id = p.site_id AND b.src = p.node_id LEFT JOIN parcel q ON q.site_id = b.site_id AND q.node_id = b.dst GROUP BY ALL), h AS (SELECT site_id, node_id, greatest(0, 0.02 * x0 + 0.01 * x1 + 0.01 * m0 - 0.02 * m1 + 0.1) AS a, greatest(0, -0.01 * x0 + 0.03 * x1 + 0.02 * m0 + 0.01 * m1 - 0.2) AS b FROM m), z AS (SELECT *, exp({_Z[0]}) AS e0, exp({_Z[1]}) AS e1, exp({_Z[2]}) AS e2 FROM h) SELECT site_id, node_id, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1, round(e2 / (e0 + e1 + e2), 6) AS p2 FROM z")
def sage_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = parcel_graph(spark, sf_dir)
    d = ml.forward(nodes, edges, ["area_m2", "y"], [WEIGHTS], HEAD)
    return rounded(d.select("site_id", "node_id", *[F.col("p")[k].alias(f"p{k}") for k in range(3)]))


@query("WITH m AS (SELECT site_id, avg(x) AS mx, avg(y) AS my FROM parcel GROUP BY site_id), v AS (SELECT p.*, mx, my FROM parcel p JOIN m USING (site_id)), a AS (SELECT site_id, node_id, ((x * my - mx * my) + (x * y - mx * y)) / 2 * 0.01 AS ax, ((mx * y - mx * my) + (x * y - x * my)) / 2 * 0.01 AS ay FROM v) SELECT site_id, node_id, round(ax, 5) AS att_x, round(ay, 5) AS att_y FROM a")
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ml.shapley(fixture(spark, sf_dir, "parcel"), ["site_id", "node_id"], ["x", "y"], lambda c: 0.01 * c["x"] * c["y"])
    at = lambda f: F.max(F.when(F.col("feature") == f, F.col("attribution"))).alias(f"att_{f}")
    return rounded(d.groupBy("site_id", "node_id").agg(at("x"), at("y")), 5)


COMPONENTS = [f"f{k}" for k in range(64)]
FIXED = [(3 * k % 7 - 3) / 8 for k in range(64)]  # weights that SQL can state


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.lit(0).alias("fold"), (F.col("label") < 5).cast("int").alias("y"), *[F.col("embedding")[k].cast("double").alias(f) for k, f in enumerate(COMPONENTS)])


@query()
def pixel_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = settle(_vectors(spark, sf_dir))
    m = ml.PixelClassifier(COMPONENTS).fit(d)
    return d.select("id", "y", r(m.probability(), 4).alias("p"))


@query()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = settle(_vectors(spark, sf_dir))
    m = ml.PixelClassifier(COMPONENTS).fit(d)
    return rounded(ml.permutation_importance(d, COMPONENTS, repeats=10, weights=m.linear()[0]), 4)


_AUC = "CASE WHEN count(*) FILTER (y > 0) > 0 AND count(*) FILTER (y <= 0) > 0 THEN (sum(rk) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2) / (count(*) FILTER (y > 0) * count(*) FILTER (y <= 0)) END"


@query(f"""WITH e AS (SELECT (label < 5)::INT AS y, embedding AS v, {' + '.join(f'{w} * embedding[{k + 1}]::DOUBLE' for k, w in enumerate(FIXED))} AS z, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS k FROM embeddings),
d AS (SELECT r, embedding AS g, row_number() OVER (PARTITION BY r ORDER BY md5('0:' || r || ':' || vec_id), vec_id) AS k FROM embeddings, range(10) AS t(r)),
s AS (SELECT r, f, y, round(z + {FIXED}[f + 1] * (g[f + 1]::DOUBLE - v[f + 1]::DOUBLE), 9) AS score FROM e JOIN d USING (k), range(64) AS u(f) UNION ALL SELECT -1, -1, y, round(z, 9) FROM e),
k AS (SELECT r, f, y, rank() OVER (PARTITION BY r, f ORDER BY score) + (count(*) OVER (PARTITION BY r, f, score) - 1) / 2 AS rk FROM s), a AS (SELECT r, f, {_AUC} AS auc FROM k GROUP BY r, f),
m AS (SELECT 'f' || a.f AS feature, avg(b.auc - a.auc) AS mean, stddev_pop(b.auc - a.auc) AS std FROM a, a AS b WHERE a.r >= 0 AND b.r < 0 GROUP BY a.f)
SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, row_number() OVER (ORDER BY round(mean, 6) DESC, feature) AS place FROM m""")
def permutation_importance_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rounded(ml.permutation_importance(settle(_vectors(spark, sf_dir)), COMPONENTS, repeats=10, weights=FIXED))
    return d.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "feature")))  # a row for each feature


@query()
def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = settle(_vectors(spark, sf_dir))
    return rounded(ml.signal_report(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"), COMPONENTS), 4)


@query()
def neighbourhood_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = settle(features.enrich(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "infra")))
    edges = settle(graph.proximity_edges(nodes))
    labelled = splits.stratified_split(nodes.drop("y").withColumn("y", F.col("severity")).withColumn("id", F.col("node_id")))
    _, report = ml.neighbourhood_classifier(labelled, edges, features.FEATURES)
    return rounded(report, 4)


@query()
def flood_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("flood_label", R.permanent_water(F.col("occurrence")).cast("int"))
    return rounded(ml.flood_probability(settle(px.fillna(0, ["pre_vv", "event_vv"])), ["pre_vv", "event_vv"], "flood_label"), 4)


# --- pipelines -------------------------------------------------------------------------------------------------------------------


_Z = "round(({v} - avg({v}) OVER w) / greatest(stddev_samp({v}) OVER w, 1e-6), 6) AS {n}"


@query(f"""WITH RECURSIVE {ENRICHED}, q AS (SELECT site_id, quantile_cont(score, 1 / 3) AS c1, quantile_cont(score, 2 / 3) AS c2, min(score) AS lo, max(score) AS hi FROM scored GROUP BY site_id),
classed AS (SELECT s.*, CASE WHEN hi <= lo THEN 0 ELSE (score >= c1)::INT + (score >= c2)::INT END AS severity FROM scored s JOIN q USING (site_id)), {COMP}, big AS (SELECT site_id, component FROM comp GROUP BY ALL HAVING count(*) >= 20),
left_over AS (SELECT classed.* FROM classed JOIN comp USING (site_id, node_id) JOIN big USING (site_id, component))
SELECT site_id, node_id, {', '.join(_Z.format(v=v, n=n) for v, n in zip(('area_m2', 'dw', 'ds', 'dr', 'roof'), features.FEATURES, strict=True))}, severity AS y, round(x, 6) AS pos_x, round(y, 6) AS pos_y FROM left_over WINDOW w AS (PARTITION BY site_id)""")
def graph_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipelines.graph_branch(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "infra"))["nodes"])


_UNIT = "CASE WHEN {v} IS NOT NULL THEN round(greatest(0, least(1, ({v} + 30) / 30)), 6) END AS {v}"
_SCALED = "round(CASE WHEN {v} IS NOT NULL AND {v}_hi > {v}_lo THEN greatest(0, least(1, ({v} - {v}_lo) / ({v}_hi - {v}_lo))) WHEN {v} IS NOT NULL THEN 0 END, 6) AS {v}"


@query(f"""WITH RECURSIVE {EVENT}, {_WET}, stack AS (SELECT s3.site_id, s3.row, s3.col, s3.pre_vv, s3.event_vv, t.elevation, t.slope, t.occurrence, twi.twi, (kept.row IS NOT NULL)::INT AS flood_label FROM s3 LEFT JOIN terrain t ON t.site_id = s3.site_id AND t.row = s3.row AND t.col = s3.col
  LEFT JOIN twi ON twi.site_id = s3.site_id AND twi.row = s3.row AND twi.col = s3.col LEFT JOIN kept ON kept.site_id = s3.site_id AND kept.row = s3.row AND kept.col = s3.col),
{TILED.replace('FROM terrain t', 'FROM stack t').replace('FROM terrain', 'FROM stack')},
facts AS (SELECT site_id, tile_row_off, tile_col_off, count(*) FILTER (pre_vv IS NOT NULL AND event_vv IS NOT NULL AND elevation IS NOT NULL AND slope IS NOT NULL AND twi IS NOT NULL AND (pre_vv <> 0 OR event_vv <> 0 OR elevation <> 0 OR slope <> 0 OR twi <> 0)) / 256 AS valid_fraction,
  {', '.join(f'quantile_cont({v}, 0.01) AS {v}_lo, quantile_cont({v}, 0.99) AS {v}_hi' for v in ('elevation', 'slope', 'twi'))} FROM tiled GROUP BY ALL)
SELECT site_id, tile_row_off, tile_col_off, "row", col, local_row, local_col, {_UNIT.format(v='pre_vv')}, {_UNIT.format(v='event_vv')}, {', '.join(_SCALED.format(v=v) for v in ('elevation', 'slope', 'twi'))}, occurrence, flood_label, round(valid_fraction, 6) AS valid_fraction
FROM tiled JOIN facts USING (site_id, tile_row_off, tile_col_off) WHERE valid_fraction >= 0.6""")
def raster_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipelines.raster_branch(fixture(spark, sf_dir, "scene_obs"), fixture(spark, sf_dir, "terrain"), 16, 4))


_FUSED = f"""hit AS (SELECT site_id, node_id, zone_id FROM parcel p, zone_edge WHERE {CROSS.format(x='p.x', y='p.y')} GROUP BY ALL HAVING count(*) % 2 = 1),
fused AS (SELECT p.site_id, p.node_id, flood_proba, p_low, p_medium, p_high, EXISTS (SELECT 1 FROM hit h WHERE h.site_id = p.site_id AND h.node_id = p.node_id) AS inside_zone FROM parcel p LEFT JOIN parcel_heads h USING (site_id, node_id))"""


@query(f"WITH {_FUSED}, {DECIDE.replace('FROM parcel_heads', 'FROM fused')}, {SUMMARY}")
def fusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, h = fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "parcel_heads")
    return rounded(pipelines.fusion(p, h, fixture(spark, sf_dir, "zone_edge"))["summary"])


@query("SELECT p.site_id, count(DISTINCT p.node_id) AS parcels, 0::BIGINT AS bad, (SELECT count(DISTINCT category) FROM infra i WHERE i.site_id = p.site_id) AS categories, 'ok' AS status FROM parcel p GROUP BY p.site_id")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.run_status(fixture(spark, sf_dir, "parcel"), fixture(spark, sf_dir, "infra"), [0, 1, 2])


@query(f"""WITH RECURSIVE raw AS (SELECT TRY_CAST(site_id AS INT) AS site_id, TRY_CAST(node_id AS BIGINT) AS node_id, TRY_CAST(x AS DOUBLE) AS x, TRY_CAST(y AS DOUBLE) AS y, TRY_CAST(area_m2 AS DOUBLE) AS area FROM raw_parcel),
seen AS (SELECT *, CASE WHEN node_id IS NULL THEN 'node_id is no number' WHEN x IS NULL OR y IS NULL THEN 'no position' WHEN area IS NULL OR area <= 0 THEN 'no area' END AS why FROM raw),
tally AS (SELECT site_id, why, count(*) AS n FROM seen WHERE why IS NOT NULL GROUP BY ALL), worst AS (SELECT site_id, sum(n)::BIGINT AS rejected, first(why ORDER BY n DESC, why) AS why FROM tally GROUP BY site_id),
state AS (SELECT w.site_id, count(seen.site_id) AS parcels, coalesce(any_value(rejected), 0) AS rejected, any_value(worst.why) AS why FROM (SELECT unnest([0, 1, 2, 3, 9]) AS site_id) w LEFT JOIN seen USING (site_id) LEFT JOIN worst USING (site_id) GROUP BY w.site_id),
told AS (SELECT *, CASE WHEN parcels = 0 THEN 'no parcels' WHEN rejected > parcels * 0.05 THEN why END AS reason FROM state),
good AS (SELECT site_id, node_id, x, y FROM seen JOIN told USING (site_id) WHERE seen.why IS NULL AND reason IS NULL),
{EDGES.replace("parcel", "good")}, reach AS (SELECT site_id, node_id, node_id AS other FROM good UNION SELECT r.site_id, r.node_id, b.dst FROM reach r JOIN both_ways b ON b.site_id = r.site_id AND b.src = r.other),
comp AS (SELECT site_id, node_id, min(other) AS component FROM reach GROUP BY ALL), sizes AS (SELECT site_id, component, count(*) AS n FROM comp GROUP BY ALL),
graph AS (SELECT site_id, count(*) AS components, sum(n)::BIGINT AS nodes, coalesce(sum(n) FILTER (n >= 20), 0)::BIGINT AS kept FROM sizes GROUP BY site_id), linked AS (SELECT site_id, count(*) AS edges FROM edge GROUP BY site_id)
SELECT site_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, reason, parcels, rejected, nodes, CASE WHEN nodes IS NOT NULL THEN coalesce(edges, 0) END AS edges, components, kept FROM told LEFT JOIN graph USING (site_id) LEFT JOIN linked USING (site_id)""")
def site_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph branch over rows as they come: one site fails, one runs without its bad rows, one has no parcels, the others run as if these were not there."""
    out = pipelines.run_all_sites(fixture(spark, sf_dir, "raw_parcel"), fixture(spark, sf_dir, "infra"), [0, 1, 2, 3, 9], tolerated=0.05)
    kept = out["nodes"].groupBy("site_id").agg(F.count("*").alias("kept"))
    graph_ = out["integrity"].select("site_id", "nodes", "edges", "components").join(kept, "site_id", "left").fillna(0, ["kept"])
    return out["status"].join(graph_, "site_id", "left").select("site_id", "status", "reason", "parcels", "rejected", "nodes", "edges", "components", "kept")


@query("""WITH raw AS (SELECT TRY_CAST(site_id AS INT) AS site_id, node_id AS raw_id, TRY_CAST(node_id AS BIGINT) AS node_id, TRY_CAST(x AS DOUBLE) AS x, TRY_CAST(y AS DOUBLE) AS y, TRY_CAST(area_m2 AS DOUBLE) AS area FROM raw_parcel)
SELECT 'parcels' AS source, site_id, node_id::VARCHAR AS key, CASE WHEN node_id IS NULL THEN 'node_id is no number' WHEN x IS NULL OR y IS NULL THEN 'no position' ELSE 'no area' END AS reason FROM raw WHERE node_id IS NULL OR x IS NULL OR y IS NULL OR area IS NULL""")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.check_sites(fixture(spark, sf_dir, "raw_parcel"), fixture(spark, sf_dir, "infra"), [0, 1, 2, 3, 9], 0.05)["rejected"]


@query("SELECT site_id, count(area_m2) AS n, round(min(area_m2), 6) AS lo, round(max(area_m2), 6) AS hi, round(quantile_cont(area_m2, 0.01), 6) AS p01, round(quantile_cont(area_m2, 1e0 / 3), 6) AS third, round(quantile_cont(area_m2, 0.5), 6) AS half, round(quantile_cont(area_m2, 0.99), 6) AS p99 FROM parcel GROUP BY site_id")
def site_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quantiles.percentiles(fixture(spark, sf_dir, "parcel"), ["site_id"], "area_m2", [0.01, 1 / 3, 0.5, 0.99], accuracy=50)
    return rounded(d.select("site_id", "n", "lo", "hi", *[F.col("percentiles")[k].alias(n) for k, n in enumerate(("p01", "third", "half", "p99"))]))


@query("SELECT s.site, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS q2, round(quantile_cont(score, 0.75), 6) AS q3 FROM label_pairs s GROUP BY s.site")
def score_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of values that repeat often."""
    d = quantiles.percentiles(fixture(spark, sf_dir, "label_pairs"), ["site"], "score", [0.25, 0.5, 0.75], accuracy=20)
    return rounded(d.select("site", *[F.col("percentiles")[k].alias(f"q{k + 1}") for k in range(3)]))


@query('WITH v AS (SELECT a.site_id, a.row, a.col, b.elevation FROM terrain a JOIN terrain b ON a.site_id = b.site_id AND abs(a.row - b.row) <= 9 AND abs(a.col - b.col) <= 9 AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 81) SELECT site_id, "row", col, round(avg(elevation), 6) AS focal FROM v GROUP BY ALL')
def focal_mean_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius at which a disk has 253 pixels, and 19 rows."""
    return rounded(raster.focal_mean(fixture(spark, sf_dir, "terrain"), "elevation", 9).select(*raster.PIXEL, "focal"))

@query(f"""WITH RECURSIVE {EVENT}, {_WET} SELECT s3.site_id, s3.row, s3.col, round(s3.pre_vv, 5) AS pre_vv, round(s3.event_vv, 5) AS event_vv, s3.slope, round(twi.twi, 5) AS twi, (kept.row IS NOT NULL)::INT AS flood_label
FROM s3 LEFT JOIN twi ON twi.site_id = s3.site_id AND twi.row = s3.row AND twi.col = s3.col LEFT JOIN kept ON kept.site_id = s3.site_id AND kept.row = s3.row AND kept.col = s3.col""")
def stack_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar, terrain and wetness bands from three tables under the event's label."""
    px = settle(pixels(spark, sf_dir))
    terrain = fixture(spark, sf_dir, "terrain")
    bands = {"radar": px.select(*raster.PIXEL, "pre_vv", "event_vv"), "terrain": terrain.select(*raster.PIXEL, "slope"), "twi": raster.wetness_index(terrain)}
    return rounded(raster.build_stack(bands, raster.event_flood_label(px)[0], "event"), 5)


@query(f"""WITH {SEASONAL}, {_WET} SELECT twi.site_id, twi.row, twi.col, terrain.slope, round(twi.twi, 5) AS twi, flood AS flood_label FROM twi JOIN terrain ON terrain.site_id = twi.site_id AND terrain.row = twi.row AND terrain.col = twi.col LEFT JOIN season ON season.site_id = twi.site_id AND season.row = twi.row AND season.col = twi.col""")
def stack_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the radar bands, under the season's label."""
    terrain, obs = fixture(spark, sf_dir, "terrain"), fixture(spark, sf_dir, "scene_obs")
    bands = {"twi": raster.wetness_index(terrain), "terrain": terrain.select(*raster.PIXEL, "slope"), "radar": raster.event_pair(obs).drop("change")}
    return rounded(raster.build_stack(bands, raster.seasonal_flood_label(obs), "seasonal", include_s1=False), 5)


@query("SELECT site_id, coalesce(round(avg(y) FILTER (site_id <> 2), 6), -1.3) AS lat, coalesce(round(avg(x) FILTER (site_id <> 2), 6), 36.8) AS lon FROM parcel GROUP BY site_id")
def site_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site; the positions of one are unknown, so it has the default."""
    known = lambda c: F.when(F.col("site_id") != 2, F.col(c)).alias(c)
    d = fixture(spark, sf_dir, "parcel").select("site_id", known("x"), known("y"))
    return rounded(metrics.site_centre(d, "y", "x", (-1.3, 36.8), ["site_id"]))


@query("WITH m AS (SELECT site_id, avg(x) AS mx, avg(y) AS my FROM parcel GROUP BY site_id), a AS (SELECT site_id, node_id, abs((x * my - mx * my) + (x * y - mx * y)) AS ax, abs((mx * y - mx * my) + (x * y - x * my)) AS ay FROM parcel JOIN m USING (site_id)) SELECT site_id, node_id, 'x' AS feature, CASE WHEN ax >= ay THEN 1 ELSE 2 END AS rank FROM a UNION ALL SELECT site_id, node_id, 'y', CASE WHEN ax >= ay THEN 2 ELSE 1 END FROM a")
def shapley_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each parcel by the size of what they contribute."""
    d = ml.shapley(fixture(spark, sf_dir, "parcel"), ["site_id", "node_id"], ["x", "y"], lambda c: 0.01 * c["x"] * c["y"])
    return d.select("site_id", "node_id", "feature", "rank")


@query(f"WITH RECURSIVE {EVENT} SELECT site_id, string_agg(DISTINCT (kept.row IS NOT NULL)::INT::VARCHAR, ',' ORDER BY (kept.row IS NOT NULL)::INT::VARCHAR) AS labels, count(*) AS pixels, count(kept.row) AS flooded FROM s3 LEFT JOIN kept USING (site_id, \"row\", col) GROUP BY site_id")
def stack_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels each site's stack has, and how often it is flooded."""
    px = settle(pixels(spark, sf_dir))
    stack = settle(raster.build_stack({"px": px}, raster.event_flood_label(px)[0], "event"))
    labels = raster.stack_profile(stack, ["pre_vv"], "flood_label").select("site_id", F.array_join(F.transform("labels", lambda c: c.cast("string")), ",").alias("labels"))
    profile = raster.label_profile(stack.withColumnRenamed("flood_label", "flood"), ["site_id"]).select("site_id", "pixels", "flooded")
    return labels.join(profile, "site_id")


# --- sources and sinks -----------------------------------------------------------------------------------------------------------


def sink(spark: SparkSession) -> str:
    return f"{folder(spark)}/sink-{uuid.uuid4().hex}"


@query(f"WITH {DECIDE} SELECT site_id, node_id, pact AS action_index, {NAMES.format(c='pact')} AS action, round(confidence, 6) AS confidence FROM decided WHERE site_id <> 1 OR valid")
def policy_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites are written, then site 1 once more without invalid rows: the others stay."""
    d, path = decided(spark, sf_dir), sink(spark)
    readers.write_policy(d, path)
    readers.write_policy(d.filter("site_id = 1 AND valid"), path)
    return rounded(readers.read_policy(spark, path).select("site_id", F.col("node_id"), "action_index", "action", "confidence"))


@query(f"WITH {EDGES}, n AS (SELECT site_id, count(*) AS nodes FROM parcel WHERE site_id <> 1 OR node_id % 2 = 0 GROUP BY site_id), e AS (SELECT site_id, count(*) AS edges FROM edge WHERE site_id <> 1 GROUP BY site_id) SELECT site_id, nodes, coalesce(edges, 0) AS edges FROM n LEFT JOIN e USING (site_id)")
def graph_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sites are written, then site 1 once more with half its nodes and no edges: its old edges go, other sites stay."""
    (nodes, edges), path = parcel_graph(spark, sf_dir), sink(spark)
    nodes = nodes.withColumn("y", F.lit(0))
    readers.write_graph(nodes, edges, path)
    readers.write_graph(nodes.filter("site_id = 1 AND node_id % 2 = 0"), edges.limit(0), path)
    n, e = readers.read_graph(spark, path)
    e = e.groupBy("site_id").agg(F.count("*").alias("edges"))
    return n.groupBy("site_id").agg(F.count("*").alias("nodes")).join(e, "site_id", "left").fillna(0, ["edges"])


@query(f"WITH {TILED} SELECT site_id, CASE WHEN site_id = 0 OR tile_row_off = 0 THEN 'train' ELSE 'val' END AS split, tile_row_off AS row_off, tile_col_off AS col_off, count(*) AS pixels FROM tiled GROUP BY ALL")
def tile_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all sites in two splits, then site 0 once more in one: of that site no row of the other split stays, in pixels or manifest."""
    d, path = tiled(spark, sf_dir).withColumns({"variant": F.lit("orig"), "valid_fraction": F.lit(1.0)}), sink(spark)
    readers.write_tiles(d.withColumn("split", F.when(F.col("tile_row_off") == 0, "train").otherwise("val")), path)
    readers.write_tiles(d.filter("site_id = 0").withColumn("split", F.lit("train")), path)
    pixels = spark.read.parquet(f"{path}/pixels").groupBy("tile_id", "split").agg(F.count("*").alias("pixels"))
    entries = spark.read.schema("tile_id string, row_off int, col_off int, variant string, valid_fraction double, site_id int, split string").json(f"{path}/manifest")
    return entries.join(pixels, ["tile_id", "split"], "full_outer").select("site_id", "split", "row_off", "col_off", "pixels")


@query("SELECT site_id, count(*) AS n, min(ts) AS first, max(ts) AS last, round(sum(vv), 6) AS vv FROM scene_obs WHERE site_id IN (0, 2) AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01' GROUP BY site_id")
def scene_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sites and a year of observations that lie partitioned by site: other sites' files are not read."""
    path = sink(spark)
    fixture(spark, sf_dir, "scene_obs").write.partitionBy("site_id").parquet(path)
    d = readers.read_scenes(spark, path, [0, 2], "1995-01-01", "1996-01-01")
    return rounded(d.groupBy("site_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("vv").alias("vv")))


@query("SELECT 'site' || site_id AS site_key, 't' || entry_id AS tile_id, row_off, col_off, round(valid_fraction, 6) AS valid_fraction FROM manifest WHERE site_id < 2 AND variant = 'orig' UNION ALL SELECT 'site' || s, NULL, NULL, NULL, NULL FROM range(0, 3) t(s) WHERE s NOT IN (SELECT site_id FROM manifest WHERE site_id < 2 AND variant = 'orig')")
def manifest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one split of the sites whose manifests exist, and a row without tile for each site that has none."""
    path = sink(spark)
    m = fixture(spark, sf_dir, "manifest").select("site_id", F.concat(F.lit("t"), "entry_id").alias("tile_id"), F.lit("p").alias("path"), "row_off", "col_off", "valid_fraction", F.col("variant").alias("split"))
    for k in (0, 1):
        m.filter(F.col("site_id") == k).drop("site_id").write.json(f"{path}/{k}")
    rows, absent = readers.read_manifests(spark, {f"site{k}": f"{path}/{k}" for k in range(3)}, "orig")
    return rounded(rows.select("site_key", "tile_id", "row_off", "col_off", "valid_fraction").unionByName(absent, allowMissingColumns=True))


@query("SELECT zone_id, count(*) AS edges, 0 AS far FROM zone_edge GROUP BY zone_id")
def zone_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones written as a feature collection in degrees come back in metres: every edge begins where it did."""
    x0, y0 = 255_000.0, 9_856_000.0
    z = fixture(spark, sf_dir, "zone_edge")
    lon, lat = geo.to_degrees(x0 + F.col("x1"), y0 + F.col("y1"))
    rings = z.groupBy("zone_id").agg(F.array_sort(F.collect_list(F.struct("edge_no", F.array(lon, lat).alias("p")))).alias("c"))
    ring = F.array(F.concat(F.transform("c", lambda c: c["p"]), F.array(F.get("c", F.lit(0))["p"])))
    feature = F.struct(F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    path = sink(spark)
    rings.groupBy().agg(F.array_sort(F.collect_list(F.struct("zone_id", feature.alias("f")))).alias("z")).select(F.transform("z", lambda f: f["f"]).alias("features")).write.json(path)  # a row for each region
    read = readers.read_zones(spark, path).withColumnsRenamed({"x1": "rx", "y1": "ry"}).drop("x2", "y2")
    far = (F.abs(F.col("x1") + x0 - F.col("rx")) > 1e-3) | (F.abs(F.col("y1") + y0 - F.col("ry")) > 1e-3)
    return read.join(z, ["zone_id", "edge_no"]).groupBy("zone_id").agg(F.count("*").alias("edges"), F.count_if(far).cast("int").alias("far"))


@query(f"WITH {DECIDE} SELECT site_id, count(*) AS parcels, count(*) FILTER (displacement) AS displaced FROM decided GROUP BY ROLLUP (site_id)")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that is written twice is there once."""
    path, summary = sink(spark), policy.policy_summary(decided(spark, sf_dir)).select("site_id", "parcels", "displaced")
    readers.write_report(summary.limit(1), path)
    readers.write_report(summary, path)
    return spark.read.schema("site_id int, parcels long, displaced long").json(path)
