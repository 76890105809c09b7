"""Small cases of the domain operators."""

import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions import geo, heads, raster
from parcelrisk.functions import parcels as P
from parcelrisk.operators import features, graph, metrics, ml, policy, quantiles, raster as rasters, spatial, splits, tiles
from parcelrisk.operators.numbering import number_within, range_bucket
from parcelrisk.plans import pipelines
from parcelrisk.queries import QUERIES
from parcelrisk.sources import readers
from parcelrisk.streaming.decisions import HEADS, decide_stream

NODE = "site_id int, node_id long, x double, y double"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def decide(spark, rows, **kw):
    return policy.decide_policy(spark.createDataFrame(rows, HEADS), **kw).orderBy("node_id").collect()


def test_six_cells_and_the_gate(spark):
    rows = [(0, k, f, *p, False) for k, (f, p) in enumerate([(0.1, (0.8, 0.1, 0.1)), (0.1, (0.1, 0.8, 0.1)), (0.1, (0.1, 0.1, 0.8)), (0.5, (0.8, 0.1, 0.1)), (0.9, (0.1, 0.8, 0.1)), (0.9, (0.1, 0.1, 0.8)), (0.9, (0.3, 0.3, 0.4))])]
    out = decide(spark, rows)
    assert [r["action_index"] for r in out] == [0, 1, 2, 3, 3, 4, 3]
    assert [r["majority_gate_applied"] for r in out] == [False] * 6 + [True]
    assert all(math.isclose(sum(r["action_proba"]), 1) for r in out)


def test_zone_repairs_missing_but_not_corrupt(spark):
    p = (0.1, 0.1, 0.8)
    out = decide(spark, [(0, 0, None, *p, True), (0, 1, 1.5, *p, True), (0, 2, float("inf"), *p, True), (0, 3, 0.2, *p, True), (0, 4, None, *p, False)])
    assert [r["action_index"] for r in out] == [4, -1, 4, 4, -1]
    assert [r["override_applied"] for r in out] == [True, False, True, True, False]
    assert out[3]["flood_proba"] == 0.2
    with pytest.raises(ValueError):
        policy.decide_policy(spark.createDataFrame([], HEADS), 0.0)


def test_random_batch_passes_the_audit(spark):
    g = random.Random(1)
    rows = [(k % 3, k, g.random() if k % 9 else None, g.random(), g.random(), g.random(), g.random() < 0.3) for k in range(300)]
    d = policy.decide_policy(spark.createDataFrame(rows, HEADS))
    assert one(policy.justice_audit(d))["passes"]
    s = {r["site_id"]: r for r in policy.policy_summary(d).collect()}
    assert s[None]["parcels"] == 300 == sum(s[k]["parcels"] for k in range(3))


def test_action_index_out_of_range(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(5, 6).select(heads.action_name(F.col("id").cast("int"))).collect()


def test_roof_codes(spark):
    want = {None: 0.5, "unknown": 0.5, "metal;thatch": 0.85, " Concrete ": 0.0, "glass": 0.5}
    got = spark.createDataFrame([(k,) for k in want], "m string").select("m", P.roof_score(F.col("m")).alias("s")).collect()
    assert {r["m"]: r["s"] for r in got} == want


def test_severity_rules(spark):
    d = spark.createDataFrame([(0, float(k)) for k in range(9)] + [(1, 2.0)] * 5, "site_id int, s double")
    n = {(r["site_id"], r["severity"]): r["n"] for r in features.severity(d, "s").groupBy("site_id", "severity").agg(F.count("*").alias("n")).collect()}
    assert n == {(0, 0): 3, (0, 1): 3, (0, 2): 3, (1, 0): 5}
    assert {r["severity"] for r in features.severity(d, "s", cuts=[1.0, 8.0]).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        features.severity(d, "s", cuts=[1.0])


def test_edges_are_inclusive_and_once(spark):
    n = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 15.0, 0.0), (0, 2, 30.1, 0.0), (1, 3, 0.0, 0.0), (0, 4, 0.0, 0.0)], NODE)
    assert sorted(map(tuple, graph.proximity_edges(n).collect())) == [(0, 0, 1), (0, 0, 4), (0, 1, 4)]


def test_edges_equal_brute_force(spark):
    g = random.Random(2)
    rows = [(k % 2, k, g.uniform(-60, 60), g.uniform(-60, 60)) for k in range(160)]
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 15)
    assert sorted(map(tuple, graph.proximity_edges(spark.createDataFrame(rows, NODE)).collect())) == want


def test_chain_is_one_component(spark):
    n = spark.createDataFrame([(0, k, float(k), 0.0) for k in range(60)], NODE)
    e = spark.createDataFrame([(0, k, k + 1) for k in range(40)], "site_id int, src long, dst long")
    labels = graph.components(n, e)
    sizes = sorted(r["n"] for r in labels.groupBy("component").agg(F.count("*").alias("n")).collect())
    assert sizes == [1] * 19 + [41]
    nodes, edges = graph.prune(n, e, labels, 20)
    assert (nodes.count(), edges.count()) == (41, 40)
    rep = one(graph.integrity(n, e, labels))
    assert (rep["nodes"], rep["edges"], rep["components"], rep["isolated"]) == (60, 40, 20, 19)


def test_empty_graph(spark):
    n = spark.createDataFrame([], NODE)
    e = graph.proximity_edges(n)
    assert e.count() == 0 and graph.components(n, e).count() == 0


def test_nearest_equals_brute_force(spark):
    g = random.Random(3)
    nodes = [(k % 3, k, g.uniform(0, 1000), g.uniform(0, 900)) for k in range(80)]
    infra = [(k % 2, k, "water", g.uniform(0, 1000) ** 2 / 1000, g.uniform(0, 900)) for k in range(25)]
    got = {r["node_id"]: r["dist_water_m"] for r in spatial.nearest(spark.createDataFrame(nodes, NODE), spark.createDataFrame(infra, "site_id int, infra_id long, category string, x double, y double"), "water", cell=10.0).collect()}
    for s, k, x, y in nodes:
        d = [math.hypot(x - i[3], y - i[4]) for i in infra if i[0] == s]
        assert got[k] is None if not d else math.isclose(got[k], min(d))


def test_stable_land_is_never_flood(spark):
    px = spark.createDataFrame([(0, r, c, -8.0, -8.0, 1.0, 0.0) for r in range(6) for c in range(6)], "site_id int, row int, col int, pre_vv double, event_vv double, slope double, occurrence double")
    label, report = rasters.event_flood_label(px)
    assert label.agg(F.sum("flood")).first()[0] == 0 and one(report)["source"] == "fixed"


def test_masks_treat_missing_differently(spark):
    d = spark.createDataFrame([(None, None, None), (-4.0, 9.0, 60.0)], "c double, s double, o double")
    got = d.select(raster.below(F.col("c"), -3.0), raster.too_steep(F.col("s")), raster.permanent_water(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, True, True)]


def test_lift(spark):
    d = spark.createDataFrame([(k < 30, k < 30, k) for k in range(100)], "a boolean, b boolean, k int")
    r = one(metrics.agreement(d, [], F.col("a"), F.col("b")))
    assert math.isclose(r["lift"], 1 / 0.3, rel_tol=1e-6) and math.isclose(r["iou"], 1, rel_tol=1e-6)


def test_auc_with_ties(spark):
    d = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "score double, label int")
    assert one(metrics.auc(d, []))["auc"] == 0.875
    assert one(metrics.auc(d.filter("label = 1"), []))["auc"] is None


def test_split_is_a_partition_and_rounds_half_even(spark):
    d = spark.createDataFrame([(0, k, k % 2) for k in range(50)], "site_id int, id long, y int")
    n = {(r["y"], r["split"]): r["n"] for r in splits.stratified_split(d).groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert n == {(y, s): k for y in (0, 1) for s, k in (("train", 15), ("val", 5), ("test", 5))}
    m = spark.createDataFrame([(0, 206 * k, 0, v) for k in range(10) for v in ("orig", "flip_h")], "site_id int, row_off long, col_off long, variant string")
    held = splits.holdout_sites(m).groupBy("row_off").agg(F.count_distinct("split").alias("k"), F.first("split").alias("s")).collect()
    assert all(r["k"] == 1 for r in held) and sum(r["s"] == "val" for r in held) == 2
    with pytest.raises(ValueError):
        splits.usable_sites(m)
    with pytest.raises(Exception, match="two locations"):
        splits.holdout_one(m.filter("row_off = 0")).collect()


def test_tiles_cover_what_the_arithmetic_says(spark):
    px = spark.createDataFrame([(0, r, c) for r in range(20) for c in range(9)], "site_id int, row int, col int")
    got = {tuple(r) for r in tiles.tile(px, 8, 3).select("tile_row_off", "tile_col_off", "row", "col").collect()}
    want = {(a, 0, r, c) for a in (0, 5, 10) for r in range(a, a + 8) for c in range(8)}
    assert got == want
    flipped = tiles.augment(spark.createDataFrame([(0, 1)], "local_row int, local_col int"), 4).select("variant", "local_row", "local_col").collect()
    assert {tuple(r) for r in flipped} == {("orig", 0, 1), ("flip_h", 0, 2), ("flip_v", 3, 1), ("rot90", 2, 0)}


def test_projection_and_area(spark):
    e, n = geo.to_metric(F.col("lon"), F.col("lat"))
    d = spark.createDataFrame([(39.0, 0.0), (36.8, -1.3)], "lon double, lat double").select("lon", "lat", e.alias("e"), n.alias("n"))
    rows = d.select("*", *[c.alias(k) for c, k in zip(geo.to_degrees(F.col("e"), F.col("n")), ("lon2", "lat2"), strict=True)]).collect()
    assert math.isclose(rows[0]["e"], 500_000, abs_tol=1e-6) and math.isclose(rows[0]["n"], 10_000_000, abs_tol=1e-6)
    assert all(math.isclose(r["lon"], r["lon2"], abs_tol=1e-10) and math.isclose(r["lat"], r["lat2"], abs_tol=1e-10) for r in rows)
    square = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0)],)], "ring array<struct<x: double, y: double>>")
    x, y = geo.ring_centroid(F.col("ring"))
    assert tuple(square.select(geo.ring_area(F.col("ring")), x, y).first()) == (6.0, 1.0, 1.5)
    with pytest.raises(ValueError):
        geo.pixel_of(F.col("x"), F.col("y"), (0.0,) * 6)


def test_zone_boundary_counts_and_no_zones(spark):
    edges = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 0.0), (0, 1, 10.0, 0.0, 10.0, 10.0), (0, 2, 10.0, 10.0, 0.0, 10.0), (0, 3, 0.0, 10.0, 0.0, 0.0)], "zone_id int, edge_no int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(0, 0, 5.0, 5.0), (0, 1, 10.0, 5.0), (0, 2, 11.0, 5.0), (0, 3, -1.0, 5.0)], NODE)
    inside = {r["node_id"] for r in spatial.in_zone(p, edges, 4.0).filter("inside_zone").collect()}
    assert inside == {0, 1}
    assert not spatial.in_zone(p, edges.limit(0)).filter("inside_zone").count()


def test_shapley_sums_to_the_gap(spark):
    d = spark.createDataFrame([(0, k, float(k), float(k * k % 7), 1.0) for k in range(12)], "site_id int, node_id long, a double, b double, c double")
    score = lambda c: c["a"] * c["b"] + 2 * c["c"]
    total = ml.shapley(d, ["site_id", "node_id"], ["a", "b", "c"], score).groupBy("node_id").agg(F.sum("attribution").alias("s"))
    base = d.agg((F.avg("a") * F.avg("b") + 2 * F.avg("c")).alias("m")).first()["m"]
    for r in total.join(d, "node_id").collect():
        assert math.isclose(r["s"], r["a"] * r["b"] + 2 * r["c"] - base, abs_tol=1e-9)


def test_driving_band_ranks_first(spark):
    g = random.Random(4)
    rows = [(k, 0, int((x := g.gauss(0, 1)) > 0), g.gauss(0, 1), x, g.gauss(0, 1)) for k in range(300)]
    d = spark.createDataFrame(rows, "id long, fold int, y int, b0 double, b1 double, b2 double")
    m = ml.PixelClassifier(["b0", "b1", "b2"], 50).fit(d)
    assert one(metrics.auc(d.select(F.col("y").alias("label"), m.probability().alias("score")), []))["auc"] > 0.95
    assert ml.permutation_importance(d, ["b0", "b1", "b2"], m.probability, repeats=2).first()["feature"] == "b1"
    flat = [0.3, 0.9, -0.2]  # a probability that is not so near to 0 or 1 that rounding makes ties
    given = lambda of: 1 / (1 + F.exp(-sum(w * of.get(f"b{k}", F.col(f"b{k}")) for k, w in enumerate(flat))))
    quick, plain = (ml.permutation_importance(d, ["b0", "b1", "b2"], repeats=3, **how).collect() for how in ({"weights": flat}, {"probability": given}))
    assert [r["feature"] for r in quick] == [r["feature"] for r in plain]  # ranks of a score are those of its probability
    assert all(math.isclose(a["mean"], b["mean"], abs_tol=1e-9) and math.isclose(a["std"], b["std"], abs_tol=1e-9) for a, b in zip(quick, plain, strict=True))
    report = one(ml.signal_report(d.filter("id < 200"), d.filter("id >= 200"), ["b0", "b1", "b2"], repeats=2))
    assert report["importance"][0]["feature"] == "b1" and report["auc_there"] > 0.95 and len(report["importance"]) == 3
    with pytest.raises(ValueError):
        ml.PixelClassifier(["b0"]).fit(d.filter("y = 1"))


def test_importance_against_scores_one_by_one(spark):
    """Groups of folds keep to themselves; ties, a row without fold and clashing names of helper columns' kind do no harm."""
    g = random.Random(9)
    rows = [(k, k % 2, int(g.random() < 0.5), float(g.randrange(4)), float(g.randrange(3)), k) for k in range(40)]
    d = spark.createDataFrame([*rows, (99, None, 1, 1.0, 1.0, 0)], "id long, fold int, y int, a double, b double, k int")
    w, of = [0.5, -0.25], {r[0]: r for r in rows}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    def auc(score):
        bad, good = ([score[k] for k in of if of[k][2] == kind] for kind in (1, 0))
        return sum((p > q) + (p == q) / 2 for p in bad for q in good) / (len(bad) * len(good))

    base = {k: w[0] * r[3] + w[1] * r[4] for k, r in of.items()}
    want = {}
    for f in range(2):
        drops = []
        for n in range(3):
            score = {}
            for fold in (0, 1):
                ids = [k for k in of if of[k][1] == fold]
                for k, donor in zip(sorted(ids, key=lambda k: md5(str(k))), sorted(ids, key=lambda k: md5(f"5:{n}:{k}")), strict=True):
                    score[k] = base[k] + w[f] * (of[donor][3 + f] - of[k][3 + f])
            drops.append(auc(base) - auc(score))
        want["ab"[f]] = (sum(drops) / 3, (sum(x * x for x in drops) / 3 - (sum(drops) / 3) ** 2) ** 0.5)
    out = {r["feature"]: r for r in ml.permutation_importance(d, ["a", "b"], repeats=3, seed=5, weights=w).collect()}
    # the row without fold does not count in the base either
    assert all(math.isclose(out[f]["mean"], m, abs_tol=1e-9) and math.isclose(out[f]["std"], s, abs_tol=1e-7) for f, (m, s) in want.items())


def test_sources_and_sinks(spark, tmp_path):
    d = policy.decide_policy(spark.createDataFrame([(0, 1, 0.9, 0.1, 0.1, 0.8, False), (1, 2, None, 0.1, 0.1, 0.8, False)], HEADS))
    readers.write_policy(d, f"{tmp_path}/policy")
    assert {r["action"] for r in readers.read_policy(spark, f"{tmp_path}/policy").collect()} == {"compensated_resettlement", "insufficient_evidence"}
    (tmp_path / "a.json").write_text('[{"tile_id": "t", "path": "p", "row_off": 0, "col_off": 0, "valid_fraction": 1.0, "split": "train"}]')
    rows, absent = readers.read_manifests(spark, {"a": f"{tmp_path}/a.json", "b": f"{tmp_path}/none.json"})
    assert rows.count() == 1 and [r[0] for r in absent.collect()] == ["b"]
    with pytest.raises(ValueError):
        readers.read_manifests(spark, {"b": f"{tmp_path}/none.json"}, require_all=True)
    assert readers.newest_file(spark, [str(tmp_path / "none")], "x") is None
    assert readers.newest_file(spark, [str(tmp_path)], "a").endswith("a.json")
    (tmp_path / "z.geojson").write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[36.8, -1.3], [36.81, -1.3], [36.81, -1.29], [36.8, -1.3]]]}}]}')
    assert readers.read_zones(spark, f"{tmp_path}/z.geojson").count() == 3
    ring = [[(36.8, -1.3), (36.801, -1.3), (36.801, -1.299), (36.8, -1.299)]]
    feats = spark.createDataFrame([(0, 7, "Polygon", ring, {"building": "yes"}), (0, 8, "Point", [[(36.8, -1.3)]], {"amenity": "toilets"})], "site_id int, feature_id long, geom_type string, rings array<array<struct<x: double, y: double>>>, tags map<string, string>")
    feats.write.parquet(f"{tmp_path}/features")
    foot = one(readers.read_footprints(spark, f"{tmp_path}/features"))
    assert foot["node_id"] == 0 and 12_000 < foot["area_m2"] < 12_600
    assert one(readers.read_infra(spark, f"{tmp_path}/features"))["category"] == "sanitation"


def test_parts_holes_and_lines(spark, tmp_path):
    outline = lambda x, y, n: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    d = spark.createDataFrame([([outline(0.0, 0.0, 4.0), outline(1.0, 1.0, 2.0)[::-1], outline(10.0, 0.0, 2.0)],)], "rings array<array<struct<x: double, y: double>>>")
    x, y = geo.rings_centroid(F.col("rings"))
    got = d.select(geo.rings_area(F.col("rings")), x, y).first()
    assert all(math.isclose(a, b) for a, b in zip(got, (16.0, (16 * 2 - 4 * 2 + 4 * 11) / 16, (16 * 2 - 4 * 2 + 4 * 1) / 16), strict=True))
    line = spark.createDataFrame([([(0.0, 0.0), (8.0, 0.0), (8.0, 2.0)],), ([(3.0, 5.0)],)], "line array<struct<x: double, y: double>>")
    x, y = geo.line_centroid(F.col("line"))
    assert [tuple(r) for r in line.select(x, y).collect()] == [((8 * 4 + 2 * 8) / 10, (2 * 1) / 10), (3.0, 5.0)]
    ring = "[[36.8, -1.3], [36.81, -1.3], [36.81, -1.29], [36.8, -1.3]]"
    for name, kind, coordinates in (("many", "MultiPolygon", f"[[{ring}], [{ring}, {ring}]]"), ("point", "Point", "[36.8, -1.3]")):
        (tmp_path / name).write_text(f'{{"features": [{{"geometry": {{"type": "{kind}", "coordinates": {coordinates}}}}}]}}')
    assert readers.read_zones(spark, f"{tmp_path}/many").count() == 9
    with pytest.raises(Exception, match="no polygon"):
        readers.read_zones(spark, f"{tmp_path}/point").collect()


def test_numbers_and_ranks_by_ranges(spark):
    g = random.Random(6)
    rows = [(g.choice([0, 0, 0, 1, None]), g.choice([None, *range(500)]), k, g.random() < 0.4) for k in range(3000)]
    d = spark.createDataFrame(rows, "site_id int, v long, id long, label boolean").withColumn("label", F.col("label").cast("int"))
    got = number_within(d, ["site_id"], range_bucket(d, "v"), ["v", "id"], "number", "size").collect()
    for site in (0, 1, None):
        mine = sorted((r for r in got if r["site_id"] == site), key=lambda r: r["number"])
        assert [r["number"] for r in mine] == list(range(1, len(mine) + 1)) and {r["size"] for r in mine} == {len(mine)}
        place = [(r["v"] is not None, r["v"], r["id"]) for r in mine]
        assert place == sorted(place)
    known = [(v, r["label"]) for r in got if (v := r["v"]) is not None]
    want = sum((a > b) + (a == b) / 2 for a, x in known if x for b, y in known if not y) / (sum(x for _, x in known) * sum(not x for _, x in known))
    assert math.isclose(one(metrics.auc(d, [], "v"))["auc"], want)


def test_graph_branch_and_stream(spark, tmp_path):
    p = spark.createDataFrame([(0, k, 10.0 * (k % 6), 10.0 * (k // 6), 20.0 + k, "tin" if k % 2 else None) for k in range(24)], "site_id int, node_id long, x double, y double, area_m2 double, roof_material string")
    i = spark.createDataFrame([(0, 0, "water", 0.0, 0.0), (0, 1, "road", 50.0, 30.0)], "site_id int, infra_id long, category string, x double, y double")
    out = pipelines.graph_branch(p, i)
    assert out["nodes"].count() == 24 and one(out["integrity"])["components"] == 1
    spark.createDataFrame([(0, 1, 0.9, 0.1, 0.1, 0.8, False)], HEADS).write.parquet(f"{tmp_path}/heads")
    q = decide_stream(spark, f"{tmp_path}/heads").writeStream.format("memory").queryName("decided").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("decided").count() == 1


SQUARE = "rings array<array<struct<x: double, y: double>>>"


def box(x0, y0, x1, y1, back=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return ring[::-1] if back else ring


def test_holes_are_told_by_where_they_lie(spark):
    """However rings turn: parts of 100 and 64 give 164, a hole of 16 in 100 gives 84, an island in the hole counts again."""
    cases = [
        ([box(0.0, 0.0, 10.0, 10.0), box(20.0, 0.0, 28.0, 8.0, True)], 164.0), ([box(0.0, 0.0, 10.0, 10.0), box(2.0, 2.0, 6.0, 6.0)], 84.0), ([box(2.0, 2.0, 6.0, 6.0), box(0.0, 0.0, 10.0, 10.0, True), box(3.0, 3.0, 4.0, 5.0)], 86.0),
        ([box(0.0, 0.0, 10.0, 10.0), box(0.0, 0.0, 5.0, 5.0)], 75.0), ([box(0.0, 0.0, 4.0, 4.0)], 16.0), ([box(0.0, 0.0, 4.0, 4.0), box(4.0, 0.0, 8.0, 4.0)], 32.0),
    ]
    d = spark.createDataFrame([(k, rings) for k, (rings, _) in enumerate(cases)], f"k int, {SQUARE}")
    x, y = geo.rings_centroid(F.col("rings"))
    got = d.select("k", geo.rings_area(F.col("rings")).alias("a"), x.alias("x"), y.alias("y")).orderBy("k").collect()
    assert [r["a"] for r in got] == [a for _, a in cases]
    assert math.isclose(got[0]["x"], (100 * 5 + 64 * 24) / 164) and math.isclose(got[1]["y"], (100 * 5 - 16 * 4) / 84)
    flat = spark.createDataFrame([([[(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)]],), ([],)], SQUARE)
    x, y = geo.rings_centroid(F.col("rings"))
    assert [tuple(r) for r in flat.select(x, y, geo.rings_area(F.col("rings"))).collect()] == [(2.0, 0.0, 0.0), (None, None, 0.0)]
    far = spark.createDataFrame([([box(255_000.0, 9_856_000.0, 255_003.0, 9_856_002.0)],)], SQUARE)
    assert far.select(geo.rings_area(F.col("rings"))).first()[0] == 6.0


def test_lines_of_several_parts_are_weighed_by_length(spark):
    d = spark.createDataFrame([([[(0.0, 0.0), (8.0, 0.0)], [(0.0, 10.0), (0.0, 12.0)]],), ([[(1.0, 1.0)], [(3.0, 5.0)]],)], SQUARE)
    x, y = geo.lines_centroid(F.col("rings"))
    assert [tuple(r) for r in d.select(x, y).collect()] == [((8 * 4 + 2 * 0) / 10, (8 * 0 + 2 * 11) / 10), (2.0, 3.0)]


def test_footprints_meet_zones(spark):
    """Crossing, touching, inside, around, in a hole, in a part far away, and a long edge over many cells."""
    zone = lambda k, b: [(k, i, *p, *q) for i, (p, q) in enumerate(zip(b, b[1:] + b[:1], strict=True))]
    edges = spark.createDataFrame(zone(0, box(0.0, 0.0, 2.0, 2.0)) + zone(1, box(100.0, 100.0, 400.0, 400.0)) + zone(1, box(200.0, 200.0, 300.0, 300.0)) + zone(2, box(900.0, 900.0, 901.0, 901.0)), "zone_id int, edge_no int, x1 double, y1 double, x2 double, y2 double")
    cases = {
        0: ([box(0.0, 0.0, 1.0, 1.0)], True), 1: ([box(5.0, 5.0, 6.0, 6.0)], False), 2: ([box(2.0, 2.0, 3.0, 3.0)], True), 3: ([box(-5.0, -5.0, 7.0, 7.0)], True), 4: ([box(220.0, 220.0, 280.0, 280.0)], False), 5: ([box(110.0, 110.0, 120.0, 120.0)], True),
        6: ([box(50.0, 50.0, 51.0, 51.0), box(150.0, 150.0, 151.0, 151.0)], True), 7: ([box(2.0001, 0.0, 3.0, 1.0)], False), 8: ([[(500.0, 500.0), (1500.0, 1500.0), (1500.0, 1499.0)]], True), 9: ([box(850.0, 850.0, 950.0, 950.0), box(870.0, 870.0, 930.0, 930.0)], False), 10: ([], False), 11: ([box(210.0, 250.0, 320.0, 260.0)], True), 12: ([[(1.0, 1.0)]], True),
    }
    d = spark.createDataFrame([(k % 2, k, r) for k, (r, _) in cases.items()], f"site_id int, node_id long, {SQUARE}")
    want = {k: inside for k, (_, inside) in cases.items()}
    for cell in (7.0, 50.0, 5000.0):
        assert {r["node_id"]: r["inside_zone"] for r in spatial.footprints_in_zone(d, edges, cell).collect()} == want
    assert not spatial.footprints_in_zone(d, edges.limit(0)).filter("inside_zone").count() and spatial.footprints_in_zone(d.limit(0), edges).count() == 0


def test_sinks_replace_sites_and_survive_failure(spark, tmp_path):
    path = str(tmp_path / "policy")
    d = spark.createDataFrame([(s, k, 0) for s in (0, 1) for k in range(3)], "site_id int, node_id long, action_index int")
    readers.write_policy(d.filter("site_id = 0"), path)
    readers.write_policy(d.filter("site_id = 1"), path)
    counts = lambda: {(r["site_id"], r["n"]) for r in readers.read_policy(spark, path).groupBy("site_id").agg(F.count("*").alias("n")).collect()}
    assert counts() == {(0, 3), (1, 3)}
    failing = d.withColumn("action_index", F.when(F.col("node_id") == 2, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("action_index")))
    with pytest.raises(Exception, match="broken"):
        readers.write_policy(failing, path)
    assert counts() == {(0, 3), (1, 3)} and sorted(p.name for p in (tmp_path / "policy").iterdir() if not p.name.startswith(".")) == ["_commits", "site_id=0", "site_id=1"]
    readers.write_policy(d.filter("site_id = 1 AND node_id = 0"), path)
    assert counts() == {(0, 3), (1, 1)}
    assert {(r["site_id"], r["n"]) for r in readers.read_commits(spark, path).groupBy("site_id").agg(F.count("*").alias("n")).collect()} == {("0", 1), ("1", 2)}
    report = str(tmp_path / "report")
    readers.write_report(d.limit(2), report)
    with pytest.raises(Exception, match="broken"):
        readers.write_report(failing, report)
    assert spark.read.json(report).count() == 2 and [p.name for p in tmp_path.iterdir() if p.name.startswith("report-")] == []


def test_a_failing_site_does_not_stop_the_others(spark):
    rows = [(str(s), str(k), str(3 * k), "0", "20", "tin") for s in (0, 1) for k in range(25)] + [("1", "7", "1", "1", "20", None), ("1", "x", "1", "1", "20", None), ("1", "90", "Infinity", "1", "20", None), ("2", "1", None, "0", "20", None), (None, "5", "1", "1", "1", None), ("0", "91", "1", "1", "-4", None)]
    p = spark.createDataFrame(rows, "site_id string, node_id string, x string, y string, area_m2 string, roof_material string")
    i = spark.createDataFrame([("0", "1", "water", "0", "0"), ("0", "2", "road", "?", "0"), ("1", "3", None, "0", "0")], "site_id string, infra_id string, category string, x string, y string")
    out = pipelines.run_all_sites(p, i, [0, 1, 2, 3], tolerated=0.05)
    status = {r["site_id"]: (r["status"], r["reason"], r["parcels"], r["rejected"]) for r in out["status"].collect()}
    assert status == {0: ("ok", None, 26, 1), 1: ("failed", "repeated node_id", 28, 4), 2: ("failed", "no position", 1, 1), 3: ("failed", "no parcels", 0, 0)}
    assert {r["site_id"] for r in out["nodes"].collect()} == {0} and out["nodes"].count() == 25
    assert {(r["source"], r["site_id"], r["key"], r["reason"]) for r in out["rejected"].collect()} == {
        ("parcels", 1, "7", "repeated node_id"), ("parcels", 1, None, "node_id is no number"), ("parcels", 1, "90", "no position"), ("parcels", 2, "1", "no position"), ("parcels", None, "5", "site_id is no number"), ("parcels", 0, "91", "no area"),
        ("infra", 0, "2", "no position"), ("infra", 1, "3", "no category"),
    }


def test_f1_of_counts_where_they_are_few(spark):
    d = spark.createDataFrame([(1, 999_999, 999_999, 1)], "tp long, fp long, fn long, tn long")
    assert math.isclose(metrics.pixel_scores(d).first()["f1"], 2 / (2 + 2 * 999_999 + 1e-7), rel_tol=1e-12)


def test_manifests_of_lines_and_of_one_array(spark, tmp_path):
    one_tile = '{"tile_id": "t%d", "path": "p", "row_off": 0, "col_off": 0, "valid_fraction": 1.0, "split": "train"}'
    (tmp_path / "lines.json").write_text("\n".join(one_tile % k for k in range(3)))
    (tmp_path / "array.json").write_text("\n [\n" + ",\n".join(one_tile % k for k in range(4)) + "\n]\n")
    (tmp_path / "none.json").write_text("")
    rows, absent = readers.read_manifests(spark, {k: f"{tmp_path}/{k}.json" for k in ("lines", "array", "none", "gone")})
    assert {r["site_key"]: r["n"] for r in rows.groupBy("site_key").agg(F.count("*").alias("n")).collect()} == {"lines": 3, "array": 4} and {r[0] for r in absent.collect()} == {"none", "gone"}


def test_percentiles_by_counting(spark):
    """Equal to the buffered ones for groups that are small or large for the sketch, ties, NULLs, one value and a NULL key."""
    g = random.Random(12)
    rows = [("a", g.gauss(0, 1)) for _ in range(3000)] + [("b", float(g.choice([1, 2, 2, 3]))) for _ in range(2000)] + [("c", 5.0), ("d", None), (None, 1.0), (None, 4.0)] + [("e", float(k)) for k in range(7)] + [("a", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.01, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    want = {r["k"]: (r["n"], r["p"]) for r in d.filter("v IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.percentile("v", shares).alias("p")).collect()}
    for accuracy in (20, 100, 10_000):
        assert {r["k"]: (r["n"], r["percentiles"]) for r in quantiles.percentiles(d, ["k"], "v", shares, accuracy).collect()} == want
    whole = quantiles.percentiles(d, [], "v", [0.5], 50).first()
    assert whole["percentiles"] == d.agg(F.percentile("v", [0.5])).first()[0]
    assert quantiles.percentiles(d.limit(0), ["k"], "v", [0.5]).count() == 0
    plan = quantiles.percentiles(d, ["k"], "v", shares)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
    with pytest.raises(ValueError):
        quantiles.percentiles(d, ["k"], "v", [1.5])


PX = "site_id int, row int, col int, v double"


def test_focal_mean_of_a_ragged_grid(spark):
    g = random.Random(3)
    rows = [(s, r, c, g.choice([None, g.random()])) for s in (0, 1) for r in range(-3, 12) for c in range(9) if g.random() < 0.6]
    known = {(s, r, c): v for s, r, c, v in rows if v is not None}
    for radius in (0, 1, 4):
        got = {(r["site_id"], r["row"], r["col"]): r["focal"] for r in rasters.focal_mean(spark.createDataFrame(rows, PX), "v", radius).collect()}
        assert len(got) == len(rows)
        for (s, r, c), mean in got.items():
            near = [v for (z, a, b), v in known.items() if z == s and (a - r) ** 2 + (b - c) ** 2 <= radius * radius]
            assert (mean is None) if not near else math.isclose(mean, sum(near) / len(near), rel_tol=1e-9)


def test_blobs_over_many_blocks(spark):
    """Blobs that cross the borders of blocks, corners included, are one; the size of a block changes nothing."""
    g = random.Random(5)
    true = {(s, r, c) for s in (0, 1) for r in range(-5, 25) for c in range(25) if g.random() < 0.35}
    left, want = set(true), set()
    while left:
        blob, todo = set(), [left.pop()]
        while todo:
            s, r, c = todo.pop()
            blob.add((s, r, c))
            near = {(s, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        want |= blob if len(blob) >= 6 else set()
    d = spark.createDataFrame([(*p, 1.0) for p in true], PX)
    for block in (4, 64):
        assert {tuple(r) for r in rasters.small_blobs_dropped(d, 6, block).collect()} == want
    assert rasters.small_blobs_dropped(d.limit(0), 6).count() == 0 and rasters.small_blobs_dropped(d, 1).count() == len(true)


def test_stack_of_unlike_tables(spark):
    first = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, None)], "site_id int, row int, col int, b2 double")
    radar = spark.createDataFrame([(0, 0, 1, -5.0, -9.0), (0, 9, 9, -5.0, -9.0)], "site_id int, row int, col int, pre_vv double, event_vv double")
    label = spark.createDataFrame([(0, 0, 0, 1)], "site_id int, row int, col int, flood int")
    full = rasters.build_stack({"optical": first, "radar": radar}, label, "event").orderBy("col")
    assert full.columns == ["site_id", "row", "col", "b2", "pre_vv", "event_vv", "flood_label"] and [tuple(r) for r in full.collect()] == [(0, 0, 0, 1.0, None, None, 1), (0, 0, 1, None, -5.0, -9.0, None)]
    assert rasters.build_stack({"optical": first, "radar": radar}, label, "seasonal", include_s1=False).columns == ["site_id", "row", "col", "b2", "flood_label"]
    assert full._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    for wrong in (lambda: rasters.build_stack({"a": first}, label, "weekly"), lambda: rasters.build_stack({"a": first, "b": first}, label, "event")):
        with pytest.raises(ValueError):
            wrong()


def test_copies_at_one_position_need_no_pairs(spark):
    g = random.Random(8)
    rows = [(0, k, float(g.randrange(12) * 9), float(g.randrange(12) * 9)) for k in range(400)] + [(0, 500, None, 1.0), (0, 501, None, 1.0), (0, 502, float("nan"), 1.0), (1, 7, 0.0, 0.0), (1, 9, -0.0, 0.0)]
    nodes = spark.createDataFrame(rows, NODE)
    members, places = graph.spots(nodes)
    near = graph.proximity_edges(places)
    assert near.count() < graph.proximity_edges(nodes).count() / 4
    edges = graph.proximity_edges(nodes)
    labels, spot_labels = graph.components(nodes, edges), graph.components(places, near)
    want = graph.integrity(nodes, edges, labels).orderBy("site_id").collect()
    assert graph.integrity(places, near, spot_labels).orderBy("site_id").collect() == want and [r["edges"] for r in want] == [edges.filter("site_id = 0").count(), 1]
    back = members.join(spot_labels.withColumnRenamed("node_id", "spot"), ["site_id", "spot"]).select("site_id", "node_id", "component")
    assert set(back.collect()) == set(labels.collect())
    assert {r["node_id"] for r in members.join(graph.large(places, spot_labels, 2).withColumnRenamed("node_id", "spot"), ["site_id", "spot"]).collect()} == {r["node_id"] for r in graph.prune(nodes, edges, labels, 2)[0].collect()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rings_are_worked_on_after_the_shuffle(spark, tmp_path):
    rows = [(0, k, "Polygon", [[(36.8, -1.3), (36.8001, -1.3), (36.8001, -1.2999)]], {"amenity": "toilets"}) for k in range(5)]
    d = spark.createDataFrame(rows, "site_id int, feature_id long, geom_type string, rings array<array<struct<x: double, y: double>>>, tags map<string, string>")
    d.coalesce(1).write.parquet(path := str(tmp_path / "f"))
    for read, n in ((readers.read_footprints, 5), (readers.read_infra, 5)):
        out = read(spark, path)
        plan = _plan(out)
        assert out.count() == n and plan.rindex("Exchange hashpartitioning(site_id") > plan.rindex("atan2".upper())  # lower in the tree


def test_an_edge_is_in_a_cell_once_without_a_shuffle(spark):
    e = spark.createDataFrame([(0.0, 0.0, 95.0, 40.0), (5.0, 5.0, 5.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    out = spatial._along(e, 10.0)
    assert out.count() == out.distinct().count() > 10 and "Exchange" not in _plan(out)


def test_joins_of_nodes_and_edges_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(0, k, float(k), 0.0) for k in range(50)], NODE).write.parquet(path := str(tmp_path / "n"))
    nodes = spark.read.parquet(path)
    edges = graph.proximity_edges(nodes, 1.0)
    for d in (edges, graph.degrees(nodes, edges), graph.isolated_sample(nodes, edges), graph.neighbour_mean(nodes, edges, ["x"])):
        assert "BroadcastHashJoin" not in _plan(d)
    labels = graph.components(nodes, edges)
    for d in (labels, *graph.prune(nodes, edges, labels, 2), graph.integrity(nodes, edges, labels)):
        assert "BroadcastHashJoin" not in _plan(d)


def test_first_cell_of_a_strip_is_as_dense_as_its_targets(spark, monkeypatch):
    sizes, grid = [], spatial.grid
    monkeypatch.setattr(spatial, "grid", lambda df, size, *xy: sizes.append(size) or grid(df, size, *xy))
    nodes = spark.createDataFrame([(0, k, k * 100.0, 50.0) for k in range(1000)], NODE)
    infra = spark.createDataFrame([(0, k, "water", k * 100.0 + 3, k % 2 * 100.0) for k in range(1000)], "site_id int, infra_id long, category string, x double, y double")
    assert {round(r["d"], 9) for r in spatial.nearest_each(nodes, infra, ["water"]).collect()} == {round(math.hypot(3, 50), 9)}
    assert set(sizes) == {max(sizes)} and max(sizes) < 150  # one round


def test_auc_of_ranks_equals_auc_of_counts(spark):
    g = random.Random(4)
    d = spark.createDataFrame([(k % 3, round(g.random(), g.choice([1, 6])), int(g.random() < 0.4) if k % 3 else 1) for k in range(600)] + [(1, None, 1)], "k int, score double, label int")
    a, b = (metrics.auc(d, ["k"], ranges=ranges).orderBy("k").collect() for ranges in (None, range_bucket(d, "score")))
    assert a == b
    assert metrics.auc(d, [], ranges=range_bucket(d, "score")).collect() == metrics.auc(d, []).collect()


def test_search_sends_targets_around_and_distances_are_worked_out_once(spark, monkeypatch):
    sent, real = [], spatial.neighbouring
    monkeypatch.setattr(spatial, "neighbouring", lambda d, *a: sent.append(set(d.columns)) or real(d, *a))
    parcels = spark.createDataFrame([(0, k, 10.0 * k, 1.0, 20.0, "tin") for k in range(40)] + [(1, 1, 0.0, 0.0, 20.0, None)], S.PARCEL)
    infra = spark.createDataFrame([(0, 1, "water", 0.0, 1.0), (0, 2, "water", 333.0, 5.0), (1, 3, "road", 3.0, 4.0)], S.INFRA)
    out = features.with_distances(parcels, infra)
    assert sent and all("tx" in columns and "node_id" not in columns for columns in sent)
    assert _plan(out).count("Join") == 1  # the wide table is read, not joined anew for every column
    got = {(r["site_id"], r["node_id"]): (r["dist_to_water_m"], r["dist_to_road_m"]) for r in out.collect()}
    assert len(got) == 41 and got[1, 1] == (0.0, 5.0)
    for k in range(40):
        assert got[0, k] == (min(10.0 * k, math.hypot(10 * k - 333, 4)), 0.0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["integrity", "pruned_graph"])
def test_pairs_are_searched_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" not in plan  # the components have met the same pairs before


def test_nodes_are_dealt_out_before_they_are_multiplied(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, k, 10.0 * k, 0.0) for k in range(40)], NODE)
    dealt = "REPARTITION_BY_COL"
    assert dealt in _plan(graph.proximity_edges(nodes)).partition("Generate")[2]  # lower in the tree
    todo, grid = [], spatial.grid
    monkeypatch.setattr(spatial, "grid", lambda df, *a: todo.append(df) or grid(df, *a))
    infra = spark.createDataFrame([(0, 1, "water", 0.0, 1.0)], "site_id int, infra_id long, category string, x double, y double")
    assert spatial.nearest_each(nodes, infra, ["water"]).count() == 40
    first = next(d for d in todo if "node_id" in d.columns)
    assert dealt in _plan(first).partition("Join")[2]
