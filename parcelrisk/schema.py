"""Dimensions and constants of the domain."""

from __future__ import annotations

# Names, matrix, scores and thresholds that results must carry.
CLASSES = ("low", "medium", "high")
ACTIONS = ("retain_formalise", "retain_upgrade", "in_situ_upgrade_priority", "flood_resilient_upgrade", "compensated_resettlement")
INSUFFICIENT = "insufficient_evidence"
#: action of (flood low or high, deprivation class)
MATRIX = ((0, 1, 2), (3, 3, 4))
RESILIENT, RESETTLE = 3, 4
ROOF_SCORES = {"concrete": 0.0, "tiles": 0.1, "tile": 0.1, "metal": 0.25, "tin": 0.3, "corrugated": 0.3, "iron": 0.3, "asbestos": 0.45, "wood": 0.55, "thatch": 0.85, "plastic": 0.9, "tarpaulin": 0.95, "cardboard": 1.0, "mud": 0.9, "grass": 0.9}
WATER_M, SANITATION_M, ROAD_M, CROWDED_M2 = 200.0, 200.0, 50.0, 25.0
EDGE_M, LEAST_COMPONENT, RIVER_BUFFER_M = 15.0, 20, 120.0
FLOOD_DB, STEEP_DEG, PERMANENT_PCT, LEAST_BLOB = -3.0, 5.0, 50.0, 8
FLOOD_THRESHOLD, LIFT_BAR = 0.5, 1.0
TILE, OVERLAP, LEAST_VALID = 256, 50, 0.6
DB_RANGE = (-30.0, 0.0)
DRY_MONTHS, RAINY_MONTHS = (1, 2, 6, 7, 8, 9), (3, 4, 5, 10, 11)
AGREEMENT_EPS, PIXEL_EPS = 1e-9, 1e-7

# DDL of the tables that operators pass on.
PARCEL = "site_id int, node_id long, x double, y double, area_m2 double, roof_material string"
INFRA = "site_id int, infra_id long, category string, x double, y double"
EDGE = "site_id int, src long, dst long"
MANIFEST = "tile_id string, path string, row_off int, col_off int, valid_fraction double, split string, site_key string"
FEATURE = "site_id int, feature_id long, geom_type string, rings array<array<struct<x: double, y: double>>>, tags map<string, string>"
