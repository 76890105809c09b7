"""Domain tables derived from the given ones by plain expressions, which Spark and other SQL engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EVENT_START = "TIMESTAMP_NTZ '1998-07-01 00:00:00'"
_HASH = "({k}%97)*({k}%97)*31"

#: name: (tables it reads, FROM clause, {column: expression}, WHERE clause)
FIXTURES: dict[str, tuple[list[str], str, dict[str, str], str]] = {
    "parcel": (["customer"], "customer", {
        "site_id": "CAST(c_custkey % 3 AS INT)",
        "node_id": "c_custkey",
        "x": f"floor(c_custkey / 1500) * 1000e0 + ((c_custkey*7919 + {_HASH.format(k='c_custkey')}) % 3470) / 10e0",
        "y": f"((c_custkey*104729 + {_HASH.format(k='c_custkey')}) % 3470) / 10e0",
        "area_m2": "8e0 + abs(c_acctbal) / 100e0",
        "roof_material": "CASE c_mktsegment WHEN 'FURNITURE' THEN 'Wood' WHEN 'MACHINERY' THEN 'metal;thatch' WHEN 'AUTOMOBILE' THEN ' tin ' WHEN 'BUILDING' THEN 'concrete' END",
    }, ""),
    "infra": (["supplier"], "supplier", {
        "site_id": "CAST(floor(s_suppkey / 3) % 3 AS INT)",
        "infra_id": "s_suppkey",
        "category": "CASE s_suppkey % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'sanitation' ELSE 'road' END",
        "x": f"floor(s_suppkey / 100) * 1000e0 + ((s_suppkey*6151 + {_HASH.format(k='s_suppkey')}) % 3470) / 10e0",
        "y": f"((s_suppkey*3571 + {_HASH.format(k='s_suppkey')}) % 3470) / 10e0",
    }, "NOT (s_suppkey % 3 = 1 AND floor(s_suppkey / 3) % 3 = 2)"),
    "parcel_heads": (["customer"], "customer", {
        "site_id": "CAST(c_custkey % 3 AS INT)",
        "node_id": "c_custkey",
        "flood_proba": "CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN 1.5e0 ELSE (c_custkey * 37 % 101) / 100e0 END",
        "p_low": "CASE WHEN c_custkey % 67 = 0 THEN 0e0 ELSE (c_custkey * 13 % 17) / 20e0 END",
        "p_medium": "CASE WHEN c_custkey % 67 = 0 THEN 0e0 ELSE (c_custkey * 29 % 19) / 20e0 END",
        "p_high": "CASE WHEN c_custkey % 67 = 0 THEN 0e0 ELSE (c_custkey * 43 % 23) / 20e0 END",
        "inside_zone": "c_custkey * 53 % 100 < 25",
    }, ""),
    "scene_obs": (["lineitem"], "lineitem", {
        "site_id": "CAST(l_orderkey % 3 AS INT)",
        "row": "CAST(floor(l_orderkey / 3) % 48 AS INT)",
        "col": "CAST(l_partkey % 48 AS INT)",
        "ts": "l_shipdate",
        "is_event": f"l_shipdate >= {EVENT_START}",
        "qa": "CASE WHEN l_linenumber = 1 THEN 1024 WHEN l_linenumber = 2 THEN 2048 WHEN l_linenumber = 3 THEN 3 ELSE 0 END",
        "vv": f"-4e0 - l_quantity / 10e0 - CASE WHEN l_shipdate >= {EVENT_START} AND (floor(l_orderkey / 3) % 48 - 20) * (floor(l_orderkey / 3) % 48 - 20) + (l_partkey % 48 - 24) * (l_partkey % 48 - 24) <= 100 THEN 9e0 ELSE 0e0 END",
    }, ""),
    "terrain": (["lineitem"], "(SELECT DISTINCT CAST(l_orderkey % 3 AS INT) AS site_id, CAST(floor(l_orderkey / 3) % 48 AS INT) AS r, CAST(l_partkey % 48 AS INT) AS c FROM lineitem) AS px", {
        "site_id": "site_id",
        "row": "r",
        "col": "c",
        "elevation": "1600e0 + r * 0.5e0 + 3e0 * sin(c / 5e0)",
        "slope": "CASE WHEN (r * 5 + c) % 29 = 0 THEN NULL ELSE (r * 7 + c * 3) % 12 + 0e0 END",
        "occurrence": "CASE WHEN (r + c * 5) % 31 = 0 THEN NULL ELSE (r * 11 + c * 5) % 100 + 0e0 END",
    }, ""),
    "label_pairs": (["labels", "documents"], "labels JOIN documents USING (doc_id)", {
        "site": "lang",
        "id": "doc_id",
        "label": "quality",
        "other_label": "CAST(doc_id % 3 = 0 AS INT)",
        "reference": "toxic",
        "valid": "n_chars >= 200",
        "score": "(doc_id * 37 % 101) / 100e0",
    }, ""),
    "class_pairs": (["orders"], "orders", {
        "site_id": "CAST(o_custkey % 3 AS INT)",
        "id": "o_orderkey",
        "y": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 WHEN '3' THEN 1 ELSE 0 END",
        "pred": "CASE WHEN o_custkey % 5 < 3 THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 WHEN '3' THEN 1 ELSE 0 END ELSE CAST(o_orderkey * 11 % 3 AS INT) END",
    }, ""),
    "manifest": (["part"], "part", {
        "site_id": "CAST(p_partkey % 3 AS INT)",
        "entry_id": "p_partkey",
        "row_off": "CAST((p_partkey % 7) * 206 AS INT)",
        "col_off": "CAST((p_size % 5) * 206 AS INT)",
        "variant": "CASE p_partkey % 4 WHEN 0 THEN 'orig' WHEN 1 THEN 'flip_h' WHEN 2 THEN 'flip_v' ELSE 'rot90' END",
        "valid_fraction": "(p_partkey * 17 % 100) / 100e0",
    }, ""),
    "raw_parcel": (["customer"], "customer", {
        "site_id": "CAST(c_custkey % 4 AS VARCHAR(9))",
        "node_id": "CASE WHEN c_custkey % 4 = 2 AND c_custkey % 101 = 7 THEN 'way/' ELSE '' END || CAST(c_custkey AS VARCHAR(9))",
        "x": f"CASE WHEN c_custkey % 4 = 2 AND c_custkey % 31 = 3 THEN NULL ELSE CAST((c_custkey*7919 + {_HASH.format(k='c_custkey')}) % 347 AS VARCHAR(9)) END",
        "y": f"CASE WHEN c_custkey % 4 = 2 AND c_custkey % 37 = 5 THEN 'n/a' ELSE CAST((c_custkey*104729 + {_HASH.format(k='c_custkey')}) % 347 AS VARCHAR(9)) END",
        "area_m2": "CASE WHEN c_custkey % 4 = 3 AND c_custkey % 200 = 3 THEN 'unknown' ELSE CAST(8 + c_nationkey AS VARCHAR(9)) END",
        "roof_material": "'tin'",
    }, ""),
    "outline": (["customer"], "customer", {
        "site_id": "CAST(c_custkey % 3 AS INT)",
        "node_id": "c_custkey",
        "lon": "36.8e0 + ((c_custkey*7919) % 3470) * 1e-6",
        "lat": "-1.3e0 + ((c_custkey*104729) % 3470) * 1e-6",
        "x": f"((c_custkey*7919 + {_HASH.format(k='c_custkey')}) % 3470) / 10e0",
        "y": f"((c_custkey*104729 + {_HASH.format(k='c_custkey')}) % 3470) / 10e0",
        "side": "4e0 + c_nationkey",
        "kind": "CAST(c_custkey % 5 AS INT)",
    }, ""),
    "zone_edge": (["region"], "region CROSS JOIN (VALUES (0, 0e0, 0e0, 80e0, 0e0), (1, 80e0, 0e0, 80e0, 40e0), (2, 80e0, 40e0, 40e0, 40e0), (3, 40e0, 40e0, 40e0, 90e0), (4, 40e0, 90e0, 0e0, 90e0), (5, 0e0, 90e0, 0e0, 0e0)) AS e(k, vx1, vy1, vx2, vy2)", {
        "zone_id": "r_regionkey",
        "edge_no": "k",
        "x1": "vx1 + r_regionkey * 65e0 + 0.05e0",
        "y1": "vy1 + r_regionkey * 50e0 + 0.05e0",
        "x2": "vx2 + r_regionkey * 65e0 + 0.05e0",
        "y2": "vy2 + r_regionkey * 50e0 + 0.05e0",
    }, ""),
    "line_segment": (["nation"], "nation", {
        "line_id": "n_nationkey",
        "x1": "n_nationkey * 14e0",
        "y1": "(n_nationkey * 37 % 25) * 13e0",
        "x2": "n_nationkey * 14e0 + 14e0",
        "y2": "((n_nationkey + 1) * 37 % 25) * 13e0",
    }, ""),
}


def _select(name: str, source: str) -> str:
    _, _, columns, where = FIXTURES[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}" + (f" WHERE {where}" if where else "")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, source, _, _ = FIXTURES[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        source = re.sub(rf"\b{t}\b", f"{{{t}}}", source)
    return spark.sql(_select(name, source), **frames)


def fixture_sql(name: str) -> str:
    """The fixture as a query of an engine that has the given tables as views."""
    return _select(name, FIXTURES[name][1]).replace("TIMESTAMP_NTZ", "TIMESTAMP")


def with_fixtures(sql: str) -> str:
    """``sql`` behind a WITH of every fixture that it names; it may begin with WITH itself."""
    used = [f"{n} AS ({fixture_sql(n)})" for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    body = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s", body, re.I)
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        body = ", " + body[m.end() :]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(used) + " " + body if used else sql
