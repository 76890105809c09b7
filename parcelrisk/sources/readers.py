"""Reading and writing the domain's tables. NaN becomes NULL on the way in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelrisk import schema as S
from parcelrisk.functions import geo, parcels
from parcelrisk.operators.numbering import number_within, range_bucket


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def _features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=S.FEATURE) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    """Polygons in degrees to parcels in metres: site_id, node_id (dense per site, in order of the feature), x, y, area_m2, tags, rings.

    All parts of a MultiPolygon count, and holes are taken off: rings that lie in an odd number of the others, however they turn.
    """
    d = _features(spark, path).filter(F.col("geom_type").isin("Polygon", "MultiPolygon"))
    numbered = number_within(d, ["site_id"], range_bucket(d, "feature_id"), ["feature_id"], "node_id")  # first, as its shuffle spreads a file that one task reads
    d = _placed(_metric(numbered).withColumn("facts", geo.ring_facts(F.col("rings"))))
    return d.select("site_id", (F.col("node_id") - 1).cast("long").alias("node_id"), "x", "y", geo.facts_area(F.col("facts")).alias("area_m2"), "tags", "rings")


def _metric(df: DataFrame) -> DataFrame:
    """``rings`` from degrees to metres."""
    return df.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, geo.metric_point)))


def _placed(df: DataFrame) -> DataFrame:
    """Adds x and y, the centroid by ``facts``, without area that of ``rings`` as lines."""
    x, y = geo.facts_centroid(F.col("facts"))
    d = df.withColumns({"x": x, "y": y})
    d = d.withColumn("as_lines", F.when(F.col("x").isNull(), geo.lines_centre(F.col("rings"))))
    return d.withColumns({c: F.coalesce(c, f"as_lines.{c}") for c in ("x", "y")}).drop("as_lines")


def read_infra(spark: SparkSession, path: str) -> DataFrame:
    """Features with a category by tag (one row per category) at their centroid, in metres: by area for polygons, by length for lines of any number of parts, the mean of points."""
    d = _features(spark, path).select("site_id", "feature_id", "geom_type", "rings", F.explode(parcels.infra_categories(F.col("tags"))).alias("category"))
    d = _metric(d.repartition("site_id", "feature_id"))  # a file may be read by one task
    areal = F.col("geom_type").isin("Polygon", "MultiPolygon")
    d = _placed(d.withColumn("facts", F.when(areal, geo.ring_facts(F.col("rings")))))
    return d.select("site_id", F.col("feature_id").alias("infra_id"), "category", "x", "y")


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Edges (zone_id, edge_no, x1, y1, x2, y2, in metres) of the polygons of a GeoJSON feature collection, all parts of a MultiPolygon included; holes are edges too. Another type of geometry fails."""
    raw = spark.read.schema("features array<struct<geometry: struct<type: string, coordinates: string>>>").json(path, multiLine=True)
    z = raw.select(F.posexplode("features").alias("zone_id", "f")).select("zone_id", "f.geometry.type", "f.geometry.coordinates")
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    unknown = F.raise_error(F.concat(F.lit("a zone is no polygon: "), F.coalesce("type", F.lit("no geometry")))).cast(one)
    polygon = F.when(F.col("type") == "Polygon", F.from_json("coordinates", one)).when(F.col("type") == "MultiPolygon", F.flatten(F.from_json("coordinates", many))).otherwise(unknown)
    rings = z.select("zone_id", F.explode(polygon).alias("ring"))
    ends = rings.select("zone_id", F.posexplode(F.expr("transform(sequence(1, size(ring) - 1), i -> struct(ring[i - 1] AS a, ring[i] AS b))")).alias("edge_no", "e"))
    (x1, y1), (x2, y2) = (geo.to_metric(F.col(f"e.{k}")[0], F.col(f"e.{k}")[1]) for k in ("a", "b"))
    return ends.select("zone_id", "edge_no", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def zones_or_corridor(points: DataFrame, zones: DataFrame | None, rivers: DataFrame, buffer: float = S.RIVER_BUFFER_M) -> DataFrame:
    """Points with ``in_reference`` and ``reference_source``: official zones if there are any, else the river corridor."""
    from parcelrisk.operators import spatial

    if zones is not None and zones.limit(1).count():
        return spatial.in_zone(points, zones).withColumnRenamed("inside_zone", "in_reference").withColumn("reference_source", F.lit("zones"))
    return spatial.in_corridor(points, rivers, buffer).withColumnRenamed("in_corridor", "in_reference").withColumn("reference_source", F.lit("corridor"))


def read_scenes(spark: SparkSession, path: str, sites: list[int] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observations of some sites and dates; with files partitioned by them only those are read."""
    d = spark.read.parquet(path)
    if sites is not None:
        d = d.filter(F.col("site_id").isin(*sites))
    for bound, keep in ((start, F.col("ts") >= F.lit(start).cast("timestamp_ntz")), (end, F.col("ts") < F.lit(end).cast("timestamp_ntz"))):
        d = d if bound is None else d.filter(keep)
    return nan_to_null(d)


def read_manifests(spark: SparkSession, paths: dict[str, str], split: str | None = None, require_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries of all sites with ``site_key``, and the sites without entries; with ``require_all`` such a site fails. Files may be arrays or lines."""
    want = spark.createDataFrame([(k,) for k in paths], "site_key string")
    parts = []
    for key, path in paths.items():
        try:
            first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
            whole = bool(first) and first[0][0].lstrip().startswith("[")  # an indented array, not a line for each entry
            parts.append(spark.read.schema("tile_id string, path string, row_off int, col_off int, valid_fraction double, split string").json(path, multiLine=whole).withColumn("site_key", F.lit(key)))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    d = spark.createDataFrame([], S.MANIFEST)
    for p in parts:
        d = d.unionByName(p)
    d = d if split is None else d.filter(F.col("split") == split)
    absent = want.join(d.select("site_key").distinct(), "site_key", "left_anti")
    if require_all and (gone := [r[0] for r in absent.collect()]):  # a row for each site
        raise ValueError(f"no manifest entries for {gone}")
    return d, absent


def read_graph(spark: SparkSession, path: str, sites: list[int] | None = None, labelled: bool = True) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the sites that exist; an unlabelled node fails where labels are asked for."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if sites is not None:
        nodes, edges = nodes.filter(F.col("site_id").isin(*sites)), edges.filter(F.col("site_id").isin(*sites))
    if labelled and nodes.filter("y IS NULL").limit(1).count():
        raise ValueError("the graph has nodes without label")
    return nodes, edges


def _replace_sites(path: str, tables: dict[str, tuple[DataFrame, str, list[str]]]) -> None:
    """Writes {folder: (rows, format, columns below site_id to part by)} so that sites in any of them are replaced in all, and no other site is touched.

    Everything is written beside the old files first, so a failing write leaves them as they are. Then each site's folder is exchanged,
    the old one being moved away before the new one is moved in, and a row for each site and table is added to ``_commits``.
    """
    spark, run = next(iter(tables.values()))[0].sparkSession, uuid.uuid4().hex
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda *parts: hadoop.Path("/".join(p for p in parts if p))
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, retired = f"{path}/_fresh-{run}", f"{path}/_retired-{run}"
    try:
        for name, (df, form, below) in tables.items():
            df.write.format(form).partitionBy("site_id", *below).save(f"{fresh}/t{name}")
        found = {name: [s.getPath().getName() for s in fs.listStatus(at(fresh, f"t{name}")) if s.isDirectory()] for name in tables}
        sites = sorted({site for names in found.values() for site in names if site.startswith("site_id=")})
        for name in tables:
            for site in sites:
                old, new = at(path, name, site), at(fresh, f"t{name}", site)
                if fs.exists(old):
                    fs.mkdirs(at(retired, f"t{name}"))
                    fs.rename(old, at(retired, f"t{name}", site))
                if fs.exists(new):
                    fs.mkdirs(at(path, name))
                    fs.rename(new, old)
        rows = [(run, name or "rows", site.removeprefix("site_id="), site in found[name]) for name in tables for site in sites]
        spark.createDataFrame(rows, "run string, name string, site_id string, has_rows boolean").withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path}/_commits")
    finally:
        for folder in (fresh, retired):
            fs.delete(at(folder), True)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """What was written to a sink, and when: run, name, site_id, has_rows, written_at."""
    return spark.read.schema("run string, name string, site_id string, has_rows boolean, written_at timestamp").json(f"{path}/_commits")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replaces the sites of ``nodes`` and ``edges``; other sites stay."""
    _replace_sites(path, {"nodes": (nodes, "parquet", []), "edges": (edges, "parquet", [])})


def write_policy(decisions: DataFrame, path: str) -> None:
    """Replaces the sites of ``decisions``; other sites stay."""
    _replace_sites(path, {"": (decisions, "parquet", [])})


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """Decisions with action names decoded from their index."""
    from parcelrisk.functions import heads

    return spark.read.parquet(path).withColumn("action", heads.action_name(F.col("action_index")))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Pixels by site and split, and one manifest row for each tile variant. The sites of ``tiles`` are replaced in all splits; other sites stay."""
    key = F.concat_ws("_", "site_id", "tile_row_off", "tile_col_off", "variant")
    entries = tiles.groupBy("site_id", "split", key.alias("tile_id"), F.col("tile_row_off").alias("row_off"), F.col("tile_col_off").alias("col_off"), "variant").agg(F.first("valid_fraction").alias("valid_fraction"))
    _replace_sites(path, {"pixels": (tiles.withColumn("tile_id", key), "parquet", ["split"]), "manifest": (entries, "json", ["split"])})


def newest_file(spark: SparkSession, folders: list[str], prefix: str) -> str | None:
    """The latest file whose name begins with ``prefix`` in any of the folders; folders that do not exist are passed over."""
    best = None
    for folder in folders:
        try:
            # recursive, as other folders beneath would be taken for partitions; what lies deeper is left out below
            d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", prefix + "*").load(folder).select("path", "modificationTime")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        row = d.filter(F.element_at(F.split("path", "/"), -2) == folder.rstrip("/").rpartition("/")[2]).agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]
        best = max([x for x in (best, row) if x is not None], default=None)
    return None if best is None else best["path"]


def write_report(report: DataFrame, path: str) -> None:
    """A few rows as JSON, written beside the old report and then put in its place, so a failing write leaves the old one."""
    spark, fresh = report.sparkSession, f"{path}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        report.coalesce(1).write.json(fresh)
        fs.delete(hadoop.Path(path), True)
        fs.rename(hadoop.Path(fresh), hadoop.Path(path))
    finally:
        fs.delete(hadoop.Path(fresh), True)
