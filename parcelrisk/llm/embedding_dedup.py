"""Near-duplicate vectors by int8 tile products with error bounds.

Unit vectors are quantised to int8 codes with one scale each; the length of what quantisation drops is kept as the vector's error.
The product of two codes is off by at most e_x + e_y + e_x e_y, so a tile product that adds these terms never misses a link; only
pairs it lets through are computed again in double precision. Products of int8 codes are whole numbers: summed over at most
``EXACT_WIDTH`` components they are exact in single precision, whose matrix product is the fast one here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelrisk.llm.common import Scratch
from parcelrisk.llm.components import connected_components

BLOCK = "block int, rows int, width int, row_ids binary, vec_ids binary, missing binary, codes binary, scales binary, errors binary, exact binary"
TILE_OUT = "a long, b long, links long"
EXACT_WIDTH = 1040  # 1040 x 127 x 127 < 2^24
ROUNDING = 1e-6  # far above what single precision loses


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error lengths of unit vectors."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def code_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products of two matrices of int8 codes (rows by rows)."""
    slabs = [x[:, lo : lo + EXACT_WIDTH].astype(np.float32) @ y[:, lo : lo + EXACT_WIDTH].astype(np.float32).T for lo in range(0, x.shape[1], EXACT_WIDTH)]
    return slabs[0] if len(slabs) == 1 else np.sum(slabs, axis=0, dtype=np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. The largest component becomes 1 first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def pack_block(group: pd.DataFrame) -> pd.DataFrame:
    given = np.stack(group["embedding"].to_list())
    x = unit_rows(given.astype(np.float64))
    codes, scale, error = quantise(x)
    block = int(group["block"].iloc[0])
    row_ids = (block << 24) + np.arange(len(group), dtype=np.int64)
    ids = group["vec_id"]
    return pd.DataFrame([[block, len(group), x.shape[1], row_ids.tobytes(), ids.fillna(0).to_numpy(np.int64).tobytes(), ids.isna().to_numpy().tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes(), given.tobytes()]], columns=[c.split()[0] for c in BLOCK.split(", ")])


def _matrices(row: dict, side: str) -> tuple[np.ndarray, ...]:
    n, d = row[f"rows_{side}"], row[f"width_{side}"]
    codes, exact = np.frombuffer(row[f"codes_{side}"], np.int8).reshape(n, d), row[f"exact_{side}"]
    given = np.frombuffer(exact, np.float32 if len(exact) == 4 * n * d else np.float64).reshape(n, d)
    return np.frombuffer(row[f"row_ids_{side}"], np.int64), codes, np.frombuffer(row[f"scales_{side}"]), np.frombuffer(row[f"errors_{side}"]), unit_rows(given.astype(np.float64))


def merge_labels(label: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Labels after linking places r with places c: the smallest place of each group."""
    while True:
        low = np.minimum(label[r], label[c])
        if (label[r] == low).all() and (label[c] == low).all():
            return label
        label = label.copy()
        np.minimum.at(label, label[r], low)
        np.minimum.at(label, label[c], low)
        while (label != (jump := label[label])).any():
            label = jump


def block_pairs(packed: DataFrame) -> DataFrame:
    """Every two blocks of one width side by side, once, and each beside itself.

    A cartesian product reads the blocks again for each of its tasks instead of shuffling a copy of each block for every other one.
    Of two blocks the lower is the left one if their numbers differ by an odd number, else the right one, so all tasks get like shares.
    """
    left, right = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "xy")
    once = (F.col("block_x") < F.col("block_y")) == ((F.col("block_x") + F.col("block_y")) % 2 == 1)
    return left.hint("shuffle_replicate_nl").join(right, (F.col("width_x") == F.col("width_y")) & once)


def link_tile(row: dict, threshold: float, rows: int = 128) -> pd.DataFrame:
    """All links between two blocks (or inside one): how many each vector has, and a star for each group they form."""
    same = row["block_x"] == row["block_y"]
    ids_x, qx, sx, ex, x = _matrices(row, "x")
    ids_y, qy, sy, ey, y = _matrices(row, "y")
    nx, ny = len(ids_x), len(ids_y)
    ids = ids_x if same else np.r_[ids_x, ids_y]
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    shift = 0 if same else nx
    enough = ((threshold - ROUNDING - ex - (1 + ex) * ey.max()) / sx).astype(np.float32)[:, None]  # in any case, by the largest error of the other block
    scale = sy.astype(np.float32)
    for lo in range(0, nx, rows):
        product = code_products(qx[lo : lo + rows], qy)
        product *= scale
        r, c = np.divmod(np.flatnonzero(product >= enough[lo : lo + rows]), ny)
        product, r = product[r, c], r + lo
        bound = product * sx[r] + ex[r] + (1 + ex[r]) * ey[c] >= threshold - ROUNDING
        r, c = r[bound], c[bound]
        if same:
            r, c = r[r < c], c[r < c]
        for at in range(0, len(r), 50_000):
            a, b = r[at : at + 50_000], c[at : at + 50_000]
            near = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            a, b = a[near], b[near] + shift
            if len(a):
                links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
                label = merge_labels(label, a, b)
    n, star = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
    counts = pd.DataFrame({"a": ids[n], "b": pd.array([pd.NA] * len(n), "Int64"), "links": pd.array(links[n], "Int64")})
    stars = pd.DataFrame({"a": ids[star], "b": pd.array(ids[label[star]], "Int64"), "links": pd.array([pd.NA] * len(star), "Int64")})
    return pd.concat([counts, stars])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block_rows: int = 4096) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= ``threshold`` in double precision, component_id is the smallest vec_id that links
    reach, kept is vec_id = component_id. Vectors that are null, empty, zero, or hold null or non-finite components, link with
    nothing. Vectors of different widths never link. Rows that repeat a vec_id count as rows of their own; a
    row without vec_id is never the smallest unless all of its component are. Rows are dealt round-robin into blocks of
    ``block_rows``, which are written once, a file each; every two blocks meet in one task, which hands on counts and stars, never
    pairs. Shuffled and written bytes grow with the rows, work with rows^2.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    all_rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>"))
    fine = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity')) AND exists(embedding, c -> c <> 0)")
    good = all_rows.filter(F.coalesce(fine, F.lit(False))).withColumn("width", F.size("embedding"))
    widths = {r["width"]: r["count"] for r in good.groupBy("width").count().collect()}  # a row for each width
    if not widths:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    spans, at = {}, 0
    for width, n in sorted(widths.items()):
        spans[width] = (at, at := at + -(-n // block_rows))
    number = F.monotonically_increasing_id()
    block = F.coalesce(*[F.when(F.col("width") == w, number % (hi - lo) + lo) for w, (lo, hi) in spans.items()]).cast("int")
    packed = scratch.write(good.withColumn("block", block).groupBy("block").applyInPandas(pack_block, BLOCK), "blocks", maxRecordsPerFile=1)

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                yield link_tile(row, threshold)

    found = scratch.write(block_pairs(packed.drop("vec_ids", "missing")).mapInPandas(link, TILE_OUT), "links")
    counts = found.filter("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("n_links"))
    roots = connected_components(found.filter("b IS NOT NULL").select("a", "b"), scratch)

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                ids = pd.array(np.frombuffer(row["vec_ids"], np.int64).copy(), "Int64")
                ids[np.frombuffer(row["missing"], bool)] = pd.NA
                yield pd.DataFrame({"row_id": np.frombuffer(row["row_ids"], np.int64), "vec_id": ids})

    names = packed.select("row_ids", "vec_ids", "missing").mapInPandas(unpack, "row_id long, vec_id long")
    rows = names.join(roots, names["row_id"] == roots["node"], "left").join(counts, names["row_id"] == counts["a"], "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "row_id").alias("component"))
    least = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = rows.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = all_rows.filter(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
