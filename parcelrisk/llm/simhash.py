"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits becomes the vector of the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the number of differing bits, so it is a lower bound: pairs within 3 bits are within Manhattan distance 3, and one half
of the vector is then within distance 1. The vectors lie on a grid; a range join meets each half's cell and the cells one step up, and
the full bound and the exact distance are tested inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch
from parcelrisk.llm.components import connected_components

EVEN_BITS = "6148914691236517205"  # 0x5555555555555555


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; a shorter text is one run, an empty one has none. A-Z are lower-cased; words are separated by ASCII white space."""
    from xxhash import xxh64_intdigest

    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    data = b" ".join(split)
    if len(split) <= words:
        return np.array([xxh64_intdigest(data, seed)], np.uint64)
    size = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[: len(split) - words + 1].tolist()
    return np.array([xxh64_intdigest(data[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if more than half of the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[lo : lo + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``fp`` (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(shingle_hashes(t.as_py(), words, seed)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, fp long")


def _unary(fp: str) -> Column:
    """Each two-bit segment as its bit count in unary (00, 01, 11), so that Manhattan distance is a bit count again."""
    return F.expr(f"(({fp} | shiftrightunsigned({fp}, 1)) & {EVEN_BITS}L) | shiftleft({fp} & shiftrightunsigned({fp}, 1) & {EVEN_BITS}L, 1)")


def near_pairs(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b) of all distinct values of ``fp`` that differ in 1 to ``bits`` (at most 3) bits, each pair once."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves bound one of them by distance 1 only up to 3 bits")
    u = fps.select("fp").distinct().withColumn("u", _unary("fp")).withColumn("half", F.explode(F.array(F.lit(0), F.lit(32))))
    u = u.withColumn("cell", F.expr("shiftrightunsigned(u, half) & 4294967295L"))
    # one step up in segment j: a count of 0 sets the segment's low bit, a count of 1 its high bit, 2 is the top
    steps = F.expr(
        "filter(transform(sequence(0, 15), j -> CASE shiftright(cell, 2 * j) & 3 WHEN 0 THEN cell | shiftleft(1L, 2 * j) WHEN 1 THEN cell | shiftleft(1L, 2 * j + 1) END), c -> c IS NOT NULL)"
    )
    probe = u.select(F.col("fp").alias("a"), F.col("u").alias("ua"), "half", F.explode(F.concat(F.array("cell"), steps)).alias("cell"), F.col("cell").alias("own"))
    probe = probe.select("a", "ua", "half", "cell", (F.col("cell") == F.col("own")).alias("same"))
    build = u.select(F.col("fp").alias("b"), F.col("u").alias("ub"), F.col("half").alias("half_b"), F.col("cell").alias("cell_b"))
    met = (
        (~F.col("same") | (F.col("a") < F.col("b")))
        & (F.expr("bit_count(ua ^ ub)") <= bits)  # Manhattan bound
        & ((F.col("half") == 0) | (F.expr("bit_count((ua ^ ub) & 4294967295L)") > 1))  # not met in the lower half already
        & (F.expr("bit_count(a ^ b)") <= bits)
    )
    return probe.join(build, (F.col("half") == F.col("half_b")) & (F.col("cell") == F.col("cell_b")) & met).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp (long), root (the smallest fingerprint that links reach: it names the component), component_id: the smallest doc_id there.

    Fingerprints that differ in at most ``bits`` bits link. Null and wordless texts have fingerprint 0 and link like any other;
    repeated rows stay separate rows of one component; a component of documents without id has a null component_id, and unlike
    texts of one id may give two components one component_id, but never one root. Equal fingerprints are grouped before the join, so copies never meet in pairs.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, words, seed), "fps")
    least = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "least")
    roots = connected_components(near_pairs(least, bits), scratch)
    nodes = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(nodes.join(ids, "component").select("fp", F.col("component").alias("root"), "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
