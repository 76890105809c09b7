"""Ranks the elements of a linked list that lies distributed over a table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Positions in a list of bounded length, from its head on."""
    after, heads = {}, []
    for b in batches:
        known = b.astype(object).where(b.notna(), None)
        after |= {i: (n, w) for i, n, w in zip(known["id"], known["next"], known["w"], strict=True)}
        heads += known.loc[known["prev"].isna(), "id"].tolist()
    if not after:
        return
    at, (here,) = 0, heads
    ids, places = [], []
    while here is not None:
        ids.append(here)
        places.append(at)
        here, w = after[here]
        at += w
    yield pd.DataFrame({"id": ids, "position": places})


def rank(elements: DataFrame, scratch: Scratch, base: int = 50_000) -> DataFrame:
    """(id, position from 0) of one list given as (id, next): ids are strings, the last one's next is null, and there is one head.

    Each round takes out about a third of the elements: those whose hash is below both neighbours', so no two of them are neighbours and
    each can be spliced out by itself; the sum of all rounds is three times the list. What is left of ``base`` elements at most is walked
    in one task, then the rounds are undone: an element lies as far before its then next one as it knows. Each round is a written table.
    """
    both = elements.select("id", "next", F.lit(None).cast("string").alias("prev")).union(elements.filter("next IS NOT NULL").select(F.col("next").alias("id"), F.lit(None).cast("string").alias("next"), F.col("id").alias("prev")))
    now = scratch.write(both.groupBy("id").agg(F.max("next").alias("next"), F.max("prev").alias("prev")).withColumn("w", F.lit(1).cast("long")), "list0")
    for k in count():
        if now.count() <= max(base, 2):  # head and tail always stay
            break
        h = lambda c: F.xxhash64(c, F.lit(k))  # noqa: B023, E731
        out = F.col("prev").isNotNull() & F.col("next").isNotNull() & (h("id") < h("prev")) & (h("id") < h("next"))
        marked = now.withColumn("out", out)
        stays = marked.filter("NOT out").select("id", "next", "prev", "w", F.lit(None).cast("string").alias("new_next"), F.lit(None).cast("string").alias("new_prev"), F.lit(0).cast("long").alias("more"))
        # what an element tells its two neighbours when it goes
        told = marked.filter("out").select(F.explode(F.array(
            F.struct(F.col("prev").alias("id"), F.col("next").alias("new_next"), F.lit(None).cast("string").alias("new_prev"), F.col("w").alias("more")),
            F.struct(F.col("next").alias("id"), F.lit(None).cast("string").alias("new_next"), F.col("prev").alias("new_prev"), F.lit(0).cast("long").alias("more")),
        )).alias("m")).select("m.*")
        heard = stays.unionByName(told, allowMissingColumns=True).groupBy("id").agg(*[F.max(c).alias(c) for c in ("next", "prev", "w", "new_next", "new_prev")], F.sum("more").alias("more"))
        left = heard.select("id", F.coalesce("new_next", "next").alias("next"), F.coalesce("new_prev", "prev").alias("prev"), (F.col("w") + F.col("more")).alias("w"))
        scratch.write(marked.filter("out").select("id", "next", "w"), f"out{k}")
        now = scratch.write(left, f"list{k + 1}")
        scratch.drop(f"list{k}")
    known = scratch.write(now.coalesce(1).mapInPandas(_walk, "id string, position long"), f"known{k}")
    for j in range(k - 1, -1, -1):
        gone = scratch.spark.read.schema("id string, next string, w long").parquet(scratch.path(f"out{j}"))
        at = known.select(F.col("id").alias("next"), "position")
        known = scratch.write(known.union(gone.join(at, "next").select("id", (F.col("position") - F.col("w")).alias("position"))), f"known{j}")
        scratch.drop(f"known{j + 1}")
    return known
