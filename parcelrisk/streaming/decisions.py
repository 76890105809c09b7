"""The decision operator on a stream. It is a stateless select, so it is the batch operator on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelrisk.operators.policy import decide_policy

HEADS = "site_id int, node_id long, flood_proba double, p_low double, p_medium double, p_high double, inside_zone boolean"


def decide_stream(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    """Decisions for the parcel files that arrive under ``path``."""
    return decide_policy(spark.readStream.schema(HEADS).option("maxFilesPerTrigger", per_trigger).parquet(path))
