"""Corpus pipeline: toxic documents go, repeated passages are cut out, one document of each near-duplicate group stays, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all rows the one before it kept, and returns a table that is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelrisk.llm import line_dedup, packing, simhash, toxicity
from parcelrisk.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels, does not reject. Null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier place holds; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("chunks_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return cleaned.select(*[n_chars if c == "n_chars" else F.col(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the row of the smallest id, of several such rows the first by the text's hash. Documents without id stay, and so do unlike texts of one id."""
    scratch = Scratch(spark, "keepers")
    groups = scratch.write(simhash.near_duplicates(docs), "groups")
    often = scratch.write(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "often")
    gone = scratch.write(groups.filter("doc_id <> component_id").select("doc_id").union(often).distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if often.isEmpty():
        return kept
    # rows that share an id are told apart by their fingerprints, and grouped by their component's, as their id may be the smallest of several
    again = docs.join(often, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("h"))
    prints = simhash.fingerprints(again.select("h", "row.text"), key="h").distinct()
    first = groups.filter("doc_id = component_id").join(often, "doc_id", "left_semi").distinct()
    again = again.join(prints, "h").join(first, (F.col("row.doc_id") == F.col("doc_id")) & (prints["fp"] == first["fp"])).groupBy("root").agg(F.min_by("row", "h").alias("row"))
    return kept.unionByName(again.select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents placed in sequences of at most 1024 tokens, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", cut_repeats), ("simhash_near_dedup", one_of_each), ("packing", pack)]

#: Model fitting, XXH64 and tokenization have no SQL form; tests hold line dedup, near-duplicates and packing against brute force and the fitted stage against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
