"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are words, weighted by how often a text holds them. For each of the samples a term draws r and c from Gamma(2, 1) and b from
[0, 1), all from hashes of term and sample; with t = floor(ln w / r + b) its value is ln c - r (t - b + 1), and the text's sample is
the smallest value. Two texts share a sample with the probability of their generalised Jaccard similarity: the sum of the smaller
weights over the sum of the larger. A value belongs to one term and one t, so equal values are equal samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNIT32, UNIT21, UNIT22 = 2.0**-32, 2.0**-21, 2.0**-22


def with_next(docs: DataFrame, most_buckets: int = 1024) -> DataFrame:
    """bucket, at, extra, doc_id, text, next_text: each text with that of the next id, the last with that of the first.

    Ids are dealt by quantiles into buckets, so one shuffle brings neighbours together; the first row of each bucket is also given to
    the bucket before it (``extra``), and the first of all to the last. Null ids come first, equal ids stand in order of the text's
    hash. What the driver holds is one number pair for each bucket.
    """
    spark = docs.sparkSession
    n = min(most_buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = d.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    edges = F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<long>")
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e < F.col("doc_id")))))
    heads = d.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("m")).orderBy("bucket").collect()
    if not heads:
        return d.select("bucket", F.lit(0).alias("at"), F.lit(False).alias("extra"), "doc_id", "text", F.lit("").alias("next_text"))
    table = [(r["m"]["doc_id"], r["m"]["h"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)]
    of = {r["bucket"]: t for r, t in zip(heads, table, strict=True)}
    entry = F.array(*[F.struct(F.lit(of.get(b, (None, 0, 0))[0]).cast("long").alias("id"), F.lit(of.get(b, (None, 0, 0))[1]).cast("long").alias("h"), F.lit(of.get(b, (None, 0, 0))[2]).alias("before")) for b in range(heads[-1]["bucket"] + 1)])
    head = F.element_at(entry, F.col("bucket") + 1)
    first = head["id"].eqNullSafe(F.col("doc_id")) & (head["h"] == F.col("h"))
    dealt = F.when(first, F.array(F.struct("bucket", F.lit(False).alias("extra")), F.struct(head["before"].alias("bucket"), F.lit(True).alias("extra")))).otherwise(F.array(F.struct("bucket", F.lit(False).alias("extra"))))
    d = d.withColumn("to", F.explode(dealt)).select("to.bucket", "to.extra", "doc_id", "text", "h")
    order = W.partitionBy("bucket").orderBy("extra", F.col("doc_id").asc_nulls_first(), "h")
    return d.select("bucket", F.row_number().over(order).alias("at"), "extra", "doc_id", "text", F.lead("text", 1, "").over(order).alias("next_text"))


def _draws(sample: Column) -> tuple[Column, Column, Column]:
    """r, ln c and b of the row's term for one sample."""
    low = lambda x, bits: x.bitwiseAND(F.lit(2**bits - 1))
    one, two = F.xxhash64("term", sample), F.xxhash64("term", sample + 1000)
    unit = lambda x, step: (x.cast("double") + 0.5) * step
    r = -F.ln(unit(F.shiftrightunsigned(one, 32), UNIT32) * unit(low(one, 32), UNIT32))
    c = -F.ln(unit(F.shiftrightunsigned(two, 43), UNIT21) * unit(low(F.shiftrightunsigned(two, 22), 21), UNIT21))
    return r, F.ln(c), unit(low(two, 22), UNIT22)


def signatures(terms: DataFrame, keys: list[str], weights: list[str], samples: int, block: int) -> DataFrame:
    """keys and one array of ``samples`` 32-bit numbers for each weight column of (keys, term, weights); a text without terms has nulls.

    Samples are drawn in blocks of rows, so that the code for one row stays small.
    """
    t = terms.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - block), F.lit(block))))
    t = t.select(*keys, "k", *[F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))).alias(w) for w in weights], *[x.alias(f"{n}{j}") for j in range(block) for n, x in zip("rcb", _draws(F.col("k") + j), strict=True)])
    value = lambda w, j: F.min(F.expr(f"c{j} - r{j} * (floor({w} / r{j} + b{j}) - b{j} + 1)")).alias(f"{w}_{j}")
    mins = t.groupBy(*keys, "k").agg(*[value(w, j) for w in weights for j in range(block)])
    parts = mins.select(*keys, F.struct("k", *[F.array(*[F.when(F.col(f"{w}_{j}").isNotNull(), F.hash(f"{w}_{j}")) for j in range(block)]).alias(w) for w in weights]).alias("p"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select(*keys, *[F.flatten(F.col("p")[w]).alias(w) for w in weights])


def text_form(signature: str) -> Column:
    """Eight hex digits for each sample; a text without terms has the word ``none``."""
    return F.expr(f"CASE WHEN {signature}[0] IS NULL THEN 'none' ELSE array_join(transform({signature}, x -> lower(lpad(hex(cast(x AS bigint) & 4294967295), 8, '0'))), '') END")


def likeness(a: str, b: str) -> Column:
    """Share of equal samples: an estimate of the generalised Jaccard similarity. Two texts without terms are alike, one is not like another."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CASE WHEN x <=> y THEN 1 ELSE 0 END), 0, (n, x) -> n + x) / cast(size({a}) AS double)")


def terms(texts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, term (64-bit hash of a lower-cased word) and for each column how often its text holds it. Each key has a row at least."""
    sides = texts.select(*keys, F.posexplode(F.array(*[F.lower(c) for c in columns])).alias("side", "whole"))
    words = sides.select(*keys, "side", F.explode(F.split("whole", r"\s+")).alias("word"))
    counted = words.select(*keys, "side", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    return counted.groupBy(*keys, "term").agg(*[F.sum(F.when((F.col("side") == i) & F.col("term").isNotNull(), 1).otherwise(0)).alias(c) for i, c in enumerate(columns)])


def edit_fingerprints(docs: DataFrame, samples: int = 64, block: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs`` (doc_id, text).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's. A null
    text is an empty one. Rows of equal id are documents of their own, in order of the text's hash; a single row is its own next.
    """
    d = with_next(docs)
    cut = F.expr("cast(floor(length(text) / 4) AS int)")
    d = d.select("bucket", "at", "extra", "doc_id", "text", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) AS int))"), F.substring("next_text", F.lit(1), cut)).alias("edited"))
    keys = ["bucket", "at"]
    signed = signatures(terms(d, keys, ["text", "edited"]), keys, ["text", "edited"], samples, block)
    facts = d.select(*keys, "extra", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    order = W.partitionBy("bucket").orderBy("at")
    both = facts.join(signed.hint("merge"), keys).withColumn("next", F.lead("text").over(order)).filter(~F.col("extra"))
    return both.select("doc_id", "n_chars", "edited_sha256", text_form("text").alias("fingerprint"), text_form("edited").alias("edited_fingerprint"), likeness("text", "edited").alias("near_edited"), likeness("text", "next").alias("near_next"))
