"""What the operators share: table reading, a scratch folder all executors see, and splitting text where tokenizers always split."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_KEYS = 10_000  # no more keys than this can each hold more than one in HOT_KEYS of all rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset a local folder that goes with the process, in local mode only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = spark.conf.get("parcelrisk.llm.scratch", None)
    if not held:
        held = tempfile.mkdtemp(prefix="parcelrisk-")
        atexit.register(shutil.rmtree, held, ignore_errors=True)
        spark.conf.set("parcelrisk.llm.scratch", held)
    return held


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive lost executors; ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)  # when the driver ends

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        schema = df.schema
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def free(self) -> None:
        """Has the driver collect its garbage now, so that Spark deletes the shuffle files of what has been written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        jvm, path = self.spark._jvm, self.path(name)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` beside the row of ``groups`` (one a key) of their key, where any key may hold any share of ``rows``; ``how`` is inner or left.

    A key of more than one in ``HOT_KEYS`` of all rows meets its group in several tasks: its rows are dealt by a hash of all their
    columns, its group is copied for each share. The list of such keys is that short at any size, so it can be broadcast. Keys must not
    be null. ``rows`` is read three times: it should be a written table.
    """
    share = max(rows.count() // HOT_KEYS, 1_000)
    hot = rows.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > share).select(*on, F.ceil(F.col("__n") / share).cast("int").alias("__salts"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copies = groups.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def scan(df: DataFrame, keys: list[str], order: list[str], outs: dict[str, tuple[Callable, Callable, str | Column]], scratch: Scratch, name: str) -> DataFrame:
    """Adds running aggregates within ``keys`` in ``order``, for groups of any size: ``outs`` has (aggregate, how two of its values combine, what of) by column.

    Rows are dealt by ranges of keys and order, so a large group lies in several tasks; each task runs over its own part, and what the
    parts before it hold is added. Only groups that cross from one range to the next need that, at most one a range: their table is
    broadcast. Keys must not be null.
    """
    d = scratch.write(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), name)
    own = W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    group = W.partitionBy(*(keys or [F.lit(0)]))
    totals = d.groupBy("__part", *keys).agg(*[f(of).alias(f"__{c}") for c, (f, _, of) in outs.items()])
    earlier = group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__part", *keys, F.min("__part").over(group).alias("__first"), *[f(f"__{c}").over(earlier).alias(f"__{c}") for c, (f, _, _) in outs.items()])
    before = totals.filter(F.col("__part") > F.col("__first")).drop("__first")
    inner = d.select("*", *[f(of).over(own).alias(c) for c, (f, _, of) in outs.items()])
    met = inner.join(F.broadcast(before), ["__part", *keys], "left")
    return met.select(*df.columns, *[F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(plus(F.col(c), F.col(f"__{c}"))).alias(c) for c, (_, plus, _) in outs.items()])


_INNER = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")


def space_chunks(text: str) -> list[str]:
    """Pieces of the text cut before each space that a non-space follows; all but the first lack that space.

    The pre-token pattern of the byte-level vocabularies (``public_tokenizers.PATTERN``) always cuts there, so each piece (with its
    space put back) can be encoded by itself.
    """
    return _INNER.split(text) if _ODD.search(text) else text.split(" ")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary file stands for: printable Latin-1 characters are themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """A dictionary that makes what it lacks and holds two generations of at most ``most`` entries: what is used again survives."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: Hashable) -> object:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:  # entries stay small
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
