"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder for this session's tables in ``spark.checkpoint.dir``, deleted when the driver ends; where that is unset a local one, in local mode only."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if given:
            _own[app] = f"{given}/parcelrisk-{uuid.uuid4().hex}"
            path = spark._jvm.org.apache.hadoop.fs.Path(_own[app])
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            _own[app] = tempfile.mkdtemp(prefix="parcelrisk-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def settle(df: DataFrame) -> DataFrame:
    """The table, written and read again."""
    path = f"{folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
