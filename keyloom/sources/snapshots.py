"""Durable snapshots of relations: Parquet tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without it, one temporary folder a session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_roots[app] = tempfile.mkdtemp(prefix="keyloom-state-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return "file://" + _local_roots[app]


def snapshot(df: DataFrame, name: str = "state") -> DataFrame:
    """``df`` written once and read back: cuts the plan and survives lost executors.

    The table goes with the JVM; a remote session, which has none to ask, leaves it.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
