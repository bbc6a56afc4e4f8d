"""Scratch tables in a folder that the driver and all executors see, so that steps that go on from each other's results don't recompute them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of this process.
SCRATCH: set = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a local one only where none is named and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("executors share no folder with the driver: set spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables lie. It goes when the driver's Python ends, or by `clear_scratch`."""
    folder = f"{shared_folder(spark)}/codeloom/{spark.sparkContext.applicationId}"
    if folder not in SCRATCH:
        SCRATCH.add(folder)
        atexit.register(remove, spark, folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of any file system, if the session's JVM is still there."""
    if SparkContext._gateway is None:
        return
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, OSError, AttributeError):  # the JVM went first; its folder is the cluster's to clean
        return


def clear_scratch(spark: SparkSession) -> None:
    """Removes all scratch tables of this application: DataFrames that still read them fail from then on."""
    folder = scratch_folder(spark)
    remove(spark, folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared folder. Cuts the lineage: a lost executor costs no recomputation of df."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
