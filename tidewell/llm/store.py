"""Shared scratch space: tables that cut lineage and survive lost executors.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset
(tests) a folder of our own is made and set.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidewell.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("tidewell.scratch.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may have ended already
            _delete(spark, folder)


class Scratch:
    """Tables written under one folder of the shared space.

    ``keep`` writes a DataFrame and returns it read back (with the same schema),
    so later failures recompute from files.  ``drop`` deletes tables no longer read;
    tables that results still read go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete_at_exit, spark, self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidewell_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _delete(self.spark, table._tidewell_path)

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are written; else they stay until the driver happens to collect garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
