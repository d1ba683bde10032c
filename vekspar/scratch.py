"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import FailedPrecondition


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. A folder of this machine only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise FailedPrecondition("set spark.checkpoint.dir to a folder that all executors share", "scratch")
    own = "file://" + tempfile.mkdtemp(prefix="vekspar-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Tables in the shared checkpoint folder. They cut the lineage and survive lost executors.

    A table goes with drop(), with the end of a with statement, or at the end of the driver's
    Python. A query that returns a lazy DataFrame over its tables leaves them until then.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{checkpoint_dir(spark).rstrip('/')}/vekspar-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except OSError:  # the session's gateway has gone before us
                pass

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()
        atexit.unregister(self.close)
