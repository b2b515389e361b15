"""Rows written to the shared checkpoint folder, so that iterations keep a short lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; only a local master may do without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """The rows, written to ``spark.checkpoint.dir`` and read from there.

    A later loss of executors recomputes nothing above this point.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession) -> str:
    """A path for a table of its own in the shared folder."""
    return f"{_folder(spark)}/table-{uuid.uuid4().hex}"


class Scratch:
    """Tables that a job needs while it runs only, in a folder of their own below the shared one, deleted together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.tables = spark, new_path(spark), 0

    def put(self, df: DataFrame) -> DataFrame:
        """The rows, written as Parquet and read from there."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Deletes the tables; no frame that reads one may be used from here on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = 0
