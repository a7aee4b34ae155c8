"""Tables written between the steps of a job.

Steps are cut by writing Parquet into the shared folder that
``spark.checkpoint.dir`` names, so a lost executor costs a re-read and never a
recomputation from a copy that went with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temp folder of a local session, and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """The table as a side whose join shuffles both sides, for tables that grow with the input.

    Spark expects as many bytes as the files have, and a few compressed MB can hold
    millions of rows; by that size alone it sends them to the driver to broadcast them.
    """
    return df.hint("merge")


class Scratch:
    """Parquet tables of one job under the shared folder.

    Example:
        scratch = Scratch(spark)
        small = scratch.keep(big.groupBy("k").count(), "counts")
        scratch.drop("counts")
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/job-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that later steps no longer read."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
