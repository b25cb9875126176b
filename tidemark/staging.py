"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting and gets a fresh temporary
    folder; on a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return "file://" + tempfile.mkdtemp(prefix="run-")


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Make ``folder``; it goes when the driver's JVM ends, after failures too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)


class Staging:
    """Writes tables that several later steps read, and reads them back.

    A staged table cuts the lineage, survives the loss of executors, is read
    with column pruning, and carries its true size, by which Catalyst decides
    whether a join side is small enough to broadcast. :meth:`drop` deletes the
    tables; the session's JVM deletes on its way out what was not dropped.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root: str | None = None

    @property
    def session(self) -> SparkSession:
        return self._spark

    @property
    def root(self) -> str:
        if self._root is None:
            self._root = f"{shared_folder(self._spark)}/tidemark-{uuid.uuid4().hex}"
            delete_at_exit(self._spark, self._root)
        return self._root

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete this run's staged tables, and nothing else."""
        if self._root is None:
            return
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._root)
        conf = self._spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
        self._root = None
