"""Small files of state in a folder that the driver and the executors share, by Hadoop's file systems, so that it may
lie wherever Spark can write (file, hdfs, s3a, ...)."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, in one of the working directory."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.path.abspath("spark-warehouse/checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder the cluster names in
    spark.checkpoint.dir; only where that is unset (tests) is a folder of our own used."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(where or os.path.abspath("spark-warehouse/checkpoints"))
    return df.checkpoint(eager=True)


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> dict[str, float]:
        """Names in the folder and when they were last changed; none where there is no folder."""
        try:
            return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(self.path)}
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return {}
            raise

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All or nothing: under another name first."""
        part = self._at(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(part, self._at(name)):
            self.fs.delete(part, False)
            raise OSError(f"{name} could not be written in {self.path}")

    def claim(self, name: str) -> bool:
        """Creates an empty file; False where it is there already."""
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local files are looked for first and then made
            own = self._at(name).toUri().getPath()
            os.makedirs(os.path.dirname(own), exist_ok=True)
            try:
                os.close(os.open(own, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self.fs.create(self._at(name), False).close()
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def age(self, name: str) -> float:
        at = self.names().get(name)
        return 0.0 if at is None else time.time() - at
