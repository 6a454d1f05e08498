"""Small files and folders on any file system that Spark reaches, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder by Hadoop's file system, for what is few and small: manifests, markers, listings."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place
        self._path = spark._jvm.org.apache.hadoop.fs.Path(place)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._path, name) if name else self._path

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> bytes:
        source = self._fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def put(self, name: str, data: bytes) -> bool:
        """Write a file under another name and rename it, so that it is there whole or not at all; False if it was there."""
        if self.exists(name):
            return False
        parent, _, base = name.rpartition("/")
        draft = self._at(f"{parent}{'/' if parent else ''}.{base}.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            for at in range(0, len(data), 1 << 20):
                out.write(bytearray(data[at : at + (1 << 20)]))
        finally:
            out.close()
        if not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share. A session in local mode that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cardloom-"))
    return named or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder of this run below the shared one."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
