"""Tables in versions on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class State:
    """A table in versions: each write makes a whole new one, and a reader sees the last that was finished."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def of(self, version: int) -> str:
        return f"{self.folder}/v={version}"

    def version(self) -> int:
        """The last version that was written whole, -1 for none."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        if not self._fs.exists(self._path):
            return -1
        found = [s.getPath() for s in self._fs.listStatus(self._path)]
        whole = [int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and self._fs.exists(make(p, "_SUCCESS"))]
        return max(whole, default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.of(self.version() if version is None else version))

    def write(self, table: DataFrame, version: int | None = None) -> int:
        version = self.version() + 1 if version is None else version
        table.write.mode("overwrite").parquet(self.of(version))
        return version
