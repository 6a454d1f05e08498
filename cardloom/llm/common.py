"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
WORD_RE_BYTES = re.compile(WORD.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a session in local mode that names none (a test) gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cardloom-"))
    return named or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one run in the shared folder that go as soon as they aren't needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.place}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.place}/{name}")

    def clear(self) -> None:
        """Remove the tables, and have Spark's cleaner remove shuffles that no plan in use refers to: it looks for them only
        when the driver collects its garbage, which may be long after they are last read."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def put_file(spark: SparkSession, place: str, data: bytes) -> None:
    """Write a small file to any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def n_words(column):
    """Number of words, 0 for null, by built-in functions alone."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows: one scalar, to size partitions by."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")).first()[0]


def partitions_for(spark: SparkSession, n_bytes: int, target: int) -> int:
    """As many partitions as keep each near the target, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // target))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what a worker makes of them stays small; at the end, freed memory goes back
    to the system, as an idle worker would keep it through later stages."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Split a partition sorted by ``keys`` into its groups, each whole, however batches cut them."""
    pending: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i, row in enumerate(rows):
            if row != current:
                if i > start:
                    pending.append(batch.slice(start, i - start))
                if pending:
                    yield pa.Table.from_batches(pending)
                pending, start, current = [], i, row
        pending.append(batch.slice(start))
    if pending:
        yield pa.Table.from_batches(pending)
    pending = []
    give_back()
