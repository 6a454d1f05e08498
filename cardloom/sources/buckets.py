"""Tables in buckets, of which a change rewrites only those that it touches.

A row's bucket is a hash of its keys. Each bucket has a base folder and some layers of changes (rows with ``op`` 1 or -1), the
later ones in force over the earlier; a version's manifest names them all, and is one small file that appears by rename. So
readers see a version whole or not at all, untouched buckets keep their files from version to version, and a write that was
cut off leaves folders that nobody reads. Compaction folds the layers of a bucket into a new base.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.sources.files import Folder


class Buckets:
    """``schema``: the table's columns as DDL; ``keys``: those that say a row's bucket. Layers need rows without nulls.

    The number of buckets is fixed when the table is first written. One writer at a time; of two that race for a version,
    the manifest's rename lets one win, and the other is told by an error.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str, n: int = 64):
        self.spark, self.folder, self.keys, self.schema = spark, folder, keys, schema
        self._files = Folder(spark, folder)
        self.n = (self.manifest() or {}).get("n", n)

    @property
    def stored(self) -> str:
        """The columns of the files, for tables that keep their rows in another form."""
        return self.schema

    # versions

    def version(self) -> int:
        """The last version, -1 for none."""
        return max((int(name[:-5]) for name in self._files.names("manifest") if name.endswith(".json") and not name.startswith(".")), default=-1)

    def manifest(self, version: int | None = None) -> dict | None:
        version = self.version() if version is None else version
        return json.loads(self._files.read(f"manifest/{version:012}.json")) if version >= 0 else None

    def note(self) -> dict:
        """What the last version's writer has noted: watermarks, batch numbers."""
        return (self.manifest() or {}).get("note", {})

    def _commit(self, buckets: dict, note: dict | None) -> int:
        version = self.version() + 1
        whole = {"n": self.n, "buckets": buckets, "note": self.note() | (note or {})}
        if not self._files.put(f"manifest/{version:012}.json", json.dumps(whole).encode()):
            raise RuntimeError(f"{self.folder}: another writer made version {version}")
        return version

    # rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows (their keys suffice): at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """The rows by bucket in a new folder, each bucket sorted by its keys, so that scans for some keys skip row groups."""
        place = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self.bucket()).repartition("_bucket").sortWithinPartitions("_bucket", *self.keys)
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{place}")
        return {int(name[8:]): f"{place}/{name}" for name in self._files.names(place) if name.startswith("_bucket=")}

    def _load(self, places: list[str], schema: str) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in places))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), of some buckets or of all: the base and what was added, less what was removed."""
        return self._rows(version, buckets)

    def _rows(self, version: int | None = None, buckets: list[int] | None = None, some: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The rows as they are stored; ``some`` keeps the rows of some keys where files are read."""
        held = (self.manifest(version) or {"buckets": {}})["buckets"]
        asked = held if buckets is None else {str(b): held[str(b)] for b in buckets if str(b) in held}
        plain = some(self._load([x["base"] for x in asked.values() if x["base"] and not x["layers"]], self.stored))
        layered = {b: x for b, x in asked.items() if x["layers"]}
        if not layered:
            return plain
        base = some(self._load([x["base"] for x in layered.values() if x["base"]], self.stored))
        depth = max(len(x["layers"]) for x in layered.values())
        kind = f"{self.stored}, op int"
        levels = [some(self._load([x["layers"][i] for x in layered.values() if i < len(x["layers"])], kind)).withColumn("_at", F.lit(i)) for i in range(depth)]
        return plain.unionByName(self._folded(base, levels))

    def _folded(self, base: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """The base under its layers (with their numbers as ``_at``), the last one in force."""
        columns = base.columns
        last = reduce(DataFrame.unionByName, levels).groupBy(*columns).agg(F.max_by("op", "_at").alias("op"))
        return base.join(last, columns, "left_anti").unionByName(last.where("op > 0").select(columns))

    # writes

    def write(self, rows: DataFrame, note: dict | None = None) -> int:
        """A version of these rows alone."""
        places = self._write(rows)
        return self._commit({str(b): {"base": p, "layers": []} for b, p in places.items()}, note)

    def rewrite(self, touched: list[int], rows: DataFrame, note: dict | None = None) -> int:
        """A version with these rows in the touched buckets and all others as they are."""
        places = self._write(rows) if touched else {}
        buckets = dict((self.manifest() or {"buckets": {}})["buckets"])
        if strange := places.keys() - set(touched):
            raise ValueError(f"rows of buckets that aren't touched: {sorted(strange)[:5]}")
        buckets |= {str(b): {"base": places.get(b), "layers": []} for b in touched}
        return self._commit({b: x for b, x in buckets.items() if x["base"]}, note)

    def change(self, changes: DataFrame, note: dict | None = None) -> int:
        """A version with one more layer on the buckets of the changes: rows with ``op`` 1 (add) or -1 (remove)."""
        places = self._write(changes)
        buckets = dict((self.manifest() or {"buckets": {}})["buckets"])
        for b, place in places.items():
            was = buckets.get(str(b), {"base": None, "layers": []})
            buckets[str(b)] = {"base": was["base"], "layers": [*was["layers"], place]}
        return self._commit(buckets, note)

    def compact(self, most: int = 0) -> int:
        """Fold the layers of buckets that have more than ``most`` into their bases; the version."""
        held = (self.manifest() or {"buckets": {}})["buckets"]
        deep = [int(b) for b, x in held.items() if len(x["layers"]) > most]
        return self.rewrite(deep, self._rows(buckets=deep)) if deep else self.version()

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders that none of the last ``keep`` versions names, and older manifests; how many folders went. Not
        while a write is under way, as its folder isn't named yet."""
        last = self.version()
        if last < 0:
            return 0
        live = [v for v in range(max(0, last - keep + 1), last + 1)]
        used = {p.split("/")[1] for v in live for x in self.manifest(v)["buckets"].values() for p in [x["base"], *x["layers"]] if p}
        gone = [name for name in self._files.names("data") if name not in used]
        for name in gone:
            self._files.remove(f"data/{name}")
        for name in self._files.names("manifest"):
            if name.endswith(".json") and not name.startswith(".") and int(name[:-5]) < live[0]:
                self._files.remove(f"manifest/{name}")
        return len(gone)
