"""Near-duplicate groups by SimHash and BK-trees (operator 3).

Texts become 64-bit fingerprints. Equal fingerprints are one class. Two fingerprints that differ in at most r bits
agree on one of r + 1 blocks of bits, so the fingerprints that share a block's value make a *shard*, and every link lies
in some shard. Each shard is searched through its own BK-tree: a child hangs below its parent under the integer Hamming
distance between them, and a search follows only the edges within the radius of the distance it has measured.

The trees aren't broadcast, as all of them together grow with the corpus: fingerprints go to the shard that can hold
their neighbours. A shard of many members is dealt in pieces of bounded size; every two pieces meet in one task of their
own, so that a hot block value is spread over tasks and still loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import WORD_RE_BYTES, checkpoint, sorted_groups
from cardloom.llm.components import components

#: Members of a shard that one side of a task holds.
PIECE = 2048


def shingles(text: str | None, size: int) -> list[bytes]:
    """Space-joined shingles of the lower-cased (A-Z only) words, repeats kept; fewer words: all of them; none: none."""
    words = WORD_RE_BYTES.findall((text or "").encode().lower())
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(xxh64_digest, shingles(text, size), repeat(42))), dtype=">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; no hash: 0."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched for whole arrays at a time."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.nodes: list[tuple[int, dict[int, int]]] = []
        work: list[tuple[np.ndarray, int, int]] = [(np.arange(len(values)), -1, 0)] if len(values) else []
        while work:
            members, parent, distance = work.pop()
            at = len(self.nodes)
            self.nodes.append((int(members[0]), {}))
            if parent >= 0:
                self.nodes[parent][1][distance] = at
            rest = members[1:]
            if len(rest):
                far = np.bitwise_count(values[rest] ^ values[members[0]])
                work += [(rest[far == d], at, int(d)) for d in np.unique(far)]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """For each value that is within the radius of any query: the queries' positions and its own."""
        work = [(0, np.arange(len(queries)))] if self.nodes else []
        while work:
            at, asked = work.pop()
            value, children = self.nodes[at]
            far = np.bitwise_count(queries[asked] ^ self.values[value]).astype(np.int16)
            if (near := asked[far <= radius]).size:
                yield near, value
            for edge, child in children.items():
                if (follow := asked[np.abs(far - edge) <= radius]).size:
                    work.append((child, follow))


def merge_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position that each of n positions is linked to, over any number of links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def shard_tasks(members: DataFrame, key: str, spread: str, piece: int = PIECE) -> DataFrame:
    """The members of keys that at least two share, with (a, b): the two pieces of the key that meet in a task.

    A key with c pieces takes c (c + 1) / 2 tasks, and each member goes to c of them. ``own`` is the member's piece.
    """
    shared = members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.ceil(F.col("n") / piece).cast("int").alias("c"))
    own = members.join(shared, key).withColumn("own", F.pmod(F.xxhash64(spread, F.lit(7)), F.col("c")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return other.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("c", "other")


def shard_links(tasks: DataFrame, key: str, link: Callable[[pa.Table], tuple[np.ndarray, ...]], schema: str = "u long, v long") -> DataFrame:
    """The links, columns of ``schema``, that ``link`` finds in each (key, a, b), sorted together in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        names = [field.split()[0] for field in schema.split(", ")]
        for group in sorted_groups(batches, [key, "a", "b"]):
            if group.num_rows > 1:
                found.append(link(group))
                held += len(found[-1][0])
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)
                found, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return tasks.repartition(F.col(key), F.col("a"), F.col("b")).sortWithinPartitions(key, "a", "b").mapInArrow(run, schema)


def _bk_forest(radius: int) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]:
    def link(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        signed = group.column("fp").to_numpy()
        values, own = signed.view(np.uint64), group.column("own").to_numpy()
        across = own.min() != own.max()
        inner = np.flatnonzero(own == own.min())
        outer = np.flatnonzero(own != own.min()) if across else inner
        left, right = [], []
        for near, value in BKTree(values[inner]).search(values[outer], radius):
            left.append(outer[near])
            right.append(np.full(len(near), inner[value]))
        if not left:
            return signed[:0], signed[:0]
        label = merge_labels(len(signed), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return signed[moved], signed[label[moved]]

    return link


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document; fp is the fingerprint as a signed long."""
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t, size)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def fingerprint_links(classes: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that span the components within the radius."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    blocks = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1).cast("long")).alias("part")) for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))]
    members = classes.select("fp", F.explode(F.array(*blocks)).alias("at")).select("fp", F.xxhash64("at.block", "at.part").alias("key"))
    return shard_links(shard_tasks(members, "key", "fp"), "key", _bk_forest(radius))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    The component is that of the links between fingerprints of at most ``radius`` differing bits, and component_id its
    least doc_id. Null and wordless texts have fingerprint 0 and are linked like any other. A null doc_id keeps its row
    and is named by its component's least other id, or null if there is none. Repeated rows give repeated rows.
    """
    prints = checkpoint(fingerprints(docs, size, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(classes, radius), "u", "v")
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
