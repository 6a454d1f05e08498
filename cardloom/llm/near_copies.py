"""Near copies of a given similarity: SimHash and BK-trees find them, shingle sets confirm them (stage of the pipeline).

Documents of one set of shingles are a class. Classes that share one of their least shingle hashes meet in a shard: two sets
of Jaccard similarity s share none of k least hashes with a chance of about (1 - s) ** k. Hashes that very many classes have are
taken last, also after those that no other class has, so that a line which many texts share draws only texts of little else.
A shard's BK-tree over SimHash fingerprints gives the pairs within a radius that pairs of the least similarity hardly ever
exceed, sizes rule others out, and the sets themselves decide.

A shard beyond one piece is a hot one, by near copies as a rule. Its pieces are first merged into balls: a leader and the
members within a small distance of it. Leaders alone meet across pieces. Jaccard distance is a metric, so two balls whose
leaders are further apart than the least similarity's distance and both radii hold no link; balls in between, unless they
are connected otherwise, meet member by member. So no link between components is lost, and what crosses pieces is a few
leaders. Links make components, each of which keeps its first document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, checkpoint, in_slices, sorted_groups
from cardloom.llm.components import components
from cardloom.llm.simhash import PIECE, BKTree, fingerprint, shard_links, shard_tasks, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Least shingle hashes by which classes meet, and those that they are chosen from; bits that fingerprints of similar sets
#: may differ in.
KEYS, STORED, RADIUS = 7, 14, 24
#: Greatest distance of a ball's members from its leader.
BALL = 0.05
#: Shingles of a piece, so that its sets stay small whatever the texts' length; and those that are compared at a time.
PIECE_SHINGLES, STEP_SHINGLES = 4_000_000, 1_000_000


class _Piece:
    """Members of a task with their fingerprints and sets; the sets as one array of small numbers, one per shingle."""

    def __init__(self, group: pa.Table):
        self.names = group.column("cls").to_numpy()
        self.prints = group.column("fp").to_numpy().view(np.uint64)
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in group.column("hashes")]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        values, codes = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint32)]), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.held = np.zeros(len(values), dtype=np.uint8)

    def alike(self, one: int, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the others whose Jaccard similarity (of two empty sets 1) is at least ``least``, and the similarities."""
        low, high = np.minimum(self.sizes[one], self.sizes[others]), np.maximum(self.sizes[one], self.sizes[others])
        others = others[low >= (least - 1e-12) * high]
        out = np.empty(len(others))
        own = self.codes[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.held[own] = 1
        upto, at = np.cumsum(self.sizes[others]), 0
        while at < len(others):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP_SHINGLES, side="right")))
            sizes = self.sizes[others[at:to]]
            ends = np.cumsum(sizes)
            places = np.repeat(self.starts[others[at:to]] - ends + sizes, sizes) + np.arange(ends[-1])
            shared = np.concatenate([[0], np.cumsum(self.held[self.codes[places]], dtype=np.int64)])
            both = shared[ends] - shared[ends - sizes]
            out[at:to] = both / np.maximum(sizes + self.sizes[one] - both, 1) + ((sizes == 0) & (self.sizes[one] == 0))
            at = to
        self.held[own] = 0
        some = out >= least - 1e-12
        return others[some], out[some]


def _confirm(group: pa.Table, least: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (u, v, True) that span the components of a task, and pairs (u, v, False) of balls that may hold a link.

    Hits of the tree are taken value by value and only where they aren't joined yet, so memory follows the members.
    """
    piece, own = _Piece(group), group.column("own").to_numpy()
    reach = group.column("r").to_numpy() if "r" in group.column_names else np.zeros(len(own))
    inner = np.flatnonzero(own == own.min())
    outer = np.flatnonzero(own != own.min()) if own.min() != own.max() else inner
    label = np.arange(len(own))
    sure, near = [], [np.zeros((2, 0), dtype=np.int32)]
    for found, value in BKTree(piece.prints[inner]).search(piece.prints[outer], radius):
        one = int(inner[value])
        others = outer[found]
        others = others[label[others] != label[one]]
        if not len(others):
            continue
        others, alike = piece.alike(one, others, least - float(reach[one] + reach[others].max()))
        for other in others[alike >= least - 1e-12].tolist():
            if label[other] != label[one]:
                low, high = sorted((label[one], label[other]))
                label[label == high] = low
                sure.append((one, other))
        loose = others[(alike < least - 1e-12) & (alike >= least - reach[one] - reach[others] - 1e-12) & (reach[one] + reach[others] > 0)]
        if len(loose):
            near.append(np.stack([np.full(len(loose), one, dtype=np.int32), loose.astype(np.int32)]))
    left, right = np.concatenate(near, axis=1)
    apart = label[left] != label[right]
    us, vs = np.array(sure, dtype=np.int64).reshape(-1, 2).T
    us, vs = np.concatenate([us, left[apart]]), np.concatenate([vs, right[apart]])
    return piece.names[us], piece.names[vs], np.arange(len(us)) < len(sure)


def _balls(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(key, leader, cls, far) of each piece: every member with the first member that is within BALL of it."""
    for group in sorted_groups(batches, ["key", "own"]):
        piece, key = _Piece(group), group.column("key")[0].as_py()
        free = np.arange(len(piece.names))
        leaders, members, far = [], [], []
        while len(free):
            one, rest = int(free[0]), free[1:]
            taken, alike = piece.alike(one, rest[np.bitwise_count(piece.prints[rest] ^ piece.prints[one]) <= radius], 1 - BALL)
            taken, apart = np.append(taken, one), np.append(1 - alike, 0.0)
            free = np.setdiff1d(free, taken, assume_unique=True)
            leaders.append(np.full(len(taken), piece.names[one]))
            members.append(piece.names[taken])
            far.append(apart)
        leaders, members, far = map(np.concatenate, (leaders, members, far))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), key), pa.int64()), pa.array(leaders, pa.int64()), pa.array(members, pa.int64()), pa.array(far, pa.float64())], names=["key", "leader", "cls", "far"])


def _partners(batches: Iterator[pa.RecordBatch], least: float, radius: int) -> Iterator[pa.RecordBatch]:
    """(key, cls) of those members of a shard that any other may be linked to, by fingerprints and sizes alone."""
    for group in sorted_groups(batches, ["key"]):
        prints, sizes = group.column("fp").to_numpy().view(np.uint64), group.column("size").to_numpy()
        some = np.zeros(len(prints), dtype=bool)
        for found, value in BKTree(prints).search(prints, radius):
            fits = np.minimum(sizes[found], sizes[value]) >= least * np.maximum(sizes[found], sizes[value])
            found = found[fits & (found != value)]
            some[found] = True
            some[value] |= len(found) > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([group.column(c).combine_chunks().filter(pa.array(some)) for c in ("key", "cls")], names=["key", "cls"])


def _class_links(members: DataFrame, sets_for: Callable[[DataFrame], DataFrame], least: float, radius: int, piece: int) -> DataFrame:
    """(u, v): links between classes that share a key, as many as connect what is linked. ``members``: key, cls, size, fp;
    ``sets_for`` gives the sets (cls, fp, hashes) of the classes that need comparing, which are kept until all links are."""
    scratch = Scratch(members.sparkSession)
    links = checkpoint(_compared(members, sets_for, least, radius, piece, scratch))
    scratch.clear()
    return links


def _compared(members: DataFrame, sets_for: Callable[[DataFrame], DataFrame], least: float, radius: int, piece: int, scratch: Scratch) -> DataFrame:
    weight = F.greatest(F.ceil(F.count("*") / piece), F.ceil(F.sum("size") / PIECE_SHINGLES)).cast("int")
    counted = members.groupBy("key").agg(F.count("*").alias("n"), weight.alias("c")).where("n > 1")
    dealt = checkpoint(members.join(counted.select("key", "c"), "key").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("c")).cast("int")))
    kind = "u long, v long, sure boolean"
    confirm = lambda tasks: shard_links(tasks, "key", lambda group: _confirm(group, least, radius), kind)
    single = dealt.where("c = 1").select("key", "cls", "size", "fp").repartition("key").sortWithinPartitions("key")
    single = checkpoint(single.mapInArrow(lambda batches: _partners(batches, least, radius), "key long, cls long"))
    hot = dealt.where("c > 1").select("key", "cls", "own")
    # which sets either part needs, so that no join shuffles the other's
    needed = single.select("cls", F.lit(True).alias("alone"), F.lit(False).alias("crowded")).unionByName(hot.select("cls", F.lit(False).alias("alone"), F.lit(True).alias("crowded")))
    needed = checkpoint(needed.groupBy("cls").agg(F.max("alone").alias("alone"), F.max("crowded").alias("crowded")))
    every = scratch.keep(sets_for(needed.select("cls")).join(needed, "cls"), "sets")
    sets = every.where("alone").drop("alone", "crowded")
    links = confirm(single.withColumns({x: F.lit(0) for x in ("own", "a", "b")}).join(sets, "cls")).select("u", "v")
    if dealt.where("c > 1").isEmpty():
        return links
    sets = every.where("crowded").drop("alone", "crowded")
    hot = hot.join(sets, "cls").repartition(F.col("key"), F.col("own")).sortWithinPartitions("key", "own")
    balls = checkpoint(hot.mapInArrow(lambda batches: _balls(batches, radius), "key long, leader long, cls long, far double"))
    leaders = balls.groupBy("key", F.col("leader").alias("cls")).agg(F.max("far").alias("r"))
    across = checkpoint(confirm(shard_tasks(leaders, "key", "cls", piece).join(sets, "cls")))
    links = checkpoint(links.unionByName(balls.where("leader <> cls").select(F.col("leader").alias("u"), F.col("cls").alias("v"))).unionByName(across.where("sure").select("u", "v")))
    unsure = across.where("not sure").select("u", "v").distinct()
    if unsure.isEmpty():
        return links
    # balls that may hold a link, and that no other links connect, meet member by member
    roots = components(links, "u", "v")
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = unsure.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").where("coalesce(u_root, u) <> coalesce(v_root, v)")
    apart = checkpoint(apart.select("u", "v", F.xxhash64("u", "v").alias("key")))
    of = balls.select("leader", "cls").distinct()
    rows = apart.select("key", F.col("u").alias("leader")).unionByName(apart.select("key", F.col("v").alias("leader"))).join(of, "leader").select("key", "cls").distinct()
    return links.unionByName(confirm(shard_tasks(rows, "key", "cls", piece).join(sets, "cls")).select("u", "v"))


def _distinct(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def first_of_copies(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, keys: int = KEYS, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """The documents, all columns, without those that are copies or near copies of one that stays.

    Of each component the row of the least doc_id stays (null ids last; of rows of one id, that of the least hash of its
    text, and of repeated rows one). Near copies share ``least`` of their sets of lower-cased shingles; a text of fewer words
    is one shingle, and texts without words, null ones too, are copies of each other. Texts of any length are read whole; a
    task's sets are bounded by PIECE_SHINGLES, or one text.
    """
    from xxhash import xxh64_intdigest

    schema = "doc_id long, th long, cls long, fp long, size long, keys array<long>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [_distinct(t, size) for t in batch.column(2).to_pylist()]
            cls = np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.array([fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
            least_of = [s[: 2 * keys].view(np.int64).tolist() for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls), pa.array(prints), sizes, pa.array(least_of, pa.list_(pa.int64()))], names=["doc_id", "th", "cls", "fp", "size", "keys"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [_distinct(t, size) for t in batch.column(0).to_pylist()]
            cls = np.array([xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            prints = np.array([fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(prints), pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in map(_top, sets)], pa.binary())], names=["cls", "fp", "hashes"])

    text_hash = F.xxhash64("text")
    measured = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("th"), "text").mapInArrow(measure, schema))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")
    classes = measured.groupBy("cls").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min(order).alias("first"))
    # keys that many classes have come last
    stored = classes.select("cls", F.explode("keys").alias("key"))
    crowded = stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > piece).select("key")
    hot = stored.join(crowded, "key").groupBy("cls").agg(F.collect_list("key").alias("hot"))
    ranked = classes.join(hot, "cls", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<long>")))
    chosen = F.slice(F.concat(F.array_except("keys", "hot"), F.array_intersect("keys", "hot")), 1, keys)
    members = checkpoint(ranked.select("cls", "size", "fp", F.explode(chosen).alias("key")))

    def sets_for(names: DataFrame) -> DataFrame:
        wanted = names.join(classes, "cls").select(F.col("first.th").alias("th"))
        texts = docs.select("text", text_hash.alias("th")).join(wanted, "th", "left_semi").select("text")
        return texts.mapInArrow(sets_of, "cls long, fp long, hashes binary").groupBy("cls").agg(F.min("fp").alias("fp"), F.min("hashes").alias("hashes"))

    links = _class_links(members, sets_for, least, radius, piece)
    roots = components(links, "u", "v")
    placed = classes.join(roots, classes.cls == roots.node, "left").select("first", F.coalesce("root", "cls").alias("root"))
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.th").alias("kept_th"))
    same = F.col("kept_th").eqNullSafe(F.col("th")) & F.col("kept_id").eqNullSafe(F.col("doc_id"))
    rows = measured.groupBy("doc_id", "th").agg(F.count("*").alias("n")).join(kept, same, "left_semi")
    ours = [f"_cardloom_{c}" for c in ("id", "text", "n", "own", "at")]  # beside any columns that documents have
    names = rows.select(F.col("doc_id").alias(ours[0]), F.col("th").alias(ours[1]), F.col("n").alias(ours[2]))
    held = docs.withColumn(ours[3], text_hash).join(names, F.col(ours[1]).eqNullSafe(F.col(ours[3])) & F.col(ours[0]).eqNullSafe(F.col("doc_id")))
    # rows that repeat an id and a text: one of them
    once = held.where(F.col(ours[2]) == 1).select(docs.columns)
    order = Window.partitionBy(*ours[:2]).orderBy(*(c for c in docs.columns if c != "text"))
    again = held.where(F.col(ours[2]) > 1).withColumn(ours[4], F.row_number().over(order)).where(F.col(ours[4]) == 1).select(docs.columns)
    return once.unionByName(again)


def _top(hashes: np.ndarray) -> np.ndarray:
    """Hashes whose upper halves differ, in order."""
    upper = hashes >> np.uint64(32)
    return hashes[np.concatenate([[True], upper[1:] != upper[:-1]])] if len(hashes) else hashes
