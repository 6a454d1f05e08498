"""Exact top-k by inner product through M-trees searched best first (operator 8).

Components are turned into integers, so scores are exact: by floating point where no sum can pass 2 ** 53, by Python's
integers elsewhere; what passes the range of a long is held at its end. The inner product becomes a metric: with every vector x given
one more component sqrt(M - |x|^2), M the greatest squared length in the tree, and a query given 0 there, the squared
distance is |q|^2 + M - 2 q.x, which falls as the score grows.

Vectors are dealt in shards of bounded size. Each shard is bulk-loaded into an M-tree where its queries come: leaves are
pages of vectors with their distances to the page's pivot, routing nodes keep covering radii and the distance to their
parent's pivot. A search takes the page of the least possible distance first, and the triangle inequality rules out nodes
and pages before their vectors are scored, for all of a block's queries by one matrix product a page. Queries go to every
shard; the best of each shard are merged by one window. Neither trees nor any of the data are broadcast or shuffled whole.
"""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import checkpoint, give_back

#: Vectors of a shard at least and at most, and the number of shards up to which they stay small; vectors of a page, branches
#: of a routing node, queries of a block and those that are searched at a time.
SHARD, MOST, SHARDS, PAGE, FAN, BLOCK, STEP = 2_048, 65_536, 64, 128, 16, 65_536, 1024
SCALE = 1024


class MTree:
    """Arrays of nodes and of entries; node 0 is the root. Distances are those of the extended vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.vectors, self.rows = ids, vectors, np.arange(len(ids)) if rows is None else rows
        self.scored = 0  # entries whose score has been computed
        lengths = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.top = float(lengths.max()) if len(ids) else 0.0
        self.points = np.concatenate([vectors.astype(np.float64), np.sqrt(np.maximum(self.top - lengths, 0))[:, None]], axis=1)
        nodes: list[tuple] = []  # pivot, radius, distance to the parent's pivot, first and last child or entry, leaf?
        entries: list[np.ndarray] = []
        apart: list[np.ndarray] = []
        filled = 0
        work = [(np.arange(len(ids)), 0, -1.0)] if len(ids) else []
        nodes += [None] * len(work)  # type: ignore[list-item]
        while work:
            members, at, to_parent = work.pop()
            centre = self.points[members].mean(axis=0)
            pivot = int(members[np.argmin(((self.points[members] - centre) ** 2).sum(axis=1))])
            far = self._far(pivot, members)
            if len(members) <= PAGE or far.max() == 0:
                order = np.argsort(far, kind="stable")
                entries.append(members[order])
                apart.append(far[order])
                nodes[at] = (pivot, far.max(), to_parent, filled, filled + len(members), 1)
                filled += len(members)
                continue
            parts = self._parts(members, far)
            nodes[at] = (pivot, far.max(), to_parent, len(nodes), len(nodes) + len(parts), 0)
            for part in parts:
                centre = self.points[part].mean(axis=0)
                child = int(part[np.argmin(((self.points[part] - centre) ** 2).sum(axis=1))])
                work.append((part, len(nodes), float(np.sqrt(((self.points[pivot] - self.points[child]) ** 2).sum()))))
                nodes.append(None)  # type: ignore[arg-type]
        table = np.array(nodes, dtype=np.float64).reshape(-1, 6)
        self.pivot, self.first, self.last = (table[:, i].astype(np.int64) for i in (0, 3, 4))
        self.radius, self.to_parent, self.leaf = table[:, 1], table[:, 2], table[:, 5] > 0
        self.entry = np.concatenate(entries) if entries else np.zeros(0, dtype=np.int64)
        self.apart = np.concatenate(apart) if apart else np.zeros(0)

    def _far(self, pivot: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[members] - self.points[pivot]) ** 2).sum(axis=1))

    def _parts(self, members: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """Members by the nearest of some far-apart pivots; even slices where pivots don't part them."""
        nearest, label = far, np.zeros(len(members), dtype=np.int64)
        for i in range(1, FAN):
            new = int(np.argmax(nearest))
            if nearest[new] == 0:
                break
            d = self._far(int(members[new]), members)
            closer = d < nearest
            nearest = np.where(closer, d, nearest)
            label[closer] = i
        parts = [members[label == i] for i in np.unique(label)]
        return parts if max(map(len, parts)) < len(members) else np.array_split(members, 2)

    def _scores(self, entries: np.ndarray, whole: np.ndarray, query: np.ndarray) -> np.ndarray:
        self.scored += len(entries)
        if np.abs(query).max() * self.most * len(query) < 2**53:
            return (self.floats[entries] @ query).astype(np.int64)
        exact = [sum(map(int.__mul__, v, whole.tolist())) for v in self.vectors[entries].tolist()]
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], dtype=np.int64)

    @cached_property
    def floats(self) -> np.ndarray:
        return self.vectors.astype(np.float64)

    @cached_property
    def most(self) -> float:
        return float(np.abs(self.floats).max()) if self.floats.size else 0.0

    def search(self, query: np.ndarray, k: int, own: int | None = None) -> list[tuple[int, int]]:
        """The k entries of the highest scores, (score, id), but for the entry of row ``own``; ties to the smaller id."""
        if not len(self.ids):
            return []
        whole, query = query, query.astype(np.float64)
        point = np.append(query, 0.0)
        length = float(query @ query)
        slack = 1e-6 * (1 + np.sqrt(length + self.top))  # above any rounding of distances
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        reach = np.inf
        root = float(np.sqrt(((point - self.points[self.pivot[0]]) ** 2).sum()))
        queue = [(max(0.0, root - self.radius[0]), 0, root)]
        while queue:
            bound, at, distance = heapq.heappop(queue)
            if bound > reach + slack:
                break
            low, high = self.first[at], self.last[at]
            if self.leaf[at]:
                rows = self.entry[low:high]
                if reach < np.inf:
                    rows = rows[np.abs(distance - self.apart[low:high]) <= reach + slack]
                scores = self._scores(rows, whole, query)
                if len(best) == k:
                    may = scores >= best[0][0]
                    rows, scores = rows[may], scores[may]
                for score, name, row in sorted(zip(scores.tolist(), (-self.ids[rows]).tolist(), self.rows[rows].tolist(), strict=True), reverse=True)[: k + 1]:
                    if row == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, name))
                    elif (score, name) > best[0]:
                        heapq.heapreplace(best, (score, name))
                if len(best) == k:
                    reach = float(np.sqrt(max(0.0, length + self.top - 2.0 * best[0][0])))
                continue
            children = np.arange(low, high)
            if reach < np.inf:  # by the stored distance to the parent, without computing the child's own
                children = children[np.abs(distance - self.to_parent[low:high]) - self.radius[low:high] <= reach + slack]
            apart = np.sqrt(((self.points[self.pivot[children]] - point) ** 2).sum(axis=1))
            bounds = np.maximum(apart - self.radius[children], 0.0)
            for child, bound, d in zip(children.tolist(), bounds.tolist(), apart.tolist(), strict=True):
                if bound <= reach + slack:
                    heapq.heappush(queue, (bound, child, d))
        return sorted(((s, -n) for s, n in best), key=lambda x: (-x[0], x[1]))

    def search_all(self, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, score, id): ``search`` for many queries at once, a page being scored for all that need it.

        Every query first takes the page of its least bound, which gives it a bar; then pages go by their least bounds, each
        once, to the queries whose bars its bound doesn't pass. Queries whose sums may pass 2 ** 53 are searched one by one.
        """
        m = len(queries)
        floats = queries.astype(np.float64)
        plain = np.abs(floats).max(axis=1, initial=0.0) * self.most * queries.shape[1] < 2**53
        single = [(i, s, n) for i in np.flatnonzero(~plain).tolist() for s, n in self.search(queries[i], k, None if own is None else int(own[i]))]
        lengths = (floats**2).sum(axis=1)
        slack = 1e-6 * (1 + np.sqrt(lengths + self.top))
        pivots = self.points[self.pivot]
        squared = lengths[:, None] + (pivots**2).sum(axis=1) - 2.0 * (floats @ pivots[:, :-1].T)
        # the squares' rounding, carried to the distances, lowers the bounds
        apart = np.sqrt(np.maximum(squared - 1e-12 * (lengths[:, None] + self.top + 1) * queries.shape[1], 0.0))
        bounds = np.maximum(apart - self.radius, 0.0)
        for at in np.flatnonzero(~self.leaf).tolist():  # children come after their parents
            part = slice(self.first[at], self.last[at])
            bounds[:, part] = np.maximum(bounds[:, part], bounds[:, at : at + 1])
        leaves = np.flatnonzero(self.leaf)
        bounds = bounds[:, leaves]
        scores, ids, reach = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max), np.full(m, np.inf)

        def page(leaf: int, asks: np.ndarray) -> None:
            rows = self.entry[self.first[leaves[leaf]] : self.last[leaves[leaf]]]
            self.scored += len(rows) * len(asks)
            found = floats[asks] @ self.floats[rows].T
            may = found >= scores[asks, -1][:, None]
            if own is not None:
                may &= self.rows[rows] != own[asks][:, None]
            of, at = np.nonzero(may)
            if not len(of):
                return
            better = np.unique(of)
            at_query = np.concatenate([of, np.repeat(better, k)])
            value = np.concatenate([found[of, at], scores[asks[better]].ravel()])
            name = np.concatenate([self.ids[rows[at]], ids[asks[better]].ravel()])
            order = np.lexsort((name, -value, at_query))
            at_query = at_query[order]
            rank = np.arange(len(order)) - np.searchsorted(at_query, at_query)
            kept = order[rank < k]
            scores[asks[better]], ids[asks[better]] = value[kept].reshape(-1, k), name[kept].reshape(-1, k)
            bar = scores[asks[better], -1]
            some = np.isfinite(bar)
            reach[asks[better[some]]] = np.sqrt(np.maximum(0.0, lengths[asks[better[some]]] + self.top - 2.0 * bar[some]))

        if len(leaves) and plain.any():
            nearest = np.where(plain, bounds.argmin(axis=1), -1)
            for leaf in np.unique(nearest[plain]).tolist():
                page(leaf, np.flatnonzero(nearest == leaf))
            for leaf in np.argsort(bounds[plain].min(axis=0), kind="stable").tolist():
                asks = np.flatnonzero(plain & (nearest != leaf) & (bounds[:, leaf] <= reach + slack))
                if len(asks):
                    page(leaf, asks)
        of, at = np.nonzero(np.isfinite(scores))
        more = [np.array(x, dtype=np.int64) for x in zip(*single, strict=True)] if single else [np.zeros(0, dtype=np.int64)] * 3
        return np.concatenate([of, more[0]]), np.concatenate([scores[of, at].astype(np.int64), more[1]]), np.concatenate([ids[of, at], more[2]])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), dtype=np.int32)


def _search(k: int, not_itself: bool):
    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.zeros(0, dtype=np.int64)] * 4
        if held.num_rows and asked.num_rows:
            tree = MTree(held.column("vec_id").to_numpy(), _matrix(held.column("v")), held.column("row").to_numpy())
            rows, ids, queries = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy(), _matrix(asked.column("v"))
            parts = []
            for low in range(0, len(rows), STEP):
                step = slice(low, low + STEP)
                of, score, name = tree.search_all(queries[step], k, rows[step] if not_itself else None)
                parts.append((rows[step][of], ids[step][of], name, score))
            found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        give_back()
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["row", "query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of each component as a long, or the long nearest to it, and a number for each row.

    Null ids, and vectors that are null, empty or hold a null, NaN or infinite component, take no part. Rows are numbered once
    and for all, through the shared folder, as repeated ids are rows of their own.
    """
    whole = F.col("e").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & whole)
    return checkpoint(plain.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, not_itself: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score) from (row, vec_id, v) tables: for each query its k highest integer inner products.

    Ties go to the smaller vec_id; fewer candidates give fewer rows; with ``not_itself``, a query's own row is no candidate.
    Every other row is one, also of the same id, and rows of one id are queries of their own. Only vectors of a query's length
    are its candidates.
    """
    vectors, queries = (x.withColumn("d", F.size("v")) for x in (vectors, queries))
    n, asked = vectors.count(), queries.count()
    size = min(max(SHARD, -(-n // SHARDS)), max(SHARD, MOST))
    shards, blocks = max(1, -(-n // size)), max(1, -(-asked // BLOCK))
    place = lambda of: F.pmod(F.xxhash64("row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    keys = ["d", "shard", "block"]
    held = vectors.select("*", place(shards).alias("shard"), every(blocks).alias("block")).groupBy(keys)
    dealt = queries.select("*", place(blocks).alias("block"), every(shards).alias("shard")).groupBy(keys)
    found = held.cogroup(dealt).applyInArrow(_search(k, not_itself), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
