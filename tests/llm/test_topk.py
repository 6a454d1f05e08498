import math
import random

import numpy as np
import pytest

from cardloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank int"


def made(seed, n=900, d=8):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)], 0, "x", 1) for i in range(n)]
    common = [0.5] * d
    rows += [(i, common, 0, "x", 1) for i in range(n, n + 300)]
    return [*rows, (None, common, 0, "", 0), (5000, None, 0, "", 0), (5100, [None] * d, 0, "", 0), (5200, [math.nan] * d, 0, "", 0), (5300, [math.inf] + [0.0] * (d - 1), 0, "", 0), rows[10], rows[100], rows[100], (5400, [0.0] * d, 0, "", 0), (5500, [-3e4] * d, 0, "", 0), (5600, [3e6] * d, 0, "", 0), (5700, [1.0], 0, "", 0), (5800, [2.0], 0, "", 0)]


def brute(rows, k=10):
    ok = [(r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for at, (q, own) in enumerate(ok):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for j, (i, v) in enumerate(ok) if j != at and len(v) == len(own))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard", [100, 8_192])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", 5)
    rows = made(shard)
    whole = topk.quantised(spark.createDataFrame(rows, SCHEMA))
    got = topk.top_k(whole, whole.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_fewer_candidates_and_empty(spark):
    whole = topk.quantised(spark.createDataFrame([(0, [1.0], 0, "", 0), (100, [2.0], 0, "", 0)], SCHEMA))
    assert sorted(map(tuple, topk.top_k(whole, whole).collect())) == [(0, 1, 100, 2 * 1024 * 1024), (100, 1, 0, 2 * 1024 * 1024)]
    none = topk.quantised(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(none, none).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-1000, 1000, (3000, 6)).astype(np.int32)
    tree = topk.MTree(np.arange(3000), vectors)
    for at in range(len(tree.pivot)):
        if tree.leaf[at]:
            rows = tree.entry[tree.first[at] : tree.last[at]]
            assert np.allclose(tree._far(tree.pivot[at], rows), tree.apart[tree.first[at] : tree.last[at]])
            assert (tree._far(tree.pivot[at], rows) <= tree.radius[at] + 1e-9).all()


def test_sums_beyond_floating_point_are_exact(spark):
    rng = random.Random(4)
    rows = [(i * 50, [float(np.float32(rng.uniform(-3e5, 3e5))) for _ in range(4)], 0, "", 0) for i in range(40)]
    whole = topk.quantised(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, topk.top_k(whole, whole.where("vec_id % 100 = 0")).collect())) == brute(rows)


def test_components_beyond_the_range_end_nowhere(spark):
    whole = topk.quantised(spark.createDataFrame([(0, [1e30, 1.0], 0, "", 0), (1, [1e30, 0.0], 0, "", 0), (2, [-1.0, 0.0], 0, "", 0)], SCHEMA))
    got = topk.top_k(whole, whole.where("vec_id = 0")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, -(2**63))]


def test_bounds_spare_most_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1000, (40, 16))
    vectors = np.round(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 40, (8000, 16))).astype(np.int64)
    tree = topk.MTree(np.arange(8000), vectors)
    for i in range(0, 8000, 400):
        got = tree.search(vectors[i], 10, i)
        scores = vectors @ vectors[i]
        assert got == sorted(((int(scores[j]), j) for j in range(8000) if j != i), key=lambda x: (-x[0], x[1]))[:10]
    assert tree.scored < 0.35 * 20 * 8000


@pytest.mark.parametrize("spread", [40, 1500])
def test_many_queries_share_the_pages(spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1000, (40, 16))
    vectors = np.round(centres[rng.integers(0, 40, 6000)] + rng.normal(0, spread, (6000, 16))).astype(np.int64)
    vectors[50:90] = vectors[50]
    tree, asked = topk.MTree(np.arange(6000) * 3 % 6007, vectors), np.arange(0, 6000, 25)
    of, score, name = tree.search_all(vectors[asked], 10, asked)
    got = {i: [] for i in range(len(asked))}
    for row in sorted(zip(of.tolist(), (-score).tolist(), name.tolist(), strict=True)):
        got[row[0]].append((-row[1], row[2]))
    assert [got[i] for i in range(len(asked))] == [tree.search(vectors[q], 10, q) for q in asked]
    if spread == 40:
        tree.scored = 0
        tree.search_all(vectors[asked], 10, asked)
        assert tree.scored < 0.35 * len(asked) * 6000


def test_trees_are_not_shuffled(spark):
    whole = topk.quantised(spark.createDataFrame([(i, [float(i % 7), 1.0], 0, "", 0) for i in range(300)], SCHEMA))
    plan = topk.top_k(whole, whole.where("vec_id % 100 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "Join" not in plan and "binary" not in plan
