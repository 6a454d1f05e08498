import collections
import random

import pytest

from cardloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, place long, target double"


def model(sizes, weights=(1, 2, 3), repeats=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > repeats * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: float(repeats * sizes[s]) for s in full}
        rest -= sum(target[s] for s in full)
        free -= full
    return target


def made(seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", "Z", "", None, "\U0001f600", "zero"]
    rows = []
    for i in range(150):
        s = rng.choice(names) if i % 3 else "a"
        k = 0 if s == "zero" else rng.choice([0, 1, 5, 40, 300])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(["wörd\x85x"] * k), s, 1, 1.0))
    return [*rows, rows[1], (None, "x y", "a", 0, 0.0), (900, None, None, 0, 0.0), (901, "w " * 20_000, "b", 0, 0.0)]


@pytest.mark.parametrize(("block", "shard"), [(64, 700), (2048, 10**6), (7, 5000)])
def test_targets_and_words(spark, block, shard):
    rows = made(block)
    docs = spark.createDataFrame(rows, SCHEMA)
    size = lambda t: len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
    sizes = collections.Counter()
    for _, t, s, _, _ in rows:
        sizes[s] += size(t)
    want = model(sizes)
    got = mixing.mixture(docs, block=block, shard_words=shard).collect()
    assert sorted((str(r.doc_id), r.source or "", r.size) for r in got) == sorted((str(d), s or "", size(t)) for d, t, s, _, _ in rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1.001 for s in want)
    again = mixing.mixture(docs.repartition(3), block=block, shard_words=shard).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_pieces_are_disjoint_and_shards_get_their_quotas(spark):
    docs = spark.createDataFrame(made(5), SCHEMA)
    pieces = [r for r in mixing.mix(docs, block=32, shard_words=2000).collect() if r.words is not None]
    per_row = collections.defaultdict(list)
    for r in pieces:
        assert r.shard is not None and r.words > 0
        per_row[r.row, r["copy"]].append((r.word_from, r.words))
    for parts in per_row.values():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:]))
    shards = collections.Counter()
    for r in pieces:
        shards[r.shard] += r.words
    assert len(shards) > 5 and max(shards.values()) <= 2.2 * 2000


def test_split_is_exact_and_spread_as_it_should_be(spark):
    quotas = spark.createDataFrame([(0, 700), (1, 300), (2, 0), (3, 1)], "place long, quota long")
    rows = mixing.split_quotas(quotas, 10).collect()
    by = collections.defaultdict(list)
    per_shard = collections.Counter()
    for r in rows:
        by[r.place].append((r["first"], r.n))
        per_shard[r.shard] += r.n
    for place, quota in ((0, 700), (1, 300), (3, 1)):
        at = 0
        for first, n in sorted(by[place]):
            assert first == at
            at += n
        assert at == quota
    assert set(per_shard.values()) <= {100, 101} and sum(per_shard.values()) == 1001
    # over seeds, a shard's number of blocks of a source has the hypergeometric mean and spread
    draws = []
    for seed in range(40):
        draws += [r.n for r in mixing.split_quotas(spark.createDataFrame([(0, 50), (1, 50)], "place long, quota long"), 2, seed).collect() if r.place == 0]
    mean = sum(draws) / len(draws)
    spread = (sum((x - mean) ** 2 for x in draws) / len(draws)) ** 0.5
    assert mean == 25 and 1.7 < spread < 3.4  # exact: 2.51


def test_empty_tables(spark):
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = mixing.mixture(spark.createDataFrame([(1, None, None, 0, 0.0)], SCHEMA)).collect()
    assert [(r.doc_id, r.size, r.target, r.taken) for r in rows] == [(1, 0, 0.0, 0)]


def test_texts_of_pieces_with_clashing_columns(spark):
    docs = spark.createDataFrame(made(9), SCHEMA)
    got = mixing.mix_texts(docs, block=50, shard_words=3000).collect()
    plain = mixing.mix(docs, block=50, shard_words=3000).where("words is not null").collect()
    assert sorted((str(r.doc_id), r.word_from, r.words, r.shard) for r in got) == sorted((str(r.doc_id), r.word_from, r.words, r.shard) for r in plain)
    texts = {}
    for d, t, s, *_ in made(9):
        texts.setdefault(d, []).append(t)
    for r in got:
        assert any(r.text in (t or "") for t in texts[r.doc_id]) and len(r.text.replace("\n", " ").replace("\t", " ").split(" ")) >= r.words


def test_nodes_and_blocks_are_dealt_out(spark):
    """With more shards the tree's rows lie in more partitions, and with other levels of dealing out they are the same."""
    quotas = spark.createDataFrame([(0, 9000), (1, 300), (2, 77)], "place long, quota long")
    used = {}
    for shards in (8, 64, 1024):
        at = mixing.split_quotas(quotas, shards).selectExpr("spark_partition_id() as p").distinct().count()
        used[shards] = at
    assert used[8] == 1 and used[64] >= 8 and used[1024] >= 64


def test_a_source_of_very_many_shards_stays_whole(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "s", 0, 0.0) for i in range(200)], SCHEMA)
    got = mixing.mix(docs, block=3, shard_words=20, weights=(1,)).where("words is not null").collect()
    assert sum(r.words for r in got) == 10_000 and len({r.shard for r in got}) == 500
