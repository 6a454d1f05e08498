"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 1).

In built-in functions alone. Each source's documents stand in an order of their own (by a keyed hash) and make a stream
of words, which is read again from its start where the target exceeds the source. The stream's first ``target`` words are
cut into blocks. A tree of output shards splits the blocks' quotas: at each node the left half's share of every source
is drawn from the multivariate hypergeometric distribution, until each shard has its exact number of blocks of each
source. Shards then draw disjoint ranges of the source's permuted blocks, and order what they have by a keyed hash.

Sums are exact: every word of a quota is taken once. No source is gathered in one task: words before a document are
summed in two levels, and blocks meet documents by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import WORD, checkpoint, n_words

#: Words of a block, and of an output shard on average.
BLOCK_WORDS, SHARD_WORDS = 2_048, 1_000_000
#: Blocks of a shard and source that one row stands for until they are drawn.
RUN_BLOCKS = 4_096
#: Documents of a source that one window orders, on average.
RUN_DOCS = 1_024
#: Levels of the tree between exchanges of its nodes, blocks that a task draws on average, and partitions at most.
SPREAD_LEVELS, TASK_BLOCKS, MOST_PARTS = 5, 100_000, 20_000
#: No word is taken more often.
REPEATS = 3
SEED = 20_240_229


def _targets(totals: DataFrame, weights: list[float], repeats: int) -> DataFrame:
    """(source, source_size, n_docs) with place, weight and target; one row per source.

    Targets share all sizes by weight. What would exceed ``repeats`` times a source is shared again among the others. The
    sources that stop are those of the least repeats * size / weight, so their running sums give the level at which the
    others' weights use up the rest. The table has one row per source, and is small whatever the corpus.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    ranked = totals.withColumn("place", F.row_number().over(by_name).cast("long") - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", F.col("most") / F.col("weight"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", left / open_weight)
    # the first source, by ratio, that its level doesn't fill: from there on all take their weight's share of that level
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("level", "ratio", "most")


def _hypergeometric(population: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL: how many of ``drawn`` items out of ``population`` are among the ``marked``, by inverting a uniform number.

    Weights run from the least value of note (ten deviations below the mean) by the ratio of neighbouring
    probabilities; a second run stops where their sum passes the uniform share of the total.
    """
    mean = f"({drawn} * ({marked} / greatest({population}, 1)))"
    spread = f"sqrt(greatest({mean} * (1 - {marked} / greatest({population}, 1)) * (({population} - {drawn}) / greatest({population} - 1, 1)), 0))"
    low = f"greatest(0, {drawn} - ({population} - {marked}), cast(floor({mean} - 10 * {spread} - 10) as bigint))"
    high = f"least({marked}, {drawn}, cast(ceil({mean} + 10 * {spread} + 10) as bigint))"
    ratio = f"(cast({marked} - k as double) * ({drawn} - k)) / (cast(k + 1 as double) * ({population} - {marked} - {drawn} + k + 1))"
    total = f"aggregate(sequence({low}, {high}), struct(1D as w, 0D as total), (s, k) -> struct(s.w * {ratio} as w, s.total + s.w as total), s -> s.total)"
    return (
        f"aggregate(sequence({low}, {high}), struct(1D as w, {total} * {uniform} as rest, {low} as at), "
        f"(s, k) -> struct(s.w * {ratio} as w, s.rest - s.w as rest, if(s.rest - s.w > 0, least(k + 1, {high}), s.at) as at), s -> s.at)"
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(place, quota) of each source to (shard, place, first, n): each shard's range of the source's permuted blocks.

    One row holds a tree node: its range of shards, and for each source that it has blocks of the first one and their number. A
    level of the tree is one projection. After SPREAD_LEVELS levels the nodes are dealt out by their first shard, so that the
    subtrees, and the rows that come of them, are many tasks' work; with more shards they are dealt out more finely. The
    table of sources is taken to be small (it is one array of the root); that of shards and blocks isn't.
    """
    nodes = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("q")).where("size(q) > 0")
    nodes = nodes.selectExpr("0L as low", f"{shards}L as high", "transform(q, x -> struct(x.place as place, 0L as first, x.quota as n)) as has", "aggregate(q, 0L, (s, x) -> s + x.quota) as total")
    nodes = nodes.withColumn("all", F.col("total"))
    for level in range((shards - 1).bit_length()):
        middle = "cast(floor((low + high) / 2) as bigint)"
        # blocks that shards below m hold together: evenly, exact at each node
        room = lambda m: f"cast(floor(cast(all as decimal(38,0)) * {m} / {shards}) as bigint)"
        uniform = f"(pmod(xxhash64({seed}, {level}, low, x.place), 9007199254740992L) / 9007199254740992D)"
        draw = _hypergeometric("d.population", "x.n", "d.room", uniform)
        drawn = (
            f"aggregate(has, struct(total as population, {room(middle)} - {room('low')} as room, cast(array() as array<bigint>) as got), "
            f"(d, x) -> transform(array({draw}), g -> named_struct('population', d.population - x.n, 'room', d.room - g, 'got', concat(d.got, array(g))))[0], d -> d.got)"
        )
        nodes = nodes.selectExpr("low", "high", "has", "total", "all", f"if(high - low > 1, {drawn}, cast(null as array<bigint>)) as got", f"{middle} as middle")
        left = "struct(low, middle as high, zip_with(has, got, (x, g) -> struct(x.place as place, x.first as first, g as n)) as has, aggregate(got, 0L, (s, g) -> s + g) as total)"
        right = "struct(middle as low, high, zip_with(has, got, (x, g) -> struct(x.place as place, x.first + g as first, x.n - g as n)) as has, total - aggregate(got, 0L, (s, g) -> s + g) as total)"
        nodes = nodes.selectExpr("all", f"explode(if(got is null, array(struct(low, high, has, total)), array({left}, {right}))) as node").selectExpr("node.*", "all")
        nodes = nodes.withColumn("has", F.expr("filter(has, x -> x.n > 0)"))
        if (level + 1) % SPREAD_LEVELS == 0:
            nodes = nodes.repartition(max(1, min(2 ** (level + 1), shards, MOST_PARTS)), "low")
    return nodes.selectExpr("low as shard", "inline(has)").where("n > 0").select("shard", "place", "first", "n")


#: Primes. No quota below their product is a multiple of all.
_STEPS = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081)


def _permuted(rank: str, quota: str, seed: int) -> Column:
    """A bijection of 0 .. quota - 1, by the first step that doesn't divide the quota."""
    step = F.coalesce(*(F.when(F.col(quota) % s != 0, F.lit(s)) for s in _STEPS))
    return F.pmod(F.col(rank).cast("decimal(20,0)") * step + F.pmod(F.xxhash64(F.lit(seed), F.lit(quota)), F.lit(1 << 30)), F.col(quota)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = REPEATS, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix, piece by piece: row, doc_id, source, size, source_size, target, copy, word_from, words, shard, place.

    Each piece is ``words`` words of a document from its word ``word_from`` on, in its ``copy``-th reading; ``shuffle`` is
    the key by which a shard's pieces are put in order. A document that the mix leaves out has one row with words null.
    Targets of less than a word are rounded down. A null source is one more source, after all others; null texts have size
    0 and no pieces; null ids and repeated rows stand for themselves. Where all sizes are 0, all targets are 0.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), id_col, text_col)
    sized = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = checkpoint(_targets(totals, list(weights), repeats).withColumn("words", F.floor("target").cast("long")).withColumn("quota", F.ceil(F.col("words") / block).cast("long")))
    shards = max(1, -(-(plan.agg(F.sum("words")).first()[0] or 0) // shard_words))

    # words before each document in its source's order: runs of documents by hash, then within a run
    here = F.pmod(F.col("key"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    placed = sized.join(plan.select(F.col("source").alias("name"), "place", "source_size", "target", "words", "n_docs", "quota"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = placed.withColumn("run", F.floor(here * F.ceil(F.col("n_docs") / RUN_DOCS)).cast("long"))
    runs = placed.groupBy("place", "run").agg(F.sum("size").alias("run_size"))
    runs = runs.withColumn("run_first", F.coalesce(F.sum("run_size").over(Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("run_size")
    within = Window.partitionBy("place", "run").orderBy(F.pmod(F.col("key"), F.lit(1 << 40)), "key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(runs, ["place", "run"]).withColumn("first", F.col("run_first") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    # pieces: a document's words in each reading of the stream, cut at blocks and at the target's end
    read = placed.withColumn("copy", F.explode_outer(F.expr(f"filter(sequence(0, {repeats - 1}), c -> size > 0 and c * source_size + first < words)")))
    read = read.withColumn("begin", F.col("copy") * F.col("source_size") + F.col("first")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
    cut = read.withColumn("block", F.explode_outer(F.expr(f"if(copy is null, null, sequence(begin div {block}, (end - 1) div {block}))")))
    start = F.greatest("begin", F.col("block") * block)
    cut = cut.withColumn("word_from", start - F.col("begin")).withColumn("taken", F.least(F.col("end"), (F.col("block") + 1) * block) - start)
    # blocks in permuted order: a step that shares no factor with the quota visits each once
    ranges = split_quotas(plan.select("place", "quota"), shards, seed).join(plan.select("place", "quota"), "place")
    # a shard's blocks of a source in rows of bounded length, dealt out before each becomes a row of its own
    run = F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN_BLOCKS})"))
    runs_of = ranges.select("shard", "place", "quota", "first", "n", run.alias("at")).select("shard", "place", "quota", (F.col("first") + F.col("at") * RUN_BLOCKS).alias("low"), (F.col("first") + F.least(F.col("n"), (F.col("at") + 1) * RUN_BLOCKS) - 1).alias("high"))
    tasks = max(1, min(-(-shards * shard_words // (block * TASK_BLOCKS)), MOST_PARTS))
    drawn = runs_of.repartition(tasks, "place", "low").select("shard", "place", "quota", F.explode(F.sequence("low", "high")).alias("rank"))
    drawn = drawn.select("shard", "place", _permuted("rank", "quota", seed).alias("block"))
    mixed = cut.join(drawn, ["place", "block"], "left")
    return mixed.select("row", "doc_id", "source", "size", "source_size", "target", "copy", "word_from", F.col("taken").alias("words"), "shard", F.xxhash64(F.lit(seed), "key", "copy", "block").alias("shuffle"), "key")


def mixture(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document of the mix: doc_id, source, size, source_size, target, taken, pieces (and those of ``mix``)."""
    return mix(docs, **options).groupBy("row").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.count("words").alias("pieces")).drop("row")


def mix_texts(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The mix with its texts: all columns of the documents, the text being that of the piece, and source_size, target, copy,
    word_from, words, shard and place (the piece's place in its shard). Documents that the mix leaves out have no row.

    A piece that is a whole document has its text unchanged; others have their words and what stands after each. Places are
    given before texts are joined, so that each text is shuffled once, however often it is taken. Input columns that have the
    name of an added one give way to it.
    """
    told = ["source_size", "target", "copy", "word_from", "words", "shard", "place"]
    columns = [c for c in docs.columns if c not in told]
    docs = docs.select(columns)
    pieces = mix(docs, seed=seed, id_col=id_col, text_col=text_col, **options).where("words is not null")
    at = F.row_number().over(Window.partitionBy("shard").orderBy("shuffle", "row", "word_from"))
    pieces = pieces.withColumn("place", at.cast("long")).select(F.col("key").alias("_cardloom_key"), F.col("size").alias("_cardloom_size"), *told)
    # rows that repeat an id and a text have pieces of their own, but one text
    keyed = docs.withColumn("_cardloom_key", F.xxhash64(F.lit(seed), id_col, text_col))
    twin = F.row_number().over(Window.partitionBy("_cardloom_key").orderBy(id_col, *(c for c in columns if c not in (id_col, text_col))))
    texts = keyed.withColumn("_cardloom_twin", twin).where("_cardloom_twin = 1")
    parts = F.slice(F.regexp_extract_all(text_col, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), (F.col("word_from") + 1).cast("int"), F.col("words").cast("int"))
    text = F.when((F.col("word_from") == 0) & (F.col("words") == F.col("_cardloom_size")), F.col(text_col)).otherwise(F.array_join(parts, ""))
    return texts.join(pieces, "_cardloom_key").withColumn(text_col, text).select(*columns, *told)
