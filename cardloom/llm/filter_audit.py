"""How filters of documents interact in every order of application (operator 11).

Each document gets a mask of the filters that it fails. Filters of its own text are judged where it is read. Whether an
equal text has a smaller id takes a fingerprint-routed RDD: texts go to the partition of their XXH64, which keeps chains of
the full texts that share a fingerprint, with the least id of each, and emits the ids that aren't least. A map-side pass
does the same to each input partition, so of a text with very many copies one row per partition travels, and its other
copies are settled where they are read. Masks are counted into one vector per part, which ``combineByKey`` merges; all
orders of all parts follow from the vectors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cardloom.llm.common import WORD_RE, partitions_for, text_bytes

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def few_words(text: str, words: list[str]) -> bool:
    return len(words) < 200


def repetitive(text: str, words: list[str]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouting(text: str, words: list[str]) -> bool:
    raw = text.encode()
    return 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 3 * len(text)


def symbols(text: str, words: list[str]) -> bool:
    return any(c in text for c in "#$%&*|")


#: Filters of a text by their letters; the last letter is the filter of copies.
FILTERS: dict[str, Callable[[str, list[str]], bool]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}
COPIES = "E"
#: Characters of texts that a map-side pass holds before it passes its chains on, and that a partition's chains get.
HELD_CHARS = 16_000_000
PARTITION_BYTES = 32_000_000


class _Chains:
    """Chains of the texts of each fingerprint with their least ids. ``add`` gives the rows that it settles."""

    def __init__(self, copy_bit: int):
        self.copy_bit, self.chains, self.held = copy_bit, {}, 0

    def add(self, name: int, text: str, doc_id: int, mask: int, parts: Counter) -> Iterator[tuple]:
        chain = self.chains.setdefault(name, [])
        for link in chain:
            if link[0] == text:
                if doc_id == link[1]:
                    link[3].update(parts)
                    return
                if doc_id < link[1]:
                    doc_id, link[1] = link[1], doc_id
                    parts, link[3] = link[3], parts
                yield from ((doc_id, part, mask | self.copy_bit, n) for part, n in parts.items())
                return
        chain.append([text, doc_id, mask, parts])
        self.held += len(text)

    def empty(self) -> Iterator[tuple]:
        """All that the chains hold: (name, text, least id, mask, parts)."""
        for name, chain in self.chains.items():
            yield from ((name, *link) for link in chain)
        self.chains, self.held = {}, 0


def _spread(row: tuple) -> tuple:
    """A settled row with a key that spreads rows evenly, whatever their texts."""
    return xxh64_intdigest(repr(row[:2])), row


def _shorten(rows: Iterator[tuple], filters: dict) -> Iterator[tuple]:
    """Map side: settled rows, and of each text one row with its least id so far."""
    chains = _Chains(1 << len(filters))
    pack = lambda: ((name, (text, doc_id, mask, dict(parts))) for name, text, doc_id, mask, parts in chains.empty())
    for doc_id, text, part in rows:
        text, part = text or "", part or ""
        words = WORD_RE.findall(text)
        mask = sum(1 << i for i, fails in enumerate(filters.values()) if fails(text, words))
        if doc_id is None:  # neither smaller nor greater than any id
            yield _spread((None, part, mask, 1))
            continue
        yield from map(_spread, chains.add(xxh64_intdigest(text), text, doc_id, mask, Counter({part: 1})))
        if chains.held > HELD_CHARS:
            yield from pack()
    yield from pack()


def _settle(rows: Iterator[tuple], copy_bit: int) -> Iterator[tuple]:
    """Reduce side: (doc_id, part, mask, n) of all rows."""
    chains = _Chains(copy_bit)
    for name, row in rows:
        if isinstance(row[0], str):
            text, doc_id, mask, parts = row
            yield from chains.add(name, text, doc_id, mask, Counter(parts))
        else:
            yield row
    for _, _, doc_id, mask, parts in chains.empty():
        yield from ((doc_id, part, mask, n) for part, n in parts.items())


def failure_masks(docs: DataFrame, filters: dict[str, Callable] = FILTERS, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): bit i of ``mask`` is set if the document fails the i-th filter, the last bit if a smaller id
    has the same text. Repeated rows are counted in ``n``."""
    spark = docs.sparkSession
    n = partitions_for(spark, text_bytes(docs), PARTITION_BYTES)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col(part).cast("string")).rdd
    routed = rows.mapPartitions(partial(_shorten, filters=filters)).partitionBy(n, lambda name: name)
    return spark.createDataFrame(routed.mapPartitions(partial(_settle, copy_bit=1 << len(filters))), "doc_id long, part string, mask int, n long", verifySchema=False)


def _report(part: str, vector: list[int], letters: str) -> Iterator[tuple]:
    """All orders' steps from the counts (rows, good, toxic) of each mask."""
    n_masks = 1 << len(letters)
    rows, good, toxic = (vector[i * n_masks : (i + 1) * n_masks] for i in range(3))
    bits = {c: 1 << i for i, c in enumerate(letters)}
    total, steps, share = sum(rows), [], Counter()
    for order in permutations(letters):
        before, kept = 0, total
        for step, c in enumerate(order, 1):
            fails = [m for m in range(n_masks) if m & bits[c]]
            here = [m for m in fails if not m & before]
            removed = sum(rows[m] for m in here)
            kept -= removed
            share[c] += removed
            steps.append(("".join(order), step, c, kept, removed, sum(rows[m] for m in fails) - removed, rows[bits[c]], sum(good[m] for m in here), sum(toxic[m] for m in here)))
            before |= bits[c]
    assert sum(share.values()) == factorial(len(letters)) * (total - rows[0])
    for order, step, c, *counts in steps:
        yield (part, order, step, *counts, share[c])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable] = FILTERS, part: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: what the step's filter removes, and what that costs.

    A null or empty part is one part, a null text an empty one. A document is good (toxic) if any of its labels has
    quality = 1 (toxic = 1), so repeated labels don't count it twice. Rows that repeat an id and a text are counted each,
    and none of them is a copy of the other, as no id is smaller; a row without an id is no copy of any and none of it.
    Other columns aren't read; without documents there are no parts and no rows.
    """
    letters = "".join(filters) + COPIES
    spark, n_masks = docs.sparkSession, 1 << len(letters)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    masks = failure_masks(docs, filters, part).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    judged = masks.join(known.where("good or toxic"), "doc_id", "left").select("part", "mask", "n", "good", "toxic")

    def add(vector: list[int], row: tuple) -> list[int]:
        mask, n, *found = row
        vector[mask] += n
        for i, yes in enumerate(found, 1):
            vector[i * n_masks + mask] += n * bool(yes)
        return vector

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b, strict=True)]

    counts = judged.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add([0] * (3 * n_masks), row), add, merge)
    report = counts.flatMap(lambda x: _report(*x, letters))
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return spark.createDataFrame(report, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in columns)}", verifySchema=False)
