"""Toxicity by a classifier chain of linear models (operator 4).

Categories are predicted one after another. Each is a logistic model over the words of a text and their beginnings, and over
the probabilities of the categories before it. A later model is trained with out-of-fold probabilities of the earlier ones:
those of models that haven't seen the text, as it will be with new texts.

Training takes a bounded sample of the labelled rows (``sample``, by a hash of their ids) and of the words. Only words that
differ between the classes become features, chosen within each fold's own training part. Scoring reads every document
whole, once, with the model's few weights in the task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import in_slices

#: Labelled documents that are fitted at most, of each class of the last category, and code points of their texts.
SAMPLE, SAMPLE_CHARS = 3_000, 40_000_000
FOLDS, FEATURES, PREFIXES = 5, 400, (3, 4, 5)
_WORDS = re.compile(r"\w+")


def word_counts(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def features_of(counts: Counter) -> dict[str, int]:
    """Words and, for longer words, their beginnings, with how often they occur."""
    out: dict[str, int] = {}
    for word, n in counts.items():
        out["=" + word] = n
        for k in PREFIXES:
            if len(word) > k:
                start = "^" + word[:k]
                out[start] = out.get(start, 0) + n
    return out


def style_of(text: str | None, counts: Counter) -> list[float]:
    """What a text looks like whatever its words: shares of symbols, capitals, digits and repeats, and its length."""
    text = text or ""
    n, words = max(1, len(text)), max(1, counts.total())
    letters = sum(len(w) * k for w, k in counts.items())
    return [
        (n - letters - text.count(" ")) / n,
        sum(map(str.isupper, text)) / n,
        sum(map(str.isdigit, text)) / n,
        len(counts) / words,
        max(counts.values(), default=0) / words,
        letters / words,
        float(np.log1p(words)),
        float(np.log1p(words) ** 2),
    ]


STYLES = len(style_of(None, Counter()))


class Encoded:
    """Texts as arrays of feature numbers and counts, which take a small part of what dictionaries of names take."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, features: dict[str, int]) -> None:
        give = self.number.setdefault
        ids = np.fromiter((give(name, len(self.number)) for name in features), dtype=np.int32, count=len(features))
        self.rows.append((ids, np.fromiter(features.values(), dtype=np.float32, count=len(features))))

    def take(self, places: np.ndarray) -> Encoded:
        out = Encoded()
        out.number, out.rows = self.number, [self.rows[i] for i in places]
        return out

    def presence(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen texts each feature is."""
        out = np.zeros(len(self.number), dtype=np.int64)
        for i in np.flatnonzero(chosen):
            out[self.rows[i][0]] += 1
        return out

    def matrix(self, names: Sequence[str]) -> np.ndarray:
        """log(1 + count) of the named features."""
        column = np.full(len(self.number) + 1, -1)
        column[[self.number[n] for n in names]] = np.arange(len(names))
        out = np.zeros((len(self.rows), len(names)))
        for i, (ids, counts) in enumerate(self.rows):
            at = column[ids]
            out[i, at[at >= 0]] = np.log1p(counts[at >= 0])
        return out


class Linear:
    """A logistic model over chosen words and given extra columns."""

    def __init__(self, texts: Encoded, extra: np.ndarray, labels: np.ndarray, l2: float = 0.002, steps: int = 300):
        self.names = self._choose(texts, labels)
        self.place = {name: i for i, name in enumerate(self.names)}
        x = np.concatenate([texts.matrix(self.names), extra], axis=1)
        self.mean, self.scale = x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), np.ones(x.shape[1])
        if len(x):
            self.scale = np.maximum(x.std(axis=0), 1e-3)
        z = (x - self.mean) / self.scale
        share = labels.mean() if len(labels) else 0.0
        self.weights, self.bias = np.zeros(x.shape[1]), float(np.log((share + 1e-4) / (1 - share + 1e-4)))
        if not 0 < share < 1:
            return
        balance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) / len(labels)
        bias, moved, momentum = 0.0, np.zeros_like(self.weights), 0.9
        moved_bias, rate = 0.0, 4.0 / max(1.0, (z**2).sum(axis=1).mean()) * 4
        for _ in range(steps):
            error = (1 / (1 + np.exp(-np.clip(z @ self.weights + bias, -30, 30))) - labels) * balance
            moved = momentum * moved - rate * (z.T @ error + l2 * self.weights)
            moved_bias = momentum * moved_bias - rate * error.sum()
            self.weights, bias = self.weights + moved, bias + moved_bias
        self.bias = bias

    @staticmethod
    def _choose(texts: Encoded, labels: np.ndarray) -> list[str]:
        """Features whose presence differs most between the classes, by a z-score; ties by name."""
        a, b = texts.presence(labels > 0), texts.presence(labels <= 0)
        n = [max(1, int((labels == k).sum())) for k in (0, 1)]
        p = (a + b) / (n[0] + n[1])
        score = (a / n[1] - b / n[0]) / np.sqrt(np.maximum(p * (1 - p) * (1 / n[0] + 1 / n[1]), 1e-12))
        names = list(texts.number)
        return [name for _, name in sorted((-score[i], names[i]) for i in np.flatnonzero((a >= 3) & (score > 3.5)))[:FEATURES]]

    def matrix(self, texts: Sequence[dict[str, int]]) -> np.ndarray:
        """Presence and rate: log(1 + n) for each feature."""
        out = np.zeros((len(texts), len(self.names)))
        for i, features in enumerate(texts):
            small, large = (features, self.place) if len(features) < len(self.place) else (self.place, features)
            for name in small:
                if name in large:
                    out[i, self.place[name]] = np.log1p(features[name])
        return out

    def predict(self, texts: Encoded | Sequence[dict[str, int]], extra: np.ndarray) -> np.ndarray:
        own = texts.matrix(self.names) if isinstance(texts, Encoded) else self.matrix(texts)
        z = (np.concatenate([own, extra], axis=1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights + self.bias, -30, 30)))


class Chain:
    """Models of the categories in their order. Those in ``styled`` also see the texts' style."""

    def __init__(self, categories: Sequence[str], texts: Encoded, styles: np.ndarray, labels: np.ndarray, styled: Sequence[str] = ("low_quality",), folds: int = FOLDS):
        self.categories, self.styled, self.models = list(categories), set(styled), []
        fold = np.arange(len(labels)) % folds
        earlier = np.zeros((len(labels), 0))
        for k, category in enumerate(self.categories):
            y = labels[:, k]
            seen = self._seen(category, earlier, styles)
            self.models.append(Linear(texts, seen, y))
            if k + 1 < len(self.categories):
                held_out = np.zeros(len(labels))
                for f in range(folds):
                    train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                    model = Linear(texts.take(train), seen[train], y[train])
                    held_out[test] = model.predict(texts.take(test), seen[test])
                earlier = np.concatenate([earlier, held_out[:, None]], axis=1)
        wanted = {name for model in self.models for name in model.names}
        self._whole, self._starts = {n[1:] for n in wanted if n[0] == "="}, {n[1:] for n in wanted if n[0] == "^"}

    def _seen(self, category: str, earlier: np.ndarray, styles: np.ndarray) -> np.ndarray:
        return np.concatenate([earlier, styles], axis=1) if category in self.styled else earlier

    def predict(self, texts: Sequence[dict[str, int]], styles: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), 0))
        for category, model in zip(self.categories, self.models, strict=True):
            out = np.concatenate([out, model.predict(texts, self._seen(category, out, styles))[:, None]], axis=1)
        return out

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probabilities of raw texts; only the models' own features are made of them."""
        whole, starts, sizes = self._whole, self._starts, PREFIXES
        rows, styles = [], []
        for text in texts:
            counts, found = word_counts(text), {}
            for word, n in counts.items():
                if word in whole:
                    found["=" + word] = n
                for k in sizes:
                    if len(word) > k and word[:k] in starts:
                        start = "^" + word[:k]
                        found[start] = found.get(start, 0) + n
            rows.append(found)
            styles.append(style_of(text, counts))
        return self.predict(rows, np.array(styles).reshape(len(rows), STYLES))


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Chain:
    """A chain fitted on at most ``sample`` labelled documents of each class of the last category.

    ``labels`` has doc_id and a 0/1 column for each category; rows with a null among them aren't used, and of repeated labels
    of a document each category's greatest holds. Which documents are
    fitted follows from a hash of their ids and texts alone. Their word counts come to the driver; the sample bounds them.
    Each class has half of ``sample_chars``: a text beyond what is left of it is passed over, shorter ones after it are taken,
    and a class's first text is taken whatever its length, so one long text leaves no class empty.
    """
    whole = labels.select("doc_id", *(F.col(c).cast("int").alias(f"_{i}") for i, c in enumerate(categories))).dropna()
    known = whole.groupBy("doc_id").agg(*(F.max(f"_{i}").alias(f"_{i}") for i in range(len(categories))))
    last = f"_{len(categories) - 1}"
    part = known.where(f"{last} in (0, 1)").select("*", F.xxhash64("doc_id", F.lit(11)).alias("_at"))
    chosen = part.where(f"{last} = 1").orderBy("_at", "doc_id").limit(sample).unionByName(part.where(f"{last} = 0").orderBy("_at", "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").select("*", F.xxhash64("text").alias("_text"))
    features, styles, known, held = Encoded(), [], [], [0, 0]
    for row in texts.orderBy("_at", "doc_id", "_text").toLocalIterator():
        if held[row[last]] and held[row[last]] + len(row.text) > sample_chars // 2:
            continue
        held[row[last]] += len(row.text)
        counts = word_counts(row.text)
        features.add(features_of(counts))
        styles.append(style_of(row.text, counts))
        known.append([row[f"_{i}"] for i in range(len(categories))])
    return Chain(categories, features, np.array(styles, dtype=float).reshape(len(known), STYLES), np.array(known, dtype=float).reshape(len(known), len(categories)))


def classify(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, p_<category> for each category, and toxic (the last one's at least ``threshold``).

    Null and empty texts are scored as texts without words, and are never toxic. Null ids and repeated rows keep their rows;
    other columns aren't read. Texts of any length are scored whole. With no label of one class, a category's probability is its share among the labels.
    """
    schema = T.StructType([*docs.select(F.col(id_col).alias("doc_id")).schema.fields, *(T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories), T.StructField("toxic", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            p, toxic = _toxic(chain, batch.column(1).to_pylist(), threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(toxic)], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that ``classify`` doesn't call toxic."""
    at, verdict = docs.columns.index(text_col), "_cardloom_toxic"
    schema = T.StructType([*docs.schema.fields, T.StructField(verdict, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_toxic(chain, batch.column(at).to_pylist(), threshold)[1])], names=schema.names)

    return docs.mapInArrow(run, schema).where(~F.col(verdict)).select(docs.columns)


def _toxic(chain: Chain, texts: list[str | None], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    p = chain.score(texts)
    some = np.array([bool(t and _WORDS.search(t)) for t in texts], dtype=bool)
    return p, (p[:, -1] >= threshold) & some


#: Categories of the labels table, in the chain's order: low quality (its quality turned round), then toxicity.
CATEGORIES = ("low_quality", "toxic")


def label_columns(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
