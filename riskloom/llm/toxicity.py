"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over the words of a document; each
model also reads the probabilities of the categories before it. While training, those come from
models that have not seen the document (out of fold), so later models learn from probabilities
as uncertain as they will meet. The categories before the label are kinds of toxic documents that
clusters of their words make out; no word list is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, texts
from .quality_model import labelled_sample

TRAIN_ROWS = 8_000  # labelled documents, at most, that the driver fits on
VOCABULARY = 300  # words and word starts, at most, that the models read
START = 5  # bytes of a word start
FOLDS = 5
KINDS = 3  # clusters of toxic documents, which are the categories before the label
LEAST = 4  # toxic documents that hold a word before it can be chosen
LEAST_SCORE = 6.0  # chi-square that a chosen word exceeds

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct words, runs of ASCII letters and digits in lower case and of everything beyond ASCII,

    and the starts of longer words, marked by a star.
    """
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())
    return words | {word[:START] + b"*" for word in words if len(word) > START}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 8.0 if len(y) and y[0] > 0.5 else -8.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


@dataclass
class Chain:
    """Weights per category, in order; ``vocabulary`` gives the place of a word, ``threshold`` decides.

    ``held_out`` has, per category, its documents in the sample and precision and recall of the
    probabilities out of fold at one half.
    """

    categories: tuple[str, ...]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]
    threshold: float
    held_out: dict[str, tuple[int, float, float]]

    def features(self, texts: list[str | None]) -> np.ndarray:
        return _features(self.vocabulary, texts)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column per category; each model reads the columns before its own."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.hstack([out, _linear(np.hstack([x, out]), w)[:, None]])
        return out


def _features(vocabulary: dict[bytes, int], texts: list[str | None]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)))
    known = vocabulary.keys()
    for row, text in zip(x, texts):
        for word in known & words_of(text):
            row[vocabulary[word]] = 1
    return x


def _fold(text: str | None, folds: int = FOLDS) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) % folds


def kinds_of(x: np.ndarray, y: np.ndarray, n: int = KINDS, rounds: int = 30) -> np.ndarray:
    """A 0/1 column per kind: clusters of the toxic rows by the angle between their words, rare ones weighing more.

    Centres start at the row nearest to the mean and then at rows farthest from all centres, so the same rows
    give the same kinds; the largest comes first. Rows without a word, or fewer rows than kinds, are in none.
    """
    out = np.zeros((len(x), n))
    rows = np.flatnonzero((y > 0.5) & x.any(axis=1)) if x.size else np.array([], int)
    if len(rows) < n:
        return out
    z = x[rows] * (np.log((len(rows) + 1) / (x[rows].sum(axis=0) + 1)) + 0.1)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    centres = z[[int(np.argmax(z @ z.mean(axis=0)))]]
    while len(centres) < n:
        centres = np.vstack([centres, z[int(np.argmin((z @ centres.T).max(axis=1)))]])
    own = np.zeros(len(rows), int)
    for _ in range(rounds):
        own = np.argmax(z @ centres.T, axis=1)
        sums = np.array([z[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(n)])
        fresh = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        if np.allclose(fresh, centres):
            break
        centres = fresh
    order = np.argsort(-np.bincount(own, minlength=n), kind="stable")
    for column, k in enumerate(order):
        out[rows[own == k], column] = 1
    return out


def fit_features(words: list[bytes], x: np.ndarray, y: np.ndarray, fold: np.ndarray, label: str = "toxic") -> Chain:
    """Fit the chain of the kinds and, last, the label, on 0/1 features of the chosen words."""
    kinds = kinds_of(x, y)
    categories = (*(f"kind_{k + 1}" for k in range(KINDS)), label)
    chain = Chain(categories, {w: i for i, w in enumerate(words)}, [], 0.5, {})
    before = np.zeros((len(x), 0))
    out_of_fold = np.zeros(len(x))
    for category, target in zip(categories, [*kinds.T, y.astype(float)]):
        here = np.hstack([x, before])
        out_of_fold = np.zeros(len(x))
        for k in set(fold.tolist()):
            held = fold == k
            out_of_fold[held] = _linear(here[held], _fit_linear(here[~held], target[~held]))
        chain.weights.append(_fit_linear(here, target))
        before = np.hstack([before, out_of_fold[:, None]])
        called, true = out_of_fold >= 0.5, target > 0.5
        hits = int((called & true).sum())
        chain.held_out[category] = (int(true.sum()), hits / max(1, int(called.sum())), hits / max(1, int(true.sum())))
    if len(y) and 0 < y.sum() < len(y):  # the least threshold of best F1 on probabilities out of fold
        grid = np.linspace(0.2, 0.9, 29)
        hits = [(((out_of_fold >= t) & (y > 0)).sum(), (out_of_fold >= t).sum()) for t in grid]
        f1 = [2 * a / (b + y.sum()) for a, b in hits]
        chain.threshold = float(grid[int(np.argmax(f1))])
    return chain


def _count_words(texts: list[str | None], y: list[float]) -> dict[bytes, list[int]]:
    """In how many texts with and without the label each word stands."""
    counts: dict[bytes, list[int]] = {}
    for text, label in zip(texts, y):
        for word in words_of(text):
            counts.setdefault(word, [0, 0])[int(label < 0.5)] += 1
    return counts


def fit_chain(texts: list[str | None], y: np.ndarray, limit: int = VOCABULARY) -> Chain:
    """Fit on texts in memory, by the same choice of words as :func:`train`."""
    n, pos = len(y), float(np.sum(y > 0.5))
    scored = []
    for word, (k, without) in _count_words(texts, list(y)).items():
        expected = (k + without) * pos / max(n, 1)
        score = (k - expected) ** 2 / max(expected * (1 - (k + without) / n), 1e-9)
        if k >= LEAST and k > expected and score > LEAST_SCORE:
            scored.append((-score, word))
    words = [w for _, w in sorted(scored)[:limit]]
    return fit_features(words, _features({w: i for i, w in enumerate(words)}, texts), y, np.array([_fold(t) for t in texts], int))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    """Fit on a bounded sample of labelled documents; without labels nothing is called toxic.

    Words are counted and features computed in tasks; the driver receives the chosen words and a bit per
    word and document, never texts. Of rows that repeat an id one teaches, that of the least hash of its text.
    """
    found = labelled_sample(docs, labels, "toxic", rows)
    one = F.min_by(F.struct((F.col("label") >= 0.5).cast("double").alias("y"), "text"), F.struct(F.xxhash64("text"), "text"))
    sample = materialize(found.groupBy("doc_id").agg(one.alias("row")).select("doc_id", "row.*"), "labelled")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _count_words(batch["text"].to_pylist(), batch["y"].to_pylist())
            columns = [pa.array(list(counts), pa.binary()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "k", "without"])

    counts = sample.mapInArrow(count, "word binary, k long, without long").groupBy("word").agg(F.sum("k").alias("k"), F.sum("without").alias("without"))
    total, size = F.col("k") + F.col("without"), F.lit(max(n, 1))
    expected = total * F.lit(pos) / size
    score = F.pow(F.col("k") - expected, 2) / F.greatest(expected * (1 - total / size), F.lit(1e-9))
    telling = counts.filter(F.col("k") >= LEAST).filter((F.col("k") > expected) & (score > LEAST_SCORE))
    words = [bytes(r["word"]) for r in telling.orderBy(score.desc(), "word").limit(VOCABULARY).select("word").collect()]
    vocabulary = {w: i for i, w in enumerate(words)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            bits = [row.tobytes() for row in np.packbits(_features(vocabulary, texts).astype(bool), axis=1)]
            columns = [batch["doc_id"], batch["y"], pa.array([_fold(t) for t in texts], pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "y", "fold", "bits"])

    held = sample.mapInArrow(features, "doc_id long, y double, fold long, bits binary").orderBy("doc_id").collect()
    release(sample)
    packed = np.frombuffer(b"".join(bytes(r["bits"]) for r in held), np.uint8).reshape(len(held), -1 if held and words else 0)
    x = np.unpackbits(packed, axis=1, count=len(words)).astype(float)
    return fit_features(words, x, np.array([r["y"] for r in held], float), np.array([r["fold"] for r in held], int))


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row ``doc_id``, a probability per category, and ``flagged``: the label's reaches the threshold.

    A null or empty text has no words and is scored so. Equal texts score equally; ids may be null
    or repeat; other columns are not read.
    """
    names = list(chain.categories)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                p = chain.probabilities(chain.features(part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *[pa.array(p[:, i]) for i in range(len(names))], pa.array(p[:, -1] >= chain.threshold)],
                    names=["doc_id", *names, "flagged"],
                )

    return texts(docs).mapInArrow(score, ", ".join(["doc_id long", *[f"{c} double" for c in names], "flagged boolean"]))
