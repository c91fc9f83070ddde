"""Quality classifier: gradient-boosted trees over statistics of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import lean, small_batches, texts

TRAIN_ROWS = 12_000  # labelled rows, at most, that the driver fits on
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CLASS = np.zeros(256, np.uint8)  # of a byte: 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 other ASCII mark, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>@^~\\/{}[]_=+`"]] = 5
_CLASS[ord("!")] = 6
_CLASS[128:] = 7

FEATURES = (
    "log_words", "word_length", "word_length_spread", "longest_word", "lower", "upper", "digits", "marks", "symbols",
    "exclamations", "beyond_ascii", "words_with_symbol", "capital_starts", "all_capitals", "distinct_words", "top_word",
    "repeated_pairs", "repeated_lines", "line_words", "line_words_spread", "lines_with_mark", "byte_entropy", "sentence_words",
    "control",
)


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of ``FEATURES``; all zero for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(data, np.uint8)
    ink = raw[~_SPACE[raw]]
    kinds = np.bincount(_CLASS[ink], minlength=8) / len(ink)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    firsts = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    lasts = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    pairs = ids[:-1] * len(codes) + ids[1:]
    lines = [line for line in data.split(b"\n") if line.strip()]
    line_words = np.fromiter((line.count(b" ") + 1 for line in lines), np.int64, len(lines))
    line_ends = np.frombuffer(b"".join([line.rstrip()[-1:] for line in lines]), np.uint8)
    share = np.bincount(raw, minlength=256) / len(raw)
    share = share[share > 0]
    sentence_ends = int(np.isin(lasts, [46, 63, 33]).sum())
    upper = _CLASS[firsts] == 2
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
        *[float(kinds[k]) for k in (1, 2, 3, 4, 5, 6, 7)],
        float((_CLASS[lasts] == 5).mean()), float(upper.mean()), float(sum(map(bytes.isupper, words)) / n),
        len(codes) / n, float(counts.max() / n), float(1 - len(np.unique(pairs)) / max(1, n - 1)),
        1 - len(set(lines)) / len(lines), float(np.log1p(line_words.mean())), float(line_words.std() / line_words.mean()),
        float(np.isin(line_ends, [46, 63, 33]).mean()), float(-(share * np.log2(share)).sum()),
        float(np.log1p(n / (sentence_ends + 1))), float(((ink < 32) | (ink == 127)).mean()),
    ]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = [statistics(t) for t in batch["text"].to_pylist()]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def with_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``more`` and ``features`` of each row of ``docs``."""
    rows = texts(docs, *more)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = pa.array(list(_matrix(batch)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[batch[c] for c in more], features], names=["doc_id", *more, "features"]
            )

    schema = ", ".join(["doc_id long", *[f"{c} {kinds[c]}" for c in more], "features array<double>"])
    return rows.mapInArrow(compute, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents: those whose ids hash lowest, so the same in every run.

    Rows with a null id or label teach nothing. ``rows`` bounds the side that is broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_label")).dropna()
    known = known.groupBy("_id").agg(F.avg("_label").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Fit on a bounded sample of labelled rows; without any, every score is the neutral half."""
    found = with_statistics(labelled_sample(docs, labels, "quality", rows), "label")
    # A repeated id may bring more rows than were chosen; the bound holds all the same.
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(rows).select("label", "features").toPandas()
    x = np.array(sample["features"].tolist(), float).reshape(len(sample), len(FEATURES))
    return fit(x, (sample["label"].to_numpy(float) >= 0.5).astype(float))


def quality_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score`` per row: 0 to 1, higher where label 1 is likelier.

    A null or empty text is scored by its statistics, all zero. Scores follow from the text alone:
    equal texts get equal scores whatever their ids and other columns, which are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.probability(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(score, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Trees, least: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose score reaches ``least``.

    All rows if the model holds no trees: without labels of both kinds there was nothing to learn,
    and every score is the same, so it tells no document from another.
    """
    if not len(model.roots):
        return docs
    small_batches(docs.sparkSession)
    names = docs.columns

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            scores = model.probability(_matrix(pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])))
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(scores >= least))

    return docs.mapInArrow(lean(select), docs.schema)
