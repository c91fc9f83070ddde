"""Benchmark decontamination by pigeonhole edit matching.

A test item that stands in a text with at most ``k`` word edits leaves at least one of its ``k + 1``
pieces whole. Piece hits are found by hashed word windows, and every hit is settled by Myers'
bit-parallel distance over words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, texts
from .hashing import WordHashes, windows

ERROR_RATE = 0.2  # word edits per item word
MIN_WORDS = 5  # items of fewer words are searched without edits
BLOCK_WORDS = 2_000_000  # words of test items that one pass holds in each task

_SEPARATORS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BLANK = re.compile(r"(?:[^\S\x00-\x7F]|[\u200B\u2060\uFEFF])+")
# Scripts that put no spaces between words: Thai to Myanmar, Khmer, Tai, kana and Chinese characters.
_ALONE = re.compile(
    r"[\u0E00-\u109F\u1780-\u17FF\u1950-\u19DF\u1A20-\u1AAF\uA9E0-\uA9FF\uAA60-\uAADF"
    r"\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\uFF66-\uFF9F\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]"
)


def item_words(text: str | None) -> list[bytes]:
    """Words as runs of ASCII letters and digits, in lower case, and of everything beyond ASCII but white space.

    A character of a script without spaces is a word of its own.
    """
    text = text or ""
    if not text.isascii():
        text = _ALONE.sub(r" \g<0> ", _BLANK.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()


def pieces(n_words: int, edits: int) -> list[tuple[int, int]]:
    """``(start, length)`` of ``edits + 1`` pieces that cover an item and differ by a word at most."""
    cuts = [n_words * i // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def best_match(item: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any stretch of ``text`` and the first end where it is reached."""
    m = len(item)
    at: dict[bytes, int] = defaultdict(int)
    for i, word in enumerate(item):
        at[word] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best = (m, 0)
    for j, word in enumerate(text):
        eq = at.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            distance += 1
        elif mh & top:
            distance -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if distance < best[0]:
            best = (distance, j + 1)
    return best


class _Pieces:
    """Piece hashes of a block of items, by length, with a bitmap in front."""

    def __init__(self, items: list[tuple[int, list[bytes]]], error_rate: float, min_words: int):
        self.items = items
        self.edits = [int(error_rate * len(words)) if len(words) >= min_words else 0 for _, words in items]
        hashes = WordHashes()
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, words) in enumerate(items):
            row = hashes.of(words)
            for start, length in pieces(len(words), self.edits[number]):
                self.at[length][int(windows(row[start : start + length], length)[0])].append((number, start))
        self.maps = {}
        for length, keys in self.at.items():
            self.maps[length] = np.zeros(1 << 20, bool)
            self.maps[length][np.fromiter(keys, np.uint64, len(keys)) & np.uint64(0xFFFFF)] = True

    def search(self, words: list[bytes], row: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item, first word, word after the last, distance)`` of each item's best match in a text."""
        starts = defaultdict(set)
        for length, keys in self.at.items():
            seen = windows(row, length)
            for place in np.flatnonzero(self.maps[length][seen & np.uint64(0xFFFFF)]):
                for number, offset in keys.get(int(seen[place]), ()):
                    starts[number].add(int(place) - offset)
        found = []
        for number, diagonals in starts.items():
            item, edits = self.items[number][1], self.edits[number]
            stretches: list[list[int]] = []
            for d in sorted(diagonals):  # starts whose surroundings overlap share one stretch of text
                low, high = max(0, d - edits), min(len(words), d + len(item) + edits)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = max(high, stretches[-1][1])
                else:
                    stretches.append([low, high])
            best = None
            for low, high in stretches:
                distance, end = best_match(item, words[low:high])
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, low, low + end)
            if best:
                distance, low, end = best
                # Read backwards from its end, the match starts where it is as good first.
                length = best_match(item[::-1], words[max(low, end - len(item) - edits) : end][::-1])[1]
                found.append((number, end - length, end, distance))
        return found


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Test items in blocks of bounded size, so that neither the driver nor a task holds all of a large set."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2), F.lit(0))).first()[0]
    n = int(size // block_words) + 1
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r["item_id"], item_words(r["text"])) for r in block.distinct().collect()]
        rows = [r for r in rows if r[1]]
        if rows:
            yield sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents that hold a test item with at most ``error_rate`` word edits per item word.

    One row per document row and item: ``doc_id, item_id, first_word, end_word, distance``, the best
    match by distance, then place. Case and punctuation don't count. Items of fewer than ``min_words``
    words must stand in the text without edits. Null or empty texts hold nothing; null items and
    those without words find nothing; equal items are searched under each id.
    Repeated rows are searched each; other columns are not read. No items give no rows.
    """
    schema = "doc_id long, item_id long, first_word long, end_word long, distance long"
    rows = texts(docs)

    def searcher(items):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, hashes = _Pieces(items, error_rate, min_words), WordHashes()
            for batch in batches:
                out = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    words = item_words(text)
                    out += [(doc_id, items[k][0], a, b, d) for k, a, b, d in index.search(words, hashes.of(words))]
                columns = list(zip(*out)) or [()] * 5
                names = ["doc_id", "item_id", "first_word", "end_word", "distance"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        return search

    found = [rows.mapInArrow(searcher(items), schema) for items in _blocks(benchmark, block_words)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, drop_words: int = 1) -> DataFrame:
    """The rows, with all their columns, whose text holds no test item of ``drop_words`` words or more.

    Shorter items are found by :func:`contaminated` and drop nothing, as one word is no contamination.
    Null and empty texts hold nothing and stay, repeated rows and ids are judged row by row, an empty
    benchmark drops nothing, and columns of any name pass through.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    out = docs
    for block in _blocks(benchmark, BLOCK_WORDS):
        items = [item for item in block if len(item[1]) >= drop_words]
        if not items:
            continue

        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index, hashes = _Pieces(items, error_rate, MIN_WORDS), WordHashes()
            for batch in batches:
                clean = []
                for text in batch.column(names.index("text")).to_pylist():
                    words = item_words(text)
                    clean.append(not index.search(words, hashes.of(words)))
                yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(lean(keep), docs.schema)
    return out
