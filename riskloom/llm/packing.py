"""Packing by power-of-two decomposition.

The token count of a document is written in binary: as many whole contexts as fit, then one piece
per set bit. Every piece is a sequence of its own, so no sequence crosses documents or is padded,
and sequences of equal length lie in one bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import slices
from .common import lean, number_rows, texts

CONTEXT = 2048
END = 1
PART_BYTES = 1 << 19  # text of a batch whose words are looked up together; a longer text is a part of its own
CACHE_WORDS = 300_000  # words that a worker process knows before it forgets those it met least
CACHE_BYTES = 4 << 20  # and bytes of them


def pieces(n: int, context: int = CONTEXT) -> list[tuple[int, int]]:
    """``(start, length)`` of each piece of ``n`` tokens: whole contexts, then falling powers of two."""
    out, at = [], 0
    while n - at >= context:
        out.append((at, context))
        at += context
    bit = context >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


# Characters whose words can be cut: letters of ASCII and Latin-1, digits, ASCII symbols but the apostrophe.
_LETTERS, _SYMBOLS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_UNIT = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+")
_PROBE = "Äb12ÿ3,+é.Zß:x?! <a|b> 7% Þorn/Öl __init__(self) naïve-Coöp"
_SPACE, _LETTER, _DIGIT, _SYMBOL, _OTHER = range(5)
# The kind of each byte; the two of a letter of Latin-1 are 0xC3 and one from 0x80 to 0xBF.
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[0x21:0x7F] = _SYMBOL
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = _LETTER
_KINDS[0x27] = _OTHER


def units(data: np.ndarray, ends: np.ndarray, cuts: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Stretches between ASCII white space of texts that end at ``ends`` of ``data``, and how many each text has.

    With ``cuts``, those of nothing but letters of ASCII and Latin-1, digits and symbols are cut further:
    into runs of letters, single digits and runs of symbols. A stretch with an apostrophe, with ``<|`` or
    with any other character stays whole.
    """
    kind = _KINDS[data]
    dark = kind != _SPACE
    begins = ends[:-1][ends[:-1] < len(data)]
    first = dark.copy()  # where a stretch starts
    first[1:] &= ~dark[:-1]
    first[begins] = dark[begins]
    if cuts:
        before, here = data[:-1], data[1:]
        kind[1:][(before == 0xC3) & ((here == 0x97) | (here == 0xB7)) | (before == 0x3C) & (here == 0x7C)] = _OTHER
        starts = np.flatnonzero(first)
        others = np.append(np.int32(0), np.cumsum(kind == _OTHER, dtype=np.int32))
        whole = others[np.append(starts[1:], len(data))] > others[starts]
        change = np.flatnonzero(dark[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~first[1:]) + 1
        change = change[~whole[np.searchsorted(starts, change, side="right") - 1]] if len(starts) else change
        first[change] = True
    starts = np.flatnonzero(first)
    offsets = np.append(np.int32(0), np.cumsum(dark, dtype=np.int32))[np.append(starts, len(data))]
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[dark])])
    return found, np.diff(np.searchsorted(starts, ends))


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """The array with zeros behind, if it is shorter than ``size``."""
    if len(values) >= size:
        return values
    return np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)])


class WordEncoder:
    """Ids of texts from ids of their units, each encoded once.

    The tokenizer drops white space and lets no token reach across it, so the ids of a text are
    those of its stretches, one after another. It also ignores the case of ASCII words, except in its
    special tokens. Other words stand as they are: it composes accents before it lowers letters, and
    some are composed with the small letter only.

    In stretches that :func:`units` cuts, normalizing only lowers letters and the tokenizer cuts at the
    same places, so their units go to its model at once. Where a probe shows other rules, nothing is cut.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.spelling = str.maketrans({c: self._spelled(c) for c in map(chr, range(0x21, 0x100)) if _UNIT.fullmatch(c)})
        self.model = self.tokenizer.model
        direct = [i for unit in _UNIT.findall(_PROBE) for i in self._direct(unit)]
        self.cuts = direct == self.tokenizer.encode(_PROBE, add_special_tokens=False).ids
        self.known = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)  # lookups that held a word; those long past count less
        self.used = self.held = 0

    def _spelled(self, letter: str) -> str:
        """How the model is given a character."""
        if self.tokenizer.pre_tokenizer is None:
            return letter
        return "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letter))

    def _direct(self, unit: str) -> list[int]:
        return [token.id for token in self.model.tokenize(unit.lower().translate(self.spelling))]

    @classmethod
    def shared(cls, tokenizer_json: str) -> WordEncoder:
        """The encoder of this worker process: tasks that follow each other in it know its words."""
        import tokenizers

        known = tokenizers.__dict__.setdefault("_riskloom_encoders", {})
        if tokenizer_json not in known:
            known.clear()
            known[tokenizer_json] = cls(tokenizer_json)
        return known[tokenizer_json]

    def _forget(self) -> None:
        """Keep the words that were met most, as many as fill half of the cache."""
        words = np.array(list(self.known), object)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        keep = np.argsort(-self.met[: len(words)], kind="stable")[: CACHE_WORDS // 2]
        keep = np.sort(keep[np.cumsum(lengths[keep]) <= CACHE_BYTES // 2])
        sizes = np.diff(self.ends[: len(words) + 1])
        ends = np.append(0, np.cumsum(sizes[keep]))
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.ends[keep] - ends[:-1], sizes[keep])]
        self.ends, self.met = ends, self.met[keep] >> 1
        self.known = dict(zip(words[keep].tolist(), range(len(keep))))
        self.used, self.held = int(ends[-1]), int(lengths[keep].sum())

    def _learn(self, new: list[str]) -> None:
        """Encode new words: units by the model, others as one text, whose tokens tell their word by where they start."""
        units, others = [], new
        if self.cuts:
            units, others = [], []
            for word in new:
                (units if _UNIT.fullmatch(word) else others).append(word)
        ids, sizes = [], np.zeros(len(new), np.int64)
        for i, unit in enumerate(units):
            own = self._direct(unit)
            ids += own
            sizes[i] = len(own)
        if others:
            starts = np.cumsum([0, *[len(w) + 1 for w in others[:-1]]])
            encoding = self.tokenizer.encode(" ".join(others), add_special_tokens=False)
            places = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding.ids))
            sizes[len(units) :] = np.bincount(np.searchsorted(starts, places, side="right") - 1, minlength=len(others))
            ids += encoding.ids
        first, used = len(self.known), self.used + len(ids)
        self.ends, self.met = _room(self.ends, first + len(new) + 1), _room(self.met, first + len(new))
        self.flat = _room(self.flat, used)
        self.flat[self.used : used] = ids
        self.ends[first + 1 : first + 1 + len(new)] = self.used + np.cumsum(sizes)
        self.known.update(zip(units + others, range(first, first + len(new))))
        self.held += sum(map(len, new))
        self.used = used

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each word; words not met before are encoded together."""
        plain = pc.and_not(pc.string_is_ascii(words), pc.match_substring(words, "<|"))
        keys = pc.if_else(plain, pc.ascii_lower(words), words).to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._forget()
        fresh = set(keys).difference(self.known)
        if fresh:
            self._learn(sorted(fresh))
        numbers = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        self.met[numbers] += 1
        return numbers

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where those of each end; none are added."""
        raw = pc.cast(pc.fill_null(texts, ""), pa.binary())
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(raw).to_numpy())])
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        words, counts = units(data, ends, self.cuts)
        coded = words.dictionary_encode()
        at = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        starts = self.ends[at]
        sizes = self.ends[at + 1] - starts
        to = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(to[-1]) + np.repeat(starts - to[:-1], sizes)
        return self.flat[places], to[np.cumsum(counts)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without any added."""
        ids, ends = self.encode_all(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if len(ends) else []


def token_pieces(docs: DataFrame, tokenizer_path: str, context: int = CONTEXT, end: int = END) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens`` per piece; ``ids`` are little-endian unsigned 32-bit.

    A document's ids end with ``end``, so a null or empty text is one piece of that id alone.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("the context must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64)
            for low, high in slices(sizes + 16, PART_BYTES):
                part = batch.slice(low, high - low)
                rows = []
                found, ends = encoder.encode_all(part["text"])
                for doc_id, ids in zip(part["doc_id"].to_pylist(), np.split(found, ends[:-1])):
                    data = np.append(ids, np.uint32(end)).astype("<u4").tobytes()
                    n = len(ids) + 1
                    rows += [(doc_id, a, size, data[4 * a : 4 * (a + size)], n) for a, size in pieces(n, context)]
                doc_ids, starts, sizes, ids, totals = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return texts(docs).mapInArrow(lean(split), "doc_id long, start long, length long, ids binary, doc_tokens long")


def in_sequences(pieces: DataFrame) -> DataFrame:
    """Give every piece a sequence: ``sequence_id``, gapless from 0 and grouped by length, and ``offset`` 0.

    Sequences of one length have consecutive ids, longest first, which is what a bucketed sampler
    reads. Numbering spreads each bucket over many tasks.
    """
    numbered = number_rows(pieces, ["length"], "sequence_id")
    sizes = numbered.groupBy("length").count()  # one row per power of two
    longer = sizes.alias("a").join(sizes.alias("b"), F.col("b.length") > F.col("a.length"), "left")
    first = longer.groupBy(F.col("a.length").alias("length")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_first"))
    return (
        numbered.join(F.broadcast(first), "length")
        .withColumn("sequence_id", F.col("sequence_id") + F.col("_first"))
        .withColumn("offset", F.lit(0).cast("long"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer_path: str, context: int = CONTEXT, end: int = END) -> DataFrame:
    """Pieces with their ids, sequence and offset. Every row of ``docs`` is a document of its own,

    whatever its id; null and repeated ids are kept as they are, other columns are not read, and no
    rows give no pieces.
    """
    return in_sequences(token_pieces(docs, tokenizer_path, context, end))
