"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; a cut stands where the hash of the last 16 bytes falls
below a limit, or at the least hash where none does for long. From every cut a chunk reaches to the first cut that makes it long enough, so chunks
overlap, depend on nothing but their own bytes, and an insertion changes only those that hold it.
Chunks are compared by digest; overlapping repeated chunks join to the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_into, dealt, materialize, repeated, small_batches, texts
from .hashing import mix

CUT_BYTES = 24  # mean distance of cuts
GAP_BYTES = 128  # a stretch without a cut for longer is cut at its least hashes
CHUNK_BYTES = 64  # least length of a chunk
RUN_WORDS = 16  # words that a repeated passage holds at least, as far as its chunks reach
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte.

    The 16-bit gear hash shifts by one bit per byte, so it holds 16 bytes; it is built by doubling.
    """
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def _low(h: np.ndarray, cut_bytes: int) -> np.ndarray:
    found = np.flatnonzero(h < 65536 // cut_bytes) + 1
    return found[found >= 16]


def cuts(data: np.ndarray, cut_bytes: int = CUT_BYTES) -> np.ndarray:
    """Places of the cuts in a byte array, by the hash limit alone."""
    return _low(_hashes(data), cut_bytes)


def all_cuts(data: np.ndarray, cut_bytes: int = CUT_BYTES, gap_bytes: int = GAP_BYTES) -> np.ndarray:
    """Cuts by the limit, and in gaps longer than ``gap_bytes`` the last least hash of each stretch.

    A stretch begins at the cut before it, so in periodic text, which may hold no low hash at all,
    every cut stands at the same byte of the period, wherever the text begins.
    """
    h = _hashes(data)
    found = _low(h, cut_bytes)
    edges = np.concatenate([[15], found, [max(15, len(data))]])
    more = []
    for gap in np.flatnonzero(np.diff(edges) > gap_bytes).tolist():
        at, end = int(edges[gap]), int(edges[gap + 1])
        while end - at > gap_bytes:
            stretch = h[at : at + gap_bytes]  # its hashes make the cuts at + 1 to at + gap_bytes
            at += gap_bytes - int(np.argmin(stretch[::-1]))
            more.append(at)
    return np.sort(np.concatenate([found, np.array(more, found.dtype)])) if more else found


def chunks(raw: bytes, cut_bytes: int = CUT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> tuple[np.ndarray, ...]:
    """``start, end, first word, word after the last, digest`` of each chunk of a text's bytes."""
    data = np.frombuffer(raw, np.uint8)
    at = all_cuts(data, cut_bytes)
    to = np.searchsorted(at, at + chunk_bytes)
    starts = at[to < len(at)]
    ends = at[to[to < len(at)]]
    space = _SPACE[data]
    heads = ~space
    heads[1:] &= space[:-1]
    words = np.concatenate([[0], np.cumsum(heads)])
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
    return starts, ends, words[starts], words[ends], digests.view(np.int64)


def repeated_passages(
    docs: DataFrame, cut_bytes: int = CUT_BYTES, chunk_bytes: int = CHUNK_BYTES, run_words: int = RUN_WORDS
) -> DataFrame:
    """Passages that stand more than once, across documents or within one: a row per place.

    ``doc_id, tag, start, end, n_words, kept, first_doc_id``. Places are bytes of the UTF-8 text and
    reach from the first to the last cut inside the passage. Chunks that stand for the first time, by
    (doc_id, start), join to passages that are ``kept``, and those that stood before to others, so a
    copied document keeps its own words and not those of an earlier one; the two may overlap at
    their edges. ``first_doc_id`` is the smallest document that holds a chunk of the passage.
    A text without words, or shorter than a chunk, has none, and
    so has a null text. Equal rows count as two places of one passage and come out once; texts that
    share an id are told apart by ``tag``, and a null id is a document that comes after all others.
    Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = [chunks((t or "").encode("utf-8", "surrogatepass"), cut_bytes, chunk_bytes) for t in part["text"].to_pylist()]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found]))
                start, end, first, last, digests = (np.concatenate(c).astype(np.int64) for c in zip(*found))
                # Start and length share a long: most of the table is these rows, twice shuffled.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests), part["doc_id"].take(rows), part["tag"].take(rows),
                     pa.array(start << 32 | (end - start)), pa.array(first << 32 | (last - first))],
                    names=["digest", "doc_id", "tag", "bytes", "words"],
                )

    schema = "digest long, doc_id long, tag short, bytes long, words long"
    tagged = texts(docs).withColumn("tag", F.xxhash64("text").bitwiseAND(0x7FFF).cast("short"))
    # Chunks are cut twice rather than stored: they weigh more than the texts.
    found = tagged.mapInArrow(cut, schema)
    firsts = found.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).filter("n > 1")
    firsts = materialize(firsts, "digests")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    # A digest with a thousandth of all repeated chunks is cut into parts; there are few of them.
    part = max(1.0, total / 1000)
    hot = cut_into(firsts.select(F.col("digest").alias("_key"), F.col("n").alias("count")), part)
    few = repeated(firsts.drop("n"), hot, "digest", "_part")
    twice = dealt(found, hot, "digest", "_part").join(few, ["digest", "_part"]).drop("_part")
    twice = twice.dropDuplicates(["doc_id", "tag", "bytes"])

    def place(column: str, start: str, end: str) -> list:
        first = F.shiftright(column, 32)
        return [first.cast("int").alias(start), (first + F.col(column).bitwiseAND(0x7FFFFFFF)).cast("int").alias(end)]

    row = ["doc_id", "tag"]
    first_here = F.min("start").over(Window.partitionBy(*row, "digest")) == F.col("start")
    in_order = Window.partitionBy(*row, "own").orderBy("start")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    dealt_out = twice.repartition(*row)
    marked = dealt_out.select(
        "digest", *row, "first_doc_id", *place("bytes", "start", "end"), *place("words", "first_word", "end_word")
    ).withColumn("own", F.col("first_doc_id").eqNullSafe(F.col("doc_id")) & first_here)
    marked = marked.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("run", F.sum("opens").over(in_order))
    passages = marked.groupBy(*row, F.col("own").alias("kept"), "run").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max("end_word") - F.min("first_word")).cast("long").alias("n_words"),
        F.min("first_doc_id").alias("first_doc_id"),
    )
    passages = passages.filter(F.col("n_words") >= run_words)
    return passages.select(*row, "start", "end", "n_words", "kept", "first_doc_id")


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with every passage cut out of ``text`` that is not ``kept``.

    Where a passage that is ``kept`` overlaps one that is not, the shared bytes stay. A document has
    one row of cuts, so long ones join like short ones. Cuts inside a character of several bytes
    move outward to its edge on the kept side.
    """
    small_batches(docs.sparkSession)
    removed = passages.groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("same"))
    removed = removed.agg(F.array_sort(F.collect_list(F.struct("start", "end", "kept"))).alias("cuts"))
    removed = removed.filter(F.exists("cuts", lambda c: ~c["kept"]))
    names, schema = docs.columns, docs.schema
    # The row as one column, so that no name of its columns meets one of ours.
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(F.col("text").cast("string")).bitwiseAND(0x7FFF).cast("short").alias("tag"))
    at = names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch["row"].flatten()
            columns[at] = pa.array([_without(t, c) for t, c in zip(columns[at].to_pylist(), batch["cuts"].to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("same"))
    return rows.join(removed, same, "left").select("row", "cuts").mapInArrow(rewrite, schema)


def _without(text: str | None, passages: list[dict] | None) -> str | None:
    if not text or not passages:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    left = np.ones(len(raw) + 2, bool)
    for kept in (False, True):
        for span in passages:
            if span["kept"] == kept:
                left[span["start"] + 1 : span["end"] + 1] = kept
    left[[0, -1]] = False
    edges = np.flatnonzero(left[1:] != left[:-1]).tolist()
    return "".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))
