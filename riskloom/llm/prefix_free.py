"""Substring dedup by prefix-free parsing, for matches of a fixed least length.

Rolling hashes of all windows of ``TRIGGER`` bytes choose the triggers: the least hash among any
``SPAN`` window starts. A trigger depends on nothing but the bytes of the string around it, so two
equal strings are cut alike. The text before a trigger, back to where another trigger takes over, is
the end of a dictionary phrase; the text after it is a suffix of the parse. Matches end after
``length`` bytes, so suffixes of the parse need not be ordered further than that.

All triggers are sorted by the digest of what follows them (a range shuffle), which puts equal parse
suffixes side by side. Equal contexts there settle almost all places. Where equal suffixes follow different
phrases, the suffix array of the parse (what follows, sorted, with common prefix lengths) and that of
the dictionary (phrases sorted by their ends, with common suffix lengths) are combined: for each
split of the match into phrase end and parse suffix, places whose neighbours agree on both
sides are repeated.

Words are parsed beside the bytes, each one symbol of 64 bits, for passages that have many words in few
bytes. Their rows travel with those of the bytes; places of words count from ``WORDS_AT`` on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import lists, offsets_of, slices
from .common import join_uneven, materialize, texts
from .hashing import mix

LENGTH = 400  # bytes of a match
TRIGGER = 16  # bytes of a rolling hash
SPAN = 192  # window starts among which one is a trigger
BLOCK_BYTES = 1 << 19  # text of a block; a longer text is a block of its own
WORDS = 50  # words of a match; a passage of more shows even if its last word grew together with what follows
WORD_TRIGGER = 8  # words of a rolling hash
WORD_SPAN = 32  # word starts among which one is a trigger
WORD_BYTES = 8  # of a word's symbol
WORDS_AT = 1 << 40  # place of a block's first word; bytes stand before
HOT_CONTEXTS = 20_000  # different contexts of one parse suffix that are combined in one task
_MULTIPLIER = 0x9E3779B1
_WORD_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_WORD_MULTIPLIER))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def rolling_hashes(data: np.ndarray, size: int = TRIGGER) -> np.ndarray:
    """A 32-bit hash of the ``size`` bytes (a power of two) from each place on, built by doubling."""
    h = data.astype(np.uint32) + np.uint32(1)
    step, factor = 1, _MULTIPLIER
    while step < size:
        h = h[: len(h) - step] * np.uint32(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least value of each window of ``size``."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, stop`` of each word in texts that end at ``ends`` of ``data``, and the words before each end."""
    inked = np.zeros(len(data) + 1, bool)
    inked[:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # no word reaches over it
    edge[ends] = True
    left = np.concatenate([[False], inked[:-1]])
    start = np.flatnonzero(inked & (edge | ~left))
    stop = np.flatnonzero(left & (edge | ~inked))
    return start, stop, np.searchsorted(start, ends)


def word_codes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A symbol for each word: a hash of its bytes, from sums of powers over all of ``data``."""
    powers = np.full(len(data) + 1, _WORD_MULTIPLIER, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers[:-1], out=sums[1:])
    back = np.full(len(data) + 1, pow(_WORD_MULTIPLIER, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((sums[stop] - sums[start]) * back[start])


def triggers(
    data: np.ndarray, ends: np.ndarray, length: int = LENGTH, span: int = SPAN, size: int = TRIGGER
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``at, far, near`` of each trigger in texts that end at ``ends`` of ``data``.

    It is the trigger of the strings of ``length`` bytes that start ``near`` to ``far`` bytes before it. ``data``
    may also be symbols of words, which are then counted instead of bytes.
    """
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none
    h = rolling_hashes(data, size).astype(np.uint64)
    least = window_least((h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), span)[: len(data) - length + 1]
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(ends)
    inside = np.zeros(len(data) + 1, np.int64)  # starts of strings that end in the same text
    long = sizes >= length
    inside[ends[:-1][long]] += 1
    inside[ends[1:][long] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside)[: len(trigger)])
    if not len(start):
        return none, none, none
    of = trigger[start]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return of[first], of[first] - start[first], of[first] - start[last]


def digests(raw: bytes, at: np.ndarray, far: np.ndarray, near: np.ndarray, length: int, span: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each trigger: digest of what follows in every string it serves, and of its whole context.

    Symbols take ``unit`` bytes of ``raw``.
    """
    digest = xxhash.xxh3_64_intdigest
    known = (length - span + 1) * unit
    after = np.fromiter((digest(raw[m : m + known]) for m in (at * unit).tolist()), np.uint64, len(at))
    places = zip(((at - far) * unit).tolist(), ((at - near + length) * unit).tolist(), (far * span + near).tolist())
    whole = np.fromiter((digest(raw[a:b], s) for a, b, s in places), np.uint64, len(at))
    return after.view(np.int64), whole.view(np.int64)


def common_prefixes(rows: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each string with the one before, 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) < 2:
        return out
    width = max(map(len, rows))
    grid = np.zeros((len(rows), width), np.uint8)
    for i, row in enumerate(rows):
        grid[i, : len(row)] = np.frombuffer(row, np.uint8)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    differ = grid[1:] != grid[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def combine(
    group: np.ndarray, before: list[bytes], after: list[bytes], near: np.ndarray, n: np.ndarray, length: int, unit: int = 1
) -> np.ndarray:
    """Which strings of the contexts are repeated: row by context, column by symbols (of ``unit`` bytes) before the trigger.

    ``group`` are the parse suffixes that contexts share; ``n`` says how often a context stands.
    Context ``i`` serves the strings from ``near[i]`` symbols before its trigger to all of ``before[i]``.
    """
    size = len(before)
    far = np.fromiter(map(len, before), np.int64, size) // unit
    order = sorted(range(size), key=lambda i: (group[i], after[i]))  # suffix array of the parse
    parse = common_prefixes([after[i] for i in order]) // unit
    parse[1:][group[order][1:] != group[order][:-1]] = -1
    parse[0] = -1
    turned = [b[::-1] for b in before]
    ends = sorted(range(size), key=turned.__getitem__)  # suffix array of the dictionary
    phrase = common_prefixes([turned[i] for i in ends]) // unit
    phrase[0] = -1
    order, ends = np.array(order), np.array(ends)
    found = np.zeros((size, int(far.max(initial=0)) + 1), bool)
    of_parse, of_phrase = np.empty(size, np.int64), np.empty(size, np.int64)
    for split in range(int(near.min(initial=0)), int(far.max(initial=0)) + 1):
        serves = np.flatnonzero((near <= split) & (split <= far))
        of_parse[order] = np.cumsum(parse < length - split)
        of_phrase[ends] = np.cumsum(phrase < split)
        key = of_parse[serves] * (size + 1) + of_phrase[serves]
        _, same = np.unique(key, return_inverse=True)
        found[serves, split] = np.bincount(same, n[serves])[same] > 1
    return found


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def _unpacked(batch: pa.RecordBatch, row: int) -> tuple[bytes, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(batch["data"][row].as_py())
    return raw, offsets_of(batch["sizes"].slice(row, 1).flatten().to_numpy())


def without_repeated_strings(
    docs: DataFrame, length: int = LENGTH, span: int = SPAN, block_bytes: int = BLOCK_BYTES, hot: int = HOT_CONTEXTS,
    words: int = WORDS, word_span: int = WORD_SPAN,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, n_repeated_words`` of every row of ``docs``.

    ``kept`` are the UTF-8 bytes that no string of ``length`` bytes covers which also starts anywhere else in
    the table, in any text; such strings may overlap each other and even themselves. Strings never cross rows,
    and all are judged on the texts as given. A null text is empty; null and repeated ids, and equal rows, are
    rows of their own (two equal long rows lose everything, both); other columns are not read, and no rows
    give none.

    ``n_repeated_words`` counts the words ``[^\\x20\\x09-\\x0D]+`` that a sequence of ``words`` words covers which
    also starts anywhere else, in however few bytes and with any spaces between; nothing is removed for it.

    Texts lie in compressed blocks, which are shuffled whole; between tasks travel a row per trigger, and
    contexts of the few triggers that their digests leave open. Digests have 128 bits together where they decide.
    """
    if not 0 < span <= min(1024, length - TRIGGER + 1):
        raise ValueError("a match must hold all windows among which a trigger is chosen, 1024 at most")
    if not 0 < word_span <= min(1024, words - WORD_TRIGGER + 1):
        raise ValueError("a match must hold all words among which a trigger is chosen, 1024 at most")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            text = pc.fill_null(batch["text"], "")
            sizes = pc.binary_length(text).to_numpy().astype(np.int64)
            for low, high in slices(sizes + 16, block_bytes):
                data = b"".join(pc.cast(text.slice(low, high - low), pa.binary()).to_pylist())
                one = np.array([0, high - low])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), lists(one, batch["doc_id"].slice(low, high - low)),
                     lists(one, pa.array(sizes[low:high])), pa.array([squeeze.compress(data)], pa.binary())],
                    names=["block", "doc_id", "sizes", "data"],
                )
                number += 1

    blocks = materialize(texts(docs).mapInArrow(pack, "block long, doc_id array<long>, sizes array<long>, data binary"), "blocks")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, ends = _unpacked(batch, row)
                data = np.frombuffer(raw, np.uint8)
                start, stop, word_ends = words_of(data, ends)
                codes = word_codes(data, start, stop)
                served = triggers(data, ends, length, span)
                by_word = triggers(codes, word_ends, words, word_span, WORD_TRIGGER)
                after, whole = (
                    np.concatenate(c)
                    for c in zip(digests(raw, *served, length, span), digests(codes.tobytes(), *by_word, words, word_span, WORD_BYTES))
                )
                at = np.concatenate([served[0], by_word[0] + WORDS_AT])
                far, near = (np.concatenate(c) for c in zip(served[1:], by_word[1:]))
                block = np.full(len(at), batch["block"][row].as_py())
                # where the trigger stands and which strings it serves, in one number
                place = at << 20 | far << 10 | near
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (after, whole, block, place)], names=["after", "whole", "block", "place"])

    rows = blocks.select("block", "sizes", "data").mapInArrow(parse, "after long, whole long, block long, place long")
    keys = ["after", "whole", "block", "place"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts that stand twice in a range are repeated; others that share a suffix stay open.

        The suffix at either edge of a range may go on in the next one, so its contexts stay open too.
        """
        edge, held = True, None

        def judged(last: bool) -> pa.RecordBatch:
            after, whole, block, place = held
            new = np.concatenate([[True], after[1:] != after[:-1]]) if len(after) else np.zeros(0, bool)
            context = new | np.concatenate([[True], whole[1:] != whole[:-1]]) if len(after) else new
            of_suffix, of_context = np.cumsum(new) - 1, np.cumsum(context) - 1
            times = np.bincount(of_context)[of_context]
            shared = np.bincount(of_suffix, context)[of_suffix] > 1
            if edge:
                shared |= of_suffix == 0
            if last:
                shared |= of_suffix == of_suffix[-1]
            first = context & shared
            keep = (times > 1) | first
            wanted = np.where(first, times, 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(after[keep]), pa.array(block[keep]), pa.array(place[keep]), pa.array(times[keep] > 1), pa.array(wanted[keep], pa.int64())],
                names=["after", "block", "place", "repeated", "contexts"],
            )

        for batch in batches:
            fresh = [batch[k].to_numpy() for k in keys]
            held = fresh if held is None else [np.concatenate(c) for c in zip(held, fresh)]
            # the last suffix may go on in the next batch; a long one is cut, and its parts stay open
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut == 0 and len(held[0]) < 4 * hot:
                continue
            cut = cut or len(held[0])
            rest = [c[cut:] for c in held]
            whole_run = not len(rest[0])
            held = [c[:cut] for c in held]
            yield judged(whole_run)
            edge, held = whole_run, (None if whole_run else rest)
        if held is not None and len(held[0]):
            yield judged(True)

    found = materialize(rows.mapInArrow(settle, "after long, block long, place long, repeated boolean, contexts long"), "found")
    open_ = found.filter("contexts > 0")
    often = open_.groupBy("after").count().filter(F.col("count") > hot).select("after", F.lit(True).alias("hot"))
    often = materialize(often, "often")
    asked = join_uneven(open_, often, "after", how="left").groupBy("block").agg(F.collect_list(F.struct("after", "place", "contexts", "hot")).alias("asked"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, ends = _unpacked(batch, row)
                asked = batch["asked"].slice(row, 1).flatten()
                place = asked.field("place").to_numpy()
                at, far, near = place >> 20, place >> 10 & 1023, place & 1023
                by_word = at >= WORDS_AT
                spelt = b""
                if by_word.any():
                    data = np.frombuffer(raw, np.uint8)
                    spelt = word_codes(data, *words_of(data, ends)[:2]).tobytes()
                unit, size = np.where(by_word, WORD_BYTES, 1), np.where(by_word, words, length)
                middle = (at - np.where(by_word, WORDS_AT, 0)) * unit
                of = [spelt if w else raw for w in by_word.tolist()]
                before = [t[a:m] for t, a, m in zip(of, (middle - far * unit).tolist(), middle.tolist())]
                after = [t[m:b] for t, m, b in zip(of, middle.tolist(), (middle + (size - near) * unit).tolist())]
                for low in range(0, len(place), 4096):
                    part = slice(low, low + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [asked.field("after")[part], pa.array([batch["block"][row].as_py()] * len(place[part]), pa.int64()), pa.array(place[part]),
                         asked.field("contexts")[part], asked.field("hot")[part], pa.array(before[part], pa.binary()), pa.array(after[part], pa.binary())],
                        names=["suffix", "block", "place", "n", "hot", "before", "after"],
                    )

    context = "suffix long, block long, place long, n long, hot boolean, before binary, after binary"
    wide = materialize(blocks.select("block", "sizes", "data").join(asked, "block").mapInArrow(contexts, context), "contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["suffix", "block", "place", "n", "before", "after"]

        def result(held: pa.RecordBatch) -> pa.RecordBatch:
            spans = []
            by_word = held["place"].to_numpy() >> 20 >= WORDS_AT
            for mine, size, unit in ((~by_word, length, 1), (by_word, words, WORD_BYTES)):
                if not mine.any():
                    continue
                part = held.filter(pa.array(mine))
                place, n = part["place"].to_numpy(), part["n"].to_numpy()
                flags = combine(part["suffix"].to_numpy(), part["before"].to_pylist(), part["after"].to_pylist(), place & 1023, n, size, unit)
                spans += [(b, (m >> 20) - y, (m >> 20) - x) for b, m, f in zip(part["block"].to_pylist(), place.tolist(), flags) for x, y in zip(*runs(f))]
            columns = zip(*spans) if spans else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "first", "last"])

        held = None
        for batch in batches:
            batch = batch.select(names)
            held = batch if held is None else pa.concat_batches([held, batch])
            suffix = held["suffix"].to_numpy()
            cut = int(np.flatnonzero(suffix == suffix[-1])[0])
            if cut >= 4096:
                yield result(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield result(held)

    by_suffix = wide.filter("hot IS NULL").repartition("suffix").sortWithinPartitions("suffix")
    spans = by_suffix.mapInArrow(compare, "block long, first long, last long")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A digest for each string of contexts whose suffix has too many for one task."""
        for batch in batches:
            for block, place, n, before, after in zip(*(batch[c].to_pylist() for c in ("block", "place", "n", "before", "after"))):
                text = before + after
                unit, size = (WORD_BYTES, words * WORD_BYTES) if place >> 20 >= WORDS_AT else (1, length)
                far = len(before) // unit
                starts = np.arange(far - (place & 1023) + 1)
                own = [xxhash.xxh3_128_digest(text[s : s + size]) for s in (starts * unit).tolist()]
                first = (place >> 20) - far
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()), pa.array([block] * len(own), pa.int64()), pa.array(starts + first), pa.array([n] * len(own), pa.int64())],
                    names=["string", "block", "first", "n"],
                )

    strings = wide.filter("hot").mapInArrow(spelled, "string binary, block long, first long, n long")
    strings = materialize(strings, "strings")
    twice = strings.groupBy("string").agg(F.sum("n").alias("times")).filter("times > 1").drop("times")
    single = join_uneven(strings, twice, "string").select("block", "first", F.col("first").alias("last"))
    place = F.col("place")
    trigger, far, near = F.shiftright(place, 20), F.shiftright(place, 10).bitwiseAND(1023), place.bitwiseAND(1023)
    whole = found.filter("repeated").select("block", (trigger - far).alias("first"), (trigger - near).alias("last"))
    removed = whole.union(spans).union(single).groupBy("block").agg(F.collect_list(F.struct("first", "last")).alias("removed"))

    def covered(first: np.ndarray, last: np.ndarray, size: int, total: int) -> np.ndarray:
        edges = np.zeros(total + 1, np.int32)
        np.add.at(edges, first, 1)
        np.add.at(edges, last + size, -1)
        return np.cumsum(edges)[:total] > 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, ends = _unpacked(batch, row)
                data = np.frombuffer(raw, np.uint8)
                spans = batch["removed"].slice(row, 1).flatten()
                none = np.empty(0, np.int64)
                first, last = (spans.field(k).to_numpy() if len(spans) else none for k in ("first", "last"))
                by_word = first >= WORDS_AT
                gone = covered(first[~by_word], last[~by_word], length, len(raw))
                n_words = np.zeros(len(ends) - 1, np.int64)
                if by_word.any():
                    word_ends = words_of(data, ends)[2]
                    shared = covered(first[by_word] - WORDS_AT, last[by_word] - WORDS_AT, words, int(word_ends[-1]))
                    n_words = np.diff(np.concatenate([[0], np.cumsum(shared)])[word_ends])
                kept, counts, n_spans = [], [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    mark = gone[a:b]
                    kept.append(data[a:b][~mark].tobytes())
                    counts.append(b - a - len(kept[-1]))
                    n_spans.append(len(runs(mark)[0]))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, 1).flatten(), pa.array(np.diff(ends)), pa.array(counts, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(n_words, pa.int64())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeated_words"],
                )

    return blocks.join(removed, "block", "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_repeated_words long")
