"""Cross-tokenizer alignment, native to Arrow inside tasks.

A text is cut into stretches where both tokenizers start anew, so its alignment is that of its
stretches, one after another. Stretches that a worker meets for the first time are aligned together:
token lists are flattened with the parent index of each token, segmented cumulative sums give the
byte where it ends, an Acero hash join on (stretch, end) finds the ends that both sides share, and
the sorted outer join is the list of links. Blocks of texts count their id pairs with
``Table.group_by``; Spark merges the counts and brings them back to the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

BLOCK_BYTES = 1 << 19  # text of a block; a longer text is a block of its own
CACHE_STRETCHES = 400_000  # stretches that a worker knows before it forgets them all
CACHE_BYTES = 8 << 20  # and text of them
SPACE_PIECE = "\u2581"

# One row per block: figures and stretches of its documents as one compressed value, and its id pairs.
BLOCK = "block long, payload binary, pairs array<struct<a:int,b:int,n:long>>"
PAYLOAD = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ends", "stretches", "pair_ends", "pair_at"]
ALIGNED = {
    "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long",
    "count_sum": "long", "groups_sha256": "string",
}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def byte_level_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: bytes that print stand for themselves."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def align(a: pa.Array, b: pa.Array, a_bytes: pa.Array, b_bytes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Align lists of ids ``a`` and ``b`` of the same units, each unit's tokens covering the same bytes.

    ``a_bytes`` and ``b_bytes`` are the bytes of each id. Returns the number of links and of groups
    of each unit, the links as ``a id << 32 | b id`` in order, and the groups of each unit as text.
    Tokens that overlap share exactly one stretch between two neighbouring ends of either side, so the
    rows of the outer join on ends are the links.
    """
    n = len(a)

    def ended(ids: pa.Array, sizes: pa.Array, name: str) -> pa.Table:
        flat, unit = pc.list_flatten(ids), pc.list_parent_indices(ids)
        run = pc.cumulative_sum(pc.cast(pc.binary_length(sizes.take(flat)), pa.int64())).to_numpy()
        first = ids.offsets.to_numpy()[:-1].astype(np.int64)
        base = np.concatenate([[0], run])[first]
        return pa.table({"unit": pc.cast(unit, pa.int64()), "end": pa.array(run - base[unit.to_numpy()]), name: pc.cast(flat, pa.int64())})

    cut = ended(a, a_bytes, "a").join(ended(b, b_bytes, "b"), keys=["unit", "end"], join_type="full outer", use_threads=False)
    cut = cut.sort_by([("unit", "ascending"), ("end", "ascending")]).combine_chunks()
    unit = cut["unit"].to_numpy()
    has_a, has_b = pc.is_valid(cut["a"]).to_numpy(), pc.is_valid(cut["b"]).to_numpy()
    shared = has_a & has_b
    left, right = pc.fill_null_backward(cut["a"]).to_numpy(), pc.fill_null_backward(cut["b"]).to_numpy()
    links = np.bincount(unit, minlength=n)
    groups = np.bincount(unit[shared], minlength=n)

    def joined(has: np.ndarray, ids: np.ndarray) -> pa.Array:
        ends = offsets_of(has)[1:][shared]
        return pc.binary_join(lists(np.concatenate([[0], ends]), pc.cast(pa.array(ids[has]), pa.string())), ",")

    each = pc.binary_join_element_wise(joined(has_a, left), joined(has_b, right), "|")
    return links, groups, (left << 32) | right, pc.binary_join(lists(offsets_of(groups), each), ";")


class Stretches:
    """Token counts, links and group texts of the stretches met, by number."""

    # A stretch ends before a space or line feed that follows a visible ASCII character, letter or number. The
    # byte-level side starts anew there, and no piece of the other holds either character inside.
    CUT = r"([!-~\p{L}\p{N}])([ \n])"

    def __init__(self, byte_bpe_json: str, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        byte = byte_level_alphabet()
        size = self.a.get_vocab_size()
        self.a_bytes = pa.array(
            [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in map(self.a.id_to_token, range(size))],
            pa.binary(),
        )
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)],
            pa.binary(),
        )
        self.space = self.b.piece_to_id(SPACE_PIECE)
        # Vocabularies that reach over a cut are encoded whole.
        self.cuts = not any("\n" in p or SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces)
        self._forget()

    @classmethod
    def shared(cls, byte_bpe_json: str, piece_model: bytes) -> Stretches:
        """The stretches of this worker process, for tasks that follow each other in it."""
        import sentencepiece

        known = sentencepiece.__dict__.setdefault("_riskloom_stretches", {})
        key = (byte_bpe_json, piece_model)
        if key not in known:
            known.clear()
            known[key] = cls(*key)
        return known[key]

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.held = 0
        self.counts = np.zeros((0, 4), np.int64)  # tokens of a, of b, groups, links; -1 where bytes differ
        self.link_ends = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        self.groups: pa.Array = pa.array([], pa.string())

    def _pieces(self, stretches: list[str]) -> list[list[int]]:
        # The model puts a space before a text, unless there is none; the first stretches have it already.
        found = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        return [[self.space] if s == " " else ids if s[0] == " " else ids[1:] for s, ids in zip(stretches, found)]

    def _learn(self, new: list[str]) -> None:
        a_ids = [e.ids for e in self.a.encode_batch(new, add_special_tokens=False)]
        b_ids = self._pieces(new)
        raw = pa.array([s.encode() for s in new], pa.binary())

        def spelled(ids: pa.Array, table: pa.Array) -> pa.Array:
            return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, table.take(ids.values)), b"")

        a, b = pa.array(a_ids, pa.list_(pa.int32())), pa.array(b_ids, pa.list_(pa.int32()))
        same = pc.and_(pc.equal(spelled(a, self.a_bytes), raw), pc.equal(spelled(b, self.b_bytes), raw)).to_numpy(zero_copy_only=False)
        if not same.all():
            a, b = (pa.array([x if s else [] for x, s in zip(ids, same)], pa.list_(pa.int32())) for ids in (a_ids, b_ids))
        n_links, n_groups, links, groups = align(a, b, self.a_bytes, self.b_bytes)
        counts = np.stack([pc.list_value_length(a).to_numpy(), pc.list_value_length(b).to_numpy(), n_groups, n_links], 1).astype(np.int64)
        counts[~same] = -1
        first = len(self.counts)
        self.numbers.update(zip(new, range(first, first + len(new))))
        self.counts = np.concatenate([self.counts, counts])
        self.link_ends = np.concatenate([self.link_ends, self.link_ends[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, links])
        self.groups = pa.concat_arrays([self.groups, groups])
        self.held += sum(map(len, new))

    def cut(self, texts: pa.Array) -> pa.Array:
        """Space and text as a list of stretches, none for an empty text."""
        spaced = pc.binary_join_element_wise("", texts, " ")
        if not self.cuts:
            return lists(np.arange(len(texts) + 1), spaced)
        parts = pc.split_pattern(pc.replace_substring_regex(spaced, self.CUT, "\\1\x00\\2"), "\x00")
        whole = pc.or_(pc.equal(texts, ""), pc.match_substring(texts, "\x00"))  # a text that holds the mark is not cut
        if pc.any(whole).as_py():
            rows = zip(texts.to_pylist(), parts.to_pylist())
            parts = pa.array([[] if not t else [" " + t] if "\x00" in t else p for t, p in rows], pa.list_(pa.string()))
        return parts

    def look_up(self, stretches: list[str]) -> np.ndarray:
        if self.held > CACHE_BYTES or len(self.numbers) > CACHE_STRETCHES:
            self._forget()
        new = [s for s in stretches if s not in self.numbers]
        if new:
            self._learn(new)
        return np.fromiter(map(self.numbers.__getitem__, stretches), np.int64, len(stretches))


def blocks(ids: pa.Array, texts: pa.Array, known: Stretches, number: int) -> pa.RecordBatch:
    """One row for a block of texts: figures of its documents, their stretches, and its id pairs with counts."""
    n = len(texts)
    parts = known.cut(pc.fill_null(texts, ""))
    encoded = pc.list_flatten(parts).dictionary_encode()
    at = encoded.indices.to_numpy().astype(np.int64)
    distinct = known.look_up(encoded.dictionary.to_pylist())
    sizes = pc.list_value_length(parts).to_numpy()
    owner = np.repeat(np.arange(n), sizes)
    counts = known.counts[distinct]
    spoiled = np.bincount(owner, counts[at, 0] < 0, minlength=n) > 0
    stays = ~spoiled[owner]
    at, owner = at[stays], owner[stays]
    used, at = np.unique(at, return_inverse=True)
    distinct, counts = distinct[used], counts[used]
    ends = offsets_of(np.bincount(owner, minlength=n))
    figures = [np.bincount(owner, counts[at, k], minlength=n).astype(np.int64) for k in range(4)]
    texts_of_groups = pc.binary_join(lists(ends, known.groups.take(pa.array(distinct[at]))), ";")
    digests = ["" if not m else hashlib.sha256(g.encode()).hexdigest() for g, m in zip(texts_of_groups.to_pylist(), figures[0])]

    first, last = known.link_ends[distinct], known.link_ends[distinct + 1]
    lengths = last - first
    pair_ends = offsets_of(lengths)
    links = known.links[np.arange(pair_ends[-1]) + np.repeat(first - pair_ends[:-1], lengths)]
    times = np.repeat(np.bincount(at, minlength=len(distinct)), lengths)
    counted = pa.table({"pair": links, "n": times}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    pair = counted["pair"].combine_chunks()
    pair_at = pc.index_in(pa.array(links), value_set=pair)
    pairs = pa.StructArray.from_arrays(
        [pc.cast(pc.shift_right(pair, 32), pa.int32()), pc.cast(pc.bit_wise_and(pair, 0xFFFFFFFF), pa.int32()), counted["n_sum"].combine_chunks()],
        names=["a", "b", "n"],
    )

    def one(values: pa.Array) -> pa.Array:
        return lists(np.array([0, len(values)]), values)

    columns = [
        one(ids), *(one(pa.array(f)) for f in figures), one(pa.array(digests, pa.string())),
        one(pa.array(ends.astype(np.int32))), one(pa.array(at.astype(np.int32))),
        one(pa.array(pair_ends.astype(np.int32))), one(pc.cast(pair_at, pa.int32())),
    ]
    payload = pa.BufferOutputStream()
    with pa.ipc.new_stream(payload, pa.schema([(n, c.type) for n, c in zip(PAYLOAD, columns)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, names=PAYLOAD))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([payload.getvalue().to_pybytes()], pa.binary()), one(pairs)], names=["block", "payload", "pairs"]
    )


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of a single row that is larger."""
    ends = offsets_of(sizes)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def alignment(docs: DataFrame, byte_bpe_path: str, piece_model_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Figures of the alignment of two tokenizers for every row of ``docs``.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. A link is a token of each
    side that share bytes; its count is the number of links of the whole table with the same two ids;
    ``n_best`` are the links whose count is the highest of their second id. Groups lie between the
    bytes where both sides end a token. A text that is null or empty, or whose tokens do not spell it,
    has zeros and no digest, and its links do not count. Null and repeated ids are rows like any other,
    other columns are not read, and no rows give none.

    Blocks hold a bounded number of bytes. What travels between tasks are distinct pairs of a block,
    so a frequent pair has a row per block, and the rows of the blocks themselves, once.
    """
    with open(byte_bpe_path, encoding="utf-8") as file:
        byte_bpe = file.read()
    with open(piece_model_path, "rb") as file:
        piece_model = file.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stretches.shared(byte_bpe, piece_model)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 64
            for low, high in slices(sizes, block_bytes):
                yield blocks(ids.slice(low, high - low), texts.slice(low, high - low), known, number)
                number += 1

    stored = materialize(texts(docs).mapInArrow(count, BLOCK), "alignment")
    pairs = stored.select("block", F.posexplode("pairs").alias("at", "pair")).select("block", "at", "pair.*")
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # One row per id of the second vocabulary: bounded whatever the table holds.
    best = totals.groupBy("b").agg(F.max("count").alias("most"))
    counted = totals.join(F.broadcast(best), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    known = pairs.drop("n").join(counted, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("at", "count", "best")).alias("known"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = pa.ipc.open_stream(batch["payload"][row].as_buffer()).read_next_batch()

                def flat(name: str) -> pa.Array:
                    return held[name].flatten()

                ends, at, pair_ends = (flat(c).to_numpy().astype(np.int64) for c in ("ends", "stretches", "pair_ends"))
                pair_at, looked = flat("pair_at").to_numpy(), batch["known"].slice(row, 1).flatten()
                columns = []
                for name in ("best", "count"):
                    of_pair = np.zeros(len(looked), np.int64)
                    of_pair[looked.field("at").to_numpy()] = pc.cast(looked.field(name), pa.int64()).to_numpy()
                    per_stretch = np.diff(np.concatenate([[0], np.cumsum(of_pair[pair_at])])[pair_ends])
                    columns.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(per_stretch[at])])[ends])))
                shown = [flat(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*shown, *columns, flat("groups_sha256")], names=list(ALIGNED))

    return stored.drop("pairs").join(known, "block", "left").mapInArrow(weigh, _ddl(ALIGNED))
