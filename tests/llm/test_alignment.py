import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskloom.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", " ", "\n", "\t", "a", "b", "the", "ing", "'s", "1", "23", ".", ",", "é", "é", "文字", "  ", "\r\n", "\x00", "▁", " ", "　",
    "<|endoftext|>", "<s>", "<0x0A>", "😀", " ", "Ω", "\x1c", "(){;\r", "don't", "x" * 50,
]


@pytest.fixture(scope="module")
def plain():
    """Figures of rows by the two tokenizers over whole texts, link by link."""
    a_side = Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte = alignment.byte_level_alphabet()

    def tokens(text):
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        a_raw = [bytes(byte[c] for c in a_side.id_to_token(i)) for i in a]
        names = [(b_side.is_byte(i), b_side.id_to_piece(i)) for i in b]
        b_raw = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for is_byte, p in names]
        return (a, a_raw, b, b_raw) if b"".join(a_raw) == (" " + text).encode() == b"".join(b_raw) else None

    def figures(rows):
        counts, out = Counter(), []
        for doc_id, text in rows:
            found = tokens(text) if text else None
            if not found:
                out.append((doc_id, 0, 0, 0, [], ""))
                continue
            a, a_raw, b, b_raw = found
            a_ends = [len(b"".join(a_raw[: i + 1])) for i in range(len(a))]
            b_ends = [len(b"".join(b_raw[: i + 1])) for i in range(len(b))]
            links = [
                (a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                if a_ends[i] - len(a_raw[i]) < b_ends[j] and b_ends[j] - len(b_raw[j]) < a_ends[i]
            ]
            counts.update(links)
            groups, i, j = [], 0, 0
            for end in sorted(set(a_ends) & set(b_ends)):
                to_i, to_j = bisect_left(a_ends, end) + 1, bisect_left(b_ends, end) + 1
                groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
                i, j = to_i, to_j
            out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        best = {}
        for (_, y), n in counts.items():
            best[y] = max(best.get(y, 0), n)
        return sorted(
            ((i, a, b, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h) for i, a, b, g, ls, h in out), key=str
        )

    return figures


def test_alignment_equals_whole_texts(spark, plain):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PARTS[:12] if i % 2 else PARTS) for _ in range(rng.randrange(40)))) for i in range(500)]
    rows += [(None, None), (None, "some words"), (7, ""), (7, "same text"), (7, "same text"), (8, " "), (9, "\n"), (10, "a "), (11, "  a"), (12, "a  b " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows)
    assert sum(w[1] > 0 for w in want) > 300
    for size in (1, 4096, 1 << 20):
        assert sorted((tuple(r) for r in alignment.alignment(docs, BYTES, PIECES, block_bytes=size).collect()), key=str) == want


def test_given_documents(spark, plain):
    rows = [(r.doc_id, r.text[:4000]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.alignment(docs, BYTES, PIECES).collect()), key=str) == plain(rows)


def test_awkward_rows(awkward, no_documents):
    found = alignment.alignment(awkward, BYTES, PIECES)
    assert found.count() == awkward.count() and found.filter("n_a > 0").count() == 7
    assert alignment.alignment(no_documents, BYTES, PIECES).count() == 0


def test_a_forgotten_cache_changes_nothing(spark, monkeypatch):
    rows = [(i, f"text number {i} of many, some say {i % 7}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(map(str, alignment.alignment(docs, BYTES, PIECES).collect()))
    monkeypatch.setattr(alignment, "CACHE_BYTES", 10)
    assert sorted(map(str, alignment.alignment(docs, BYTES, PIECES, block_bytes=200).collect())) == want
