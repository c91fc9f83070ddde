import random
import re
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import prefix_free


def plain(rows, length):
    """Every string of ``length`` bytes counted, one by one."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(raw[p : p + length] for _, raw in raws for p in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if counts[raw[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def found(docs, **options):
    rows = prefix_free.without_repeated_strings(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str)


def texts(seed, length):
    rng = random.Random(seed)

    def words(n):
        return " ".join(rng.choice(["alpha", "be", "gamma", "été", "文", "x", "lorem"]) + str(rng.randrange(50)) for _ in range(n))

    base = [words(rng.randrange(5, 400)) for _ in range(20)]
    rows = []
    for i in range(150):
        kind = rng.random()
        if kind < 0.2:
            text = rng.choice(base)
        elif kind < 0.5:  # a passage of about the least length
            whole = rng.choice(base)
            at = rng.randrange(len(whole))
            text = words(rng.randrange(60)) + whole[at : at + rng.randrange(length - 30, 2 * length)] + words(rng.randrange(60))
        elif kind < 0.7:  # near copies
            letters = list(rng.choice(base))
            for _ in range(rng.randrange(1, 6)):
                letters[rng.randrange(len(letters))] = "#"
            text = "".join(letters)
        elif kind < 0.75:
            text = "a" * rng.randrange(3 * length)
        elif kind < 0.8:
            text = "abcdefg " * rng.randrange(length // 3)
        else:
            text = words(rng.randrange(200))
        rows.append((i, text))
    rows += [(None, None), (None, base[0]), (5, ""), (6, "dup row " * 70), (6, "dup row " * 70)]
    return rows + [(1000 + i, "boiler plate text that is common " * 15 + words(30)) for i in range(30)]


@pytest.mark.parametrize("length, span", [(400, 192), (64, 40)])
def test_equals_counting_every_string(spark, length, span):
    rows = texts(length, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain(rows, length)
    assert sum(w[2] > 0 for w in want) > 60
    for options in ({}, {"block_bytes": 3000}, {"hot": 3}, {"hot": 2, "block_bytes": 2000}):
        assert found(docs, length=length, span=span, **options) == want


def test_awkward_rows(awkward, no_documents):
    rows = [(r.doc_id, r.text) for r in awkward.filter("doc_id IS NULL OR doc_id <> 4").collect()]
    got = found(awkward)
    assert len(got) == awkward.count()
    assert [g for g in got if g[0] != 4] == plain(rows, 400)
    (long,) = (g for g in got if g[0] == 4)
    # its words come round every 997, so that all of the text stands twice
    assert long[1] == long[2] and long[3] == 1
    assert found(no_documents) == []
    with pytest.raises(ValueError):
        prefix_free.without_repeated_strings(awkward, length=100)


def test_passages_go_by_their_bytes_and_not_by_their_words(spark):
    rows, sizes = [], {}
    for k, size in enumerate((300, 399, 400, 401, 600)):
        rng = random.Random(k)
        passage = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(130))[: size - 1] + "."
        assert len(passage) == size and len(passage.split()) > 50
        for i in range(3):  # other letters on either side, so that no copy reaches further
            sizes[3 * k + i] = size
            rows.append((3 * k + i, "xyz"[i] * 20 + str(k) + "UVW"[i] + passage + "KLM"[i] + str(k) + "rst"[i] * 20))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == plain(rows, 400)
    assert {i: (removed, spans) for i, _, removed, spans, _ in got} == {i: (n, 1) if n >= 400 else (0, 0) for i, n in sizes.items()}


def plain_words(rows, size):
    """Every sequence of ``size`` words counted, one by one."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    counts = Counter(tuple(ws[p : p + size]) for _, ws in split for p in range(len(ws) - size + 1))
    return sorted(
        (str(i), len({q for p in range(len(ws) - size + 1) if counts[tuple(ws[p : p + size])] > 1 for q in range(p, p + size)}))
        for i, ws in split
    )


@pytest.mark.parametrize("words, span", [(50, 32), (12, 5)])
def test_repeated_words_equal_counting_every_sequence(spark, words, span):
    rows = texts(words, 400) + [(2000, "  one\n" + "two \t" * 30), (2001, " "), (2002, "\x1c\u00a0 " * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_words(rows, words)
    assert sum(n > 0 for _, n in want) > 60
    for options in ({}, {"block_bytes": 3000}, {"hot": 3}, {"hot": 2, "block_bytes": 2000}):
        got = prefix_free.without_repeated_strings(docs, words=words, word_span=span, **options).collect()
        assert sorted((str(r.doc_id), r.n_repeated_words) for r in got) == want
    with pytest.raises(ValueError):
        prefix_free.without_repeated_strings(docs, words=words, word_span=words)


def test_passages_of_over_50_words_in_few_bytes_show(spark):
    rng = random.Random(11)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 8))) for _ in range(n))

    rows, want = [], {}
    for k, size in enumerate((30, 49, 51, 60, 64)):
        passage = words(size)
        assert len(passage) < 400
        for i in range(2):
            rows.append((2 * k + i, f"{words(80)} {i}\n{passage}\n{i + 5} {words(90)}"))
            want[2 * k + i] = size if size > 50 else 0
    rows += [(100 + i, words(200)) for i in range(10)]
    got = prefix_free.without_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeated_words for r in got} == want | {100 + i: 0 for i in range(10)}
    assert not any(r.n_removed for r in got)


def test_words_are_told_apart_by_their_bytes():
    raws = ["ab ba abc", "", "c ab", "ab", " été  ab\x0b"]
    data = np.frombuffer("".join(raws).encode(), np.uint8)
    ends = np.cumsum([0, *(len(r.encode()) for r in raws)])
    start, stop, word_ends = prefix_free.words_of(data, ends)
    found = [bytes(data[a:b]).decode() for a, b in zip(start, stop)]
    assert found == ["ab", "ba", "abc", "c", "ab", "ab", "été", "ab"] and word_ends.tolist() == [0, 3, 3, 5, 6, 8]
    codes = prefix_free.word_codes(data, start, stop).tolist()
    assert len(set(codes)) == 5 and codes[0] == codes[4] == codes[5] == codes[7]


def test_combined_suffix_arrays_find_each_split():
    rng = random.Random(5)
    for _ in range(30):
        pick = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
        size, length = rng.randrange(1, 40), 8
        before = [pick(rng.randrange(4)) for _ in range(size)]
        near = np.array([rng.randrange(len(b) + 1) for b in before])
        group = np.array([rng.randrange(2) for _ in range(size)])
        after = [bytes([65 + g]) * 4 + pick(length - 4 - k) for g, k in zip(group, near)]
        times = np.array([rng.choice([1, 1, 2]) for _ in range(size)])
        flags = prefix_free.combine(group, before, after, near, times, length)
        strings = Counter()
        for b, a, k, n in zip(before, after, near, times):
            for split in range(k, len(b) + 1):
                strings[split, b[len(b) - split :], a[: length - split]] += n
        for i, (b, a, k) in enumerate(zip(before, after, near)):
            for split in range(flags.shape[1]):
                want = k <= split <= len(b) and strings[split, b[len(b) - split :], a[: length - split]] > 1
                assert bool(flags[i, split]) == want
