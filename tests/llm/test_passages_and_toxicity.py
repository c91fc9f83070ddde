import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import chunk_dedup, toxicity


def prose(rng, n):
    return [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(10**5)}" for _ in range(n)]


def test_hash_equals_a_rolling_one():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    h, expected = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(chunk_dedup._GEAR[b])) & 0xFFFF
        if h < 65536 // chunk_dedup.CUT_BYTES and i >= 15:
            expected.append(i + 1)
    assert chunk_dedup.cuts(np.frombuffer(data, np.uint8)).tolist() == expected


def test_an_insertion_changes_only_chunks_around_it():
    rng = random.Random(2)
    raw = " ".join(prose(rng, 900)).encode()
    *_, before = chunk_dedup.chunks(raw)
    *_, after = chunk_dedup.chunks(raw[:3000] + b"INSERTED" + raw[3000:])
    lost = len(set(before.tolist()) - set(after.tolist()))
    assert len(before) > 150 and lost <= 12


def test_periodic_text_without_low_hashes_is_cut(documents):
    rng = random.Random(9)
    lines = []
    while len(lines) < 6:
        line = " ".join(prose(rng, rng.randrange(4, 9))) + "\n"
        if not len(chunk_dedup.cuts(np.frombuffer((line * 4).encode(), np.uint8))):
            lines.append(line)
    lines.append("= ")
    texts = [(2 * i + j, " ".join(prose(rng, 40 + 7 * i)) + "\n" + line * (600 // len(line))) for i, line in enumerate(lines) for j in (0, 1)]
    found = chunk_dedup.repeated_passages(documents(*texts)).collect()
    for i, line in enumerate(lines):
        later = [r for r in found if r.doc_id == 2 * i + 1]
        assert [(r.kept, r.first_doc_id) for r in later] == [(False, 2 * i)]
        assert later[0].end - later[0].start >= 300
    assert all(b - a <= 2 * chunk_dedup.GAP_BYTES for t in texts for a, b in zip(*chunk_dedup.chunks(t[1].encode())[:2]))


def test_finds_repeated_passages_and_leaves_others(documents):
    """Against all repeated windows of 50 words."""
    rng = random.Random(3)
    passages = [prose(rng, rng.randrange(55, 120)) for _ in range(15)]
    texts = []
    for d in range(120):
        words = prose(rng, rng.randrange(30, 300))
        if d % 2:
            passage = passages[d % 15]
            at = rng.randrange(len(words))
            words[at:at] = passage
        texts.append(" ".join(words))
    texts.append(texts[4])

    def sharing(n):
        seen = {}
        for d, t in enumerate(texts):
            w = t.split()
            for i in range(len(w) - n + 1):
                seen.setdefault(tuple(w[i : i + n]), set()).add(d)
        return {d for docs in seen.values() if len(docs) > 1 for d in docs}

    rows = chunk_dedup.repeated_passages(documents(*texts)).collect()
    assert sharing(50) <= {r.doc_id for r in rows} <= sharing(chunk_dedup.RUN_WORDS) and len(sharing(50)) > 50
    for r in rows:
        passage = texts[r.doc_id].encode()[r.start : r.end]
        assert sum(passage in t.encode() for t in texts) > 1 and r.n_words >= chunk_dedup.RUN_WORDS
    kept = {texts[r.doc_id].encode()[r.start : r.end] for r in rows if r.kept}
    assert all(not r.kept or r.first_doc_id == r.doc_id for r in rows) and kept
    assert [r.kept for r in rows if r.doc_id == 120] == [False] and [r.kept for r in rows if r.doc_id == 4] == [True]


def test_cutting_leaves_one_copy(documents):
    rng = random.Random(4)
    passage = " ".join(prose(rng, 80))
    own = [" ".join(prose(rng, 60)) for _ in range(4)]
    docs = documents(*[f"{o} {passage} {o[:40]}é" for o in own], None)
    left = {r.doc_id: r.text for r in chunk_dedup.without_repeats(docs, chunk_dedup.repeated_passages(docs)).collect()}
    middle = passage[150:-150]
    assert middle in left[0] and not any(middle in left[i] for i in (1, 2, 3)) and left[4] is None
    assert all(own[i][:100] in left[i] and left[i].endswith("é") for i in range(4))


def test_a_copied_document_keeps_its_own_words_only(documents):
    rng = random.Random(6)
    before, passage, after = (" ".join(prose(rng, n)) for n in (150, 60, 150))
    whole = f"{before} {passage} {after}"
    docs = documents((3, passage), (10, whole), (500, whole))
    found = chunk_dedup.repeated_passages(docs)
    rows = sorted((r.doc_id, r.start, r.kept, r.first_doc_id) for r in found.collect())
    assert [(d, kept, first) for d, _, kept, first in rows if d == 10] == [(10, True, 10), (10, False, 3), (10, True, 10)]
    assert all(not kept for d, _, kept, _ in rows if d == 500) and all(kept for d, _, kept, _ in rows if d == 3)
    left = {r.doc_id: r.text for r in chunk_dedup.without_repeats(docs, found).collect()}
    middle = passage[150:-150]
    assert left[3] == passage and middle not in left[10] and middle not in left[500]
    assert left[10].startswith(before) and left[10].endswith(after) and len(left[500]) < 300


def test_cutting_loses_no_words(documents):
    rng = random.Random(7)
    p, q, r = (" ".join(prose(rng, n)) for n in (120, 50, 50))
    docs = documents((1, p), (2, f"{p} {q}"), (3, f"{r} {q} {p}"), (4, f"{p} {q}"), (None, f"{r} {q} {p}"))
    left = {r.doc_id: r.text for r in chunk_dedup.without_repeats(docs, chunk_dedup.repeated_passages(docs)).collect()}
    assert left[1] == p and left[2].endswith(q) and left[3].startswith(r)
    words = {w for t in left.values() for w in t.split()}
    assert set(f"{p} {q} {r}".split()) <= words
    assert all(len(left[i]) < 300 for i in (4, None))


def test_passages_on_awkward_rows(awkward, no_documents, documents):
    rows = chunk_dedup.repeated_passages(awkward).collect()
    assert {r.doc_id for r in rows} == {4}  # its own words come again
    assert chunk_dedup.repeated_passages(no_documents).count() == 0
    text = " ".join(prose(random.Random(5), 100))
    found = chunk_dedup.repeated_passages(documents((1, text), (1, text), (None, text), (2, "short"))).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in found) == [(0, False), (1, True)]
    same = chunk_dedup.without_repeats(awkward, chunk_dedup.repeated_passages(awkward))
    assert same.columns == awkward.columns and same.count() == 10


def toxic_rows(seed, n):
    rng = random.Random(seed)
    rude = ["idiot", "zorblax", "scum", "grumfle", "pathetic"]
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(15, 120))]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((i, " ".join(words)))
    return rows


def test_chain_learns_and_feeds_earlier_categories(spark, documents):
    rows = toxic_rows(1, 600)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    chain = toxicity.train(documents(*rows), labels)
    assert chain.categories[-1] == "toxic"
    n = len(chain.vocabulary)
    assert [len(w) for w in chain.weights] == [n + 1 + i for i in range(len(chain.categories))]
    other = toxic_rows(2, 400)
    flagged = {r.doc_id for r in toxicity.toxicity(documents(*other), chain).filter("flagged").collect()}
    truth = {i for i, _ in other if i % 5 == 0}
    assert len(flagged & truth) >= 0.95 * len(truth) and len(flagged - truth) <= 4
    x = chain.features([t for _, t in other[:20]])
    p = chain.probabilities(x)
    for i, row in enumerate(x):  # each model by hand, on words and on what came before
        before = []
        for w in chain.weights:
            z = row @ w[:n] + np.dot(before, w[n:-1]) + w[-1]
            before.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        assert np.allclose(before, p[i])


def test_out_of_fold_probabilities_are_less_sure_than_fitted_ones():
    rng = random.Random(8)
    texts = [" ".join(f"t{rng.randrange(60)}" for _ in range(20)) for _ in range(200)]
    y = np.array([rng.random() < 0.3 for _ in texts], float)
    chain = toxicity.fit_chain(texts, y)
    fitted = chain.probabilities(chain.features(texts))[:, -1]
    assert ((fitted >= 0.5) == (y > 0.5)).mean() < 1 or chain.threshold > 0


def test_words_chosen_in_tasks_equal_those_chosen_in_memory(spark, documents):
    rows = toxic_rows(5, 500)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    chain = toxicity.train(documents(*rows), labels)
    plain = toxicity.fit_chain([t for _, t in rows], np.array([i % 5 == 0 for i, _ in rows], float))
    assert chain.vocabulary == plain.vocabulary and chain.threshold == plain.threshold
    assert all(np.allclose(a, b) for a, b in zip(chain.weights, plain.weights)) and chain.held_out == plain.held_out


def test_kinds_follow_the_words_of_toxic_documents():
    rng = random.Random(6)
    kinds = [["kroll", "vantz", "brubb"], ["sneff", "plonk", "drimm"], ["quarg", "thweb", "yolfe"]]
    texts, truth = [], []
    for i in range(600):
        words = [f"w{rng.randrange(400)}" for _ in range(30)]
        if i % 4 == 0:
            truth.append(i // 4 % 3)
            words += rng.sample(kinds[truth[-1]], 2)
        texts.append(" ".join(words))
    y = np.array([i % 4 == 0 for i in range(600)], float)
    chain = toxicity.fit_chain(texts, y)
    p = chain.probabilities(chain.features(texts))
    named = np.argmax(p[y > 0][:, :-1], axis=1)
    pairs = {(int(a), b) for a, b in zip(named, truth)}
    assert len(pairs) == 3 and len({a for a, _ in pairs}) == 3
    assert p[y < 1][:, :-1].max() < 0.5
    for category in chain.categories:
        n, precision, recall = chain.held_out[category]
        assert n >= 50 and precision > 0.95 and recall > 0.95
    assert not toxicity.kinds_of(np.zeros((5, 4)), np.ones(5)).any() and toxicity.kinds_of(np.zeros((0, 0)), np.zeros(0)).shape == (0, 3)


def test_held_out_figures_show_what_fitted_ones_hide():
    rng = random.Random(8)
    texts = [" ".join(f"t{rng.randrange(60)}" for _ in range(20)) for _ in range(200)]
    y = np.array([rng.random() < 0.3 for _ in texts], float)
    chain = toxicity.fit_chain(texts, y)
    # Labels without a reason: what was fitted knows some of them, what was held out does not.
    x = chain.features(texts)
    fitted = chain.probabilities(x)[:, -1]
    n, precision, recall = chain.held_out["toxic"]
    assert n == y.sum() and ((fitted >= 0.5) & (y > 0)).sum() / n >= recall
    assert recall < 0.5


def test_toxicity_on_awkward_rows(awkward, no_documents, spark, documents):
    rows = toxic_rows(3, 100)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    chain = toxicity.train(documents(*rows), labels)
    scored = toxicity.toxicity(awkward, chain).collect()
    assert len(scored) == 10 and not any(r.flagged for r in scored)
    assert toxicity.toxicity(no_documents, chain).count() == 0
    empty = toxicity.train(documents(*rows), labels.limit(0))
    assert toxicity.toxicity(documents(*rows), empty).filter("flagged").count() == 0


def test_one_label_only(documents):
    chain = toxicity.fit_chain(["a b", "c d"], np.zeros(2))
    assert toxicity.toxicity(documents("a", None), chain).filter(F.col("flagged")).count() == 0
