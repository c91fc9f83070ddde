import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import boosting, quality_model, quality_rules, queries


def plain_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )


def test_counts_equal_plain_ones(documents):
    rng = random.Random(2)
    texts = [
        None, "", "a b c d", "a b c d e", "x " * 40, "a b c d e f a b c d e", "é ö # <b> | \U0001f600\x0b\x0cend",
        "same\nsame\n \nother\nsame", "no break space",
    ]
    texts += [" ".join(rng.choice("abcd") * rng.choice([1, 2]) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = quality_rules.quality_rules(documents(*texts)).collect()
    for r in rows:
        expected = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r.base_failed and r.kept)


def test_order_follows_rejections_per_cost_and_changes_no_verdict(documents):
    rng = random.Random(4)
    clean = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    loud = [" ".join(f"WORD{chr(65 + i % 26) * (i + 1)}" for i in range(12)) for _ in range(1)] * 1
    symbols = [" ".join(f"w{rng.randrange(10**6)}###" for _ in range(30)) for _ in range(15)]
    docs = documents(*clean, *loud, *symbols)
    order = quality_rules.rule_order(docs)
    assert order[0]["rule"].name == "symbols"
    scores = [f["rejected"] / f["cost"] for f in order]
    assert scores == sorted(scores, reverse=True)
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    other = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, tuple(reversed(quality_rules.RULES))).collect()}
    assert kept == other and [i for i in kept if kept[i]] == list(range(20))


def test_a_rejected_text_never_reaches_a_later_rule(documents):
    """A rule that fails when it is computed: texts rejected by the base or an earlier rule skip it."""
    trap = quality_rules.Rule("trap", lambda: F.raise_error(F.lit("reached")).cast("boolean"), lambda: F.lit(10**9))
    rules = (trap, *quality_rules.RULES)
    short = ["too short", None, "", "a b c d e " * 30]
    loud = [" ".join(f"W{i}###" for i in range(20, 60)) for _ in range(4)]
    fine = " ".join(f"word{i}" for i in range(40))
    counted = quality_rules.with_counts(documents(*short, *loud)).withColumn("base_failed", quality_rules._any(quality_rules.BASE))
    assert [r.base_failed for r in counted.orderBy("doc_id").collect()] == [True] * 4 + [False] * 4
    rows = quality_rules.quality_rules(documents(*short), rules).collect()
    assert {r.rejected_by for r in rows} == {"base"}
    with pytest.raises(Exception, match="reached"):
        quality_rules.quality_rules(documents(*short, fine), rules).collect()
    # Behind the others in the cascade, which all of these texts fail, the trap is not reached either.
    order = [f["rule"] for f in quality_rules.rule_order(documents(*short, *loud))]
    verdict = F
    for rule in (*order, trap):
        verdict = verdict.when(rule.rejects(), F.lit(rule.name))
    named = counted.filter("not base_failed").select(verdict.alias("by")).collect()
    assert {r.by for r in named} == {"symbols"}


def test_texts_reach_only_the_rules_that_need_them(documents):
    """Capitals and lines are counted inside the cascade and nowhere before it."""
    plan = quality_rules.quality_rules(documents("a b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[A-Z]" in plan and all("[A-Z]" not in line.split("CASE WHEN")[0] for line in plan.split("\n"))


def test_order_is_the_same_when_rows_repeat(documents):
    docs = documents(*["W### X### " * 8 + str(i) for i in range(30)])
    many = docs.union(docs).union(docs).repartition(5)
    figures = [[(f["rule"].name, f["rejected"], f["cost"]) for f in quality_rules.rule_order(d)] for d in (docs, many)]
    assert figures[0] == figures[1]


def test_rules_run_no_python(documents):
    plan = quality_rules.quality_rules(documents("a b"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_on_awkward_rows(awkward, no_documents):
    rows = quality_rules.quality_rules(awkward).collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 2
    assert all(r.base_failed for r in rows if r.n_words == 0)
    assert next(r for r in rows if r.doc_id == 4).n_words == 120_000
    assert quality_rules.quality_rules(no_documents).count() == 0


def test_trees_equal_a_walk_of_each_tree():
    rng = np.random.RandomState(0)
    x = np.column_stack([rng.rand(600), rng.randint(0, 4, 600), np.zeros(600)])
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] == 2)).astype(float)
    model = boosting.fit(x, y, rounds=30)
    assert ((model.probability(x) > 0.5) == (y > 0.5)).mean() > 0.97

    def walk(row):
        total = model.bias
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return total

    assert np.allclose(model.margin(x), [walk(row) for row in x])
    assert boosting.fit(x[:0], y[:0]).probability(x[:2]).tolist() == [0.5, 0.5]


@pytest.fixture
def labelled(spark, documents):
    rng = random.Random(6)
    good = [" ".join(f"word{rng.randrange(500)}" for _ in range(rng.randrange(20, 80))) + "." for _ in range(150)]
    bad = [" ".join(f"WORD{rng.randrange(500)}!!" for _ in range(rng.randrange(20, 80))) for _ in range(150)]
    docs = documents(*[t for pair in zip(good, bad) for t in pair])
    return docs, spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    train = labels.filter(~queries.held_out(F.col("doc_id")))
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in train.collect())
    scored = quality_model.quality_scores(docs, quality_model.train(docs, train))
    rows = scored.filter(queries.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 40 and all((r.score >= 0.7) == (r.doc_id % 2 == 0) for r in rows)


def test_model_ignores_ids_and_other_columns(labelled):
    docs, labels = labelled
    model = quality_model.train(docs, labels)
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit(1).alias("score"))
    a = {r.doc_id: r.score for r in quality_model.quality_scores(docs, model).collect()}
    b = {r.doc_id - 1000: r.score for r in quality_model.quality_scores(other, model).collect()}
    assert a == b


def test_model_on_awkward_rows(labelled, awkward, no_documents, spark):
    docs, labels = labelled
    model = quality_model.train(docs, labels)
    rows = quality_model.quality_scores(awkward, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.quality_scores(no_documents, model).count() == 0
    assert quality_model.keep_quality(awkward, model, 0.0).count() == 10
    unlabelled = spark.createDataFrame([(None, None), (1, None), (None, 1)], "doc_id long, quality int")
    assert quality_model.quality_scores(docs, quality_model.train(docs, unlabelled)).select("score").distinct().collect()[0][0] == 0.5


def test_statistics_of_edge_texts():
    for text in (None, "", "\x00", "\ud800x", "a" * 100_000, "\n\n.\n"):
        row = quality_model.statistics(text)
        assert len(row) == len(quality_model.FEATURES) and np.isfinite(row).all()
