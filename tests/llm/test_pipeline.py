import random

import pytest

import corpus_pipeline
from riskloom.llm import decontaminate, minhash, packing, queries, secret_scan


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("tables"))
    words = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    items = [words(30) for _ in range(5)]
    rows = []
    for i in range(240):
        text = words(rng.randrange(30, 120)) + "."
        if i % 4 == 0:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif i % 20 == 1:
            text = f"{text} {items[i % 5]} {words(10)}"
        elif i % 20 == 2:
            text = f'{text} token = "{i:040x}" {words(5)}'
        elif i % 20 == 3 and rows:
            text = rows[-1][1] + " tail"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 240) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages_and_run(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
    kept = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], folder)
        out.write.parquet(f"{folder}/stage{n}")
        kept.append(spark.read.parquet(f"{folder}/stage{n}"))
        if n < 4:
            assert kept[-1].columns == docs.columns
    text = {i: t for i, t, *_ in rows}
    ids = [{r.doc_id for r in k.select("doc_id").distinct().collect()} for k in kept]
    assert ids[1] == {i for i in text if i % 4}
    groups = minhash.near_duplicates(kept[1]).collect()
    assert ids[2] == {r.doc_id for r in groups if r.kept} and len(ids[2]) < len(ids[1])
    dirty = {r.doc_id for r in decontaminate.contaminated(kept[2], spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert dirty and ids[3] == ids[2] - dirty == {i for i in ids[2] if i % 20 != 1}
    masked = {r.doc_id: r for r in kept[4].collect()}
    assert masked.keys() == ids[3]
    for i, r in masked.items():
        assert r.text == secret_scan.mask(text[i]) and r.n_chars == len(r.text)
    assert any("[secret]" in r.text for r in masked.values())
    assert ids[5] == ids[4]
    expected = packing.pack(kept[4], queries.tokenizer_path())
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == expected.columns
    assert whole.select(columns).exceptAll(expected.select(columns)).count() == 0 and whole.count() == expected.count()


@pytest.mark.parametrize("labels", [[], [(None, 1, 0), (1, None, 0)], [(10**6, 1, 0), (10**6 + 4, 0, 0)], [(i, 0, 0) for i in range(60)]])
def test_without_usable_labels_nothing_is_dropped_for_quality(spark, tables, tmp_path, labels):
    folder, rows = tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    if not labels:
        assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() > 150


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert entry.oracle_sql().keys() <= names.keys()
