"""Nulls that stand elsewhere, ids that repeat, very long texts, empty tables and columns with clashing names."""

import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import decontam, langid, mixing, quality, simhash

KINDS = "doc_id long, text string, lang string, source string"


def test_rows_that_differ_only_in_which_column_is_null(spark):
    rows = [(1, "a b c", "x", None), (1, "a b c", None, "x")] + [(2, "d e f g", "x", "y")] * 3
    docs = spark.createDataFrame(rows, KINDS)
    mixed = Counter((r.lang, r.source) for r in mixing.mix_documents(docs).collect())
    want = {s: t for s, _, t in (tuple(r) for r in mixing.source_targets(spark.createDataFrame([("x", 3), ("y", 12), (None, 3)], "source string, source_size long")).collect())}
    for (_, source), n in mixed.items():
        words = 4 if source == "y" else 3
        assert abs(n * words - want[source]) <= words, (source, n, want)
    assert set(mixed) <= {("x", None), (None, "x"), ("x", "y")} and sum(mixed.values()) > 3
    kept = simhash.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(150):
        rows.append((i, " ".join(rnd.choice(["river", "stone", "tree"]) for _ in range(9)), "en", "s"))
        if i % 2:
            rows.append((i, " ".join(rnd.choice(["BUY!!", "cash", "###"]) for _ in range(9)), "en", "s"))
        labels.append((i, i % 3 == 0 and 1 or 0, 0))
    rows += [(7, "again " * 5, "en", "s")] * 400 + [(10_000, "word " * 300_000, "en", "s")]
    docs, known = spark.createDataFrame(rows, KINDS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = quality.train(docs, known)
    rnd.shuffle(rows)
    two = quality.train(spark.createDataFrame(rows, KINDS).repartition(7), known)
    assert (one == two).all() and np.any(one)
    assert quality.classify(docs, known).count() == len(rows)
    assert quality.classify(docs.limit(0), known).count() == 0
    assert quality.shape("a1" * 20) != quality.shape("a1" * 21)


def test_language_of_chunks_counts_each_n_gram_once(monkeypatch):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abÉΣİ  .1\n") for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    whole = [langid.counts(t) for t in texts]
    for chunk in (1, 2, 5):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for t, want in zip(texts, whole, strict=True):
            got = langid.counts(t)
            assert (got is None) == (want is None) and (want is None or (got == want).all())
    assert whole[0] is None or whole[0].sum() > 0


def test_language_of_repeated_ids(spark):
    rows = [(i % 5, w, w[:2], "s") for i, w in enumerate(["la rivière", "the river", "la maison", "the house"] * 60)] + [(99, "the " * 400_000, None, "s")]
    docs = spark.createDataFrame(rows, KINDS)
    got = Counter(tuple(r) for r in langid.identify(docs).collect())
    assert got == Counter(tuple(r) for r in langid.identify(docs.repartition(5)).collect()) and sum(got.values()) == len(rows)
    assert langid.identify(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        langid.train(spark.range(3000).selectExpr("id as doc_id", "'a' as text", "cast(id as string) as lang"))


def test_decontamination_of_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "one two " * 200_000, "en", "s"), (1, "one two " * 200_000, "en", "s"), (2, None, None, None)], KINDS)
    bench = spark.createDataFrame([("i", "one two one"), ("j", "two two")], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[2].n_words) == (400_000, 399_999, 1, 0)
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    none = decontam.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == 3 and not any(r.contaminated for r in none)


def test_pipeline_of_odd_columns(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(3)
    words = "river stone tree house field water light road hill bird".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40)), "en", rnd.choice(["a", None]), i, "x", [1, None], None) for i in range(60)]
    rows += [(61, "long river " * 150_000, "en", "a", 0, "x", None, None), rows[3], rows[3]]
    kinds = KINDS + ", size long, row string, slot array<int>, `odd.name` string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "absent words only")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 0 and (name == "sharding" or docs.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes)
