"""Small sources beside a large one are taken as their targets say."""

from collections import Counter

import pytest

from strandline.llm import mixing


def test_small_sources_meet_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 2000)  # blocks of the large source then have 155 words
    sizes = {"a": 300_000, "b": 200, "c": 6_000, "d": 1_000, "e": 30}
    rows = []
    for source, n in sizes.items():
        each = 100 if n >= 1000 else 10
        rows += [(len(rows) + i, " ".join(["w"] * each), source) for i in range(n // each)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    source = {k: s for k, _, s in rows}
    got = mixing.mix_report(docs).collect()
    taken, target, words = Counter(), {}, Counter()
    for r in got:
        assert r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    for r in mixing.mix_documents(docs).collect():
        words[r.source] += len(r.text.split())
    for s, n in sizes.items():
        assert taken[s] == pytest.approx(target[s], rel=0.01, abs=4), s
        assert words[s] == pytest.approx(target[s], rel=0.02, abs=2 * max(100 if n >= 1000 else 10, 4)), s
