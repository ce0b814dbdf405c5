"""Near-duplicates of the pipeline against all pairs by Jaccard similarity."""

import random
from collections import defaultdict

import pytest

from strandline.llm import minhash, simhash

KINDS = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("held", [2_000_000, 5])
def test_near_dedup_links_pairs_from_similarity(spark, monkeypatch, held):
    """Whole groups in one task, larger groups by bands, and bands in blocks of single sets."""
    import corpus_pipeline

    monkeypatch.setattr(minhash, "SHINGLES_HELD", held)

    rnd = random.Random(3)
    vocabulary = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([30, 100, 200]))]
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 7])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "ak"), (1003, " AK\t"), (None, rows[0][1]), rows[1]]
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                far += (simhash.fingerprint(rows[i][1]) ^ simhash.fingerprint(rows[j][1])).bit_count() > 4
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[root(i)].append(k)
    want = sorted(min(k for k in g if k is not None) for g in groups.values())
    kept = corpus_pipeline.first_of_near_duplicates(spark, spark.createDataFrame(rows, KINDS).repartition(3), "")
    assert far > 5 and sorted(r.doc_id for r in kept.collect()) == want


def test_spanning_keeps_chains_apart():
    sets = [minhash.shingle_set(" ".join(map(str, range(a, a + 60))), 5) for a in (0, 5, 10, 15, 200, 205, 400)]
    up = list(range(7))
    for a, b in minhash.spanning(list(range(7)), sets, 0.8):
        up = [up[a] if x == up[b] else x for x in up]
    assert up[0] == up[1] == up[2] == up[3] != up[4] == up[5] != up[6] and len(set(up)) == 3
