"""The SimHash step of the pipeline's near-duplicate stage."""

import random

from strandline.llm import minhash, simhash

KINDS = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_simhash_links_are_candidates_and_sets_decide(spark, monkeypatch):
    """Without a band in common, pairs within 4 bits link if their sets are similar; repeats make fingerprints equal, not sets."""
    import corpus_pipeline

    monkeypatch.setattr(minhash, "bands", lambda shingles: [])
    rnd = random.Random(8)
    vocabulary = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for _ in range(8):
        base = [rnd.choice(vocabulary) for _ in range(600)]
        for cut in (0, 1, 2):
            rows.append((len(rows), " ".join(base[: len(base) - cut])))
    near = []
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            bits = (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count()
            assert minhash.fingerprint_of(minhash.shingle_hashes(a, 5)) == simhash.fingerprint(a, 5)
            if bits <= 4 and len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
                near.append((i, j))
    assert {i for i, _ in near} == {k for k in range(24) if k % 3}
    often = "p q r s t " * 60
    rows += [(100 + k, often + " ".join(rnd.choice(vocabulary) for _ in range(30))) for k in range(2)] + [(200, None), (201, "")]
    assert simhash.fingerprint(rows[-4][1], 5) == simhash.fingerprint(rows[-3][1], 5)
    kept = corpus_pipeline.first_of_near_duplicates(spark, spark.createDataFrame(rows, KINDS).repartition(3), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 24, 3), 100, 101, 200]
