"""The pipeline's rows against a plain version of its stages on a small table."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import mixing, quality
from strandline.llm.common import row_key

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the river carried small boats past quiet villages while farmers worked in warm fields near old stone walls and children sang of summer".split()


def tables(spark, folder, n=160):
    rnd = random.Random(11)
    docs, labels = [], []
    item = " ".join(rnd.sample(GOOD, 14))
    for i in range(n):
        good = i % 4 != 0
        words = [rnd.choice(GOOD) for _ in range(rnd.choice([20, 60, 120]))] if good else ["$$$", "CLICK", "999", "!!!"] * rnd.randint(5, 20)
        if i % 17 == 1:
            words[5:5] = item.upper().split()
        docs.append([i, " ".join(words), "en", rnd.choice(["a", "b", None]), 1])
        labels.append((i, int(good), 0))
    for i in range(12):  # near and exact copies
        text = docs[5][1].split()
        if i % 2:
            text[i] = "other"
        docs.append([n + i, " ".join(text), "en", "b", 1])
    docs[9][1] = None
    docs[13][1] = ""
    docs.append(list(docs[14]))
    docs.append([None, " ".join(rnd.choice(GOOD) for _ in range(50)), None, None, None])
    spark.createDataFrame([tuple(d) for d in docs], KINDS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "absent")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def key(row):
    return tuple((v is None, v) for v in row)


def one_of_each(rows):
    sets, up = [shingles(r.text) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) / len(a | b) >= 0.8:
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return list(groups.values())


def holds_item(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    words, windows = find(text), set()
    for t in items:
        v = find(t)
        windows |= {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9) if v else 0)}
    return any(tuple(words[a : a + len(w)]) == w for w in windows for a in range(len(words) - len(w) + 1))


def mixed(spark, docs, slots=mixing.SLOTS):
    """How often each row comes in the mix, rows without words left out."""
    hashed = docs.select(
        "*",
        row_key(docs)["a"].alias("__a"),
        row_key(docs)["b"].alias("__b"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("__n"),
    ).collect()
    copies, laid = Counter(), []
    for r in hashed:
        copies[r["__a"], r["__b"]] += 1
        laid.append((r.source, r["__n"] or 0, r["__a"], r["__b"], copies[r["__a"], r["__b"]], tuple(r)[: len(docs.columns)]))
    order = spark.createDataFrame([(i, *x[:5]) for i, x in enumerate(laid)], "i int, source string, size long, a long, b long, copy int")
    row = F.struct("a", "b")
    places = {r.i: r.h for r in order.select("i", F.xxhash64("source", "size", row, "copy").alias("h")).collect()}
    sizes = Counter()
    for x in laid:
        sizes[x[0]] += x[1]
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    total = sum(sizes.values())
    block = max(1, -(-total // slots))
    edges, at = [], 0.0
    for s in [s for s in names if target[s] > 0]:
        at += target[s]
        edges.append((at / sum(target.values()), s))
    edges[-1] = (1.0, edges[-1][1])
    drawn, takes = Counter(), Counter()
    for i in range(-(-total // block)):
        u = (i * mixing.GOLDEN % (1 << 52)) / (1 << 52)
        s = next(s for hi, s in edges if u < hi)
        blocks = -(-sizes[s] // block)
        if drawn[s] < 3 * blocks:
            takes[s, drawn[s] % blocks] += 1
        drawn[s] += 1
    runs, start, out = max(1, len(laid) // mixing.ROWS_PER_RUN), Counter(), Counter()
    for i in sorted(range(len(laid)), key=lambda i: (places[i] % runs, places[i], key(laid[i][:5]))):
        s, n, *_, whole = laid[i]
        if n:
            out[whole] += takes[s, start[s] // block]
        start[s] += n
    return out


def shard_of(doc_id, shards):
    def cost(k):
        h = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", k), h)
        return -math.log(((h >> 11) + 0.5) / (1 << 53))

    return min(range(shards), key=cost)


@pytest.mark.filterwarnings("ignore")
def test_pipeline_equals_plain_version(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cols, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = (before.collect(), docs.collect(), before)
        assert name == "sharding" or docs.columns == cols

    rows, kept, before = seen["quality"]
    scores = quality.classify(before, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    good = {r.doc_id for r in scores if r.predicted}
    assert Counter(map(key, kept)) == Counter(key(r) for r in rows if r.doc_id in good)
    assert all(r.doc_id % 4 for r in kept if r.doc_id is not None and r.doc_id < 160)
    assert sum(r.doc_id is not None and r.doc_id < 160 and r.doc_id % 4 != 0 and bool(r.text) for r in kept) >= 110

    rows, kept, _ = seen["near_dedup"]
    groups = one_of_each(rows)
    assert len(kept) == len(groups) and max(map(len, groups)) > 5
    firsts = Counter(min((r.doc_id for r in g if r.doc_id is not None), default=None) for g in groups)
    assert Counter(r.doc_id for r in kept) == firsts

    rows, kept, _ = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert Counter(map(key, kept)) == Counter(key(r) for r in rows if not holds_item(r.text, items))
    assert len(kept) < len(rows)

    _, kept, before = seen["mixing"]
    want = +mixed(spark, before)
    assert Counter(tuple(r) for r in kept if re.search(r"[^\x20\x09-\x0D]", r.text or "")) == want
    coarse = mixing.mix_documents(before, slots=90).collect()
    assert Counter(tuple(r) for r in coarse if re.search(r"[^\x20\x09-\x0D]", r.text or "")) == +mixed(spark, before, 90)

    rows, out, _ = seen["sharding"]
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.grown_shard) == (shard_of(r.doc_id, 40), shard_of(r.doc_id, 41))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    raw = lambda r: (r.text or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r.doc_id, len(raw(r)) + 16, zlib.crc32(raw(r))) for r in rows)
    again = corpus_pipeline.run(spark, folder)
    assert Counter(map(key, again.collect())) == Counter(map(key, out))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], KINDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
