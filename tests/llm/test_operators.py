"""The corpus operators against brute force on small tables with nulls, empty texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import decontam, exact_dedup, html_extract, langid, mixing, quality, sharding, simhash, suffix_dedup, tokens
from strandline.llm.suffix_array import lcp_array, suffix_array

KINDS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string"


def corpus(spark, n=120, seed=5):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + rnd.choice(["ing", "tion", "é", "x"]) for _ in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 40, 150])))
        rows.append([i, text, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", None, "é"]), 0, 1, "x"])
    rows[3][1] = None
    rows[4][1] = ""
    rows[5][1] = " \t\n "
    rows[6][1] = rows[7][1]
    rows[8] = list(rows[9])
    rows[10][0] = None
    rows[11][1] = rows[12][1].replace(" ", "\t \n")
    rows[13][1] = "long " * 20_000
    return spark.createDataFrame([tuple(r) for r in rows], KINDS)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).cache()


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = {r.doc_id: r for r in rows}
    for d in docs.filter("doc_id is not null").collect():
        raw = (d.text or "").encode()
        assert sizes[d.doc_id].size == len(raw) + 16 and sizes[d.doc_id].text_crc32 == zlib.crc32(raw)
    more = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 41).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in rows)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    heavy = sharding.assign(spark.range(4000), "id", [1.0, 3.0]).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 4000 for r in heavy}
    assert abs(share[1] - 0.75) < 0.04


def test_mixing(spark, docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(rows, key=str) == sorted(mixing.mix_report(docs.repartition(3)).collect(), key=str)
    source = {r.doc_id: r.source for r in docs.collect()}
    total, taken, size = sum(r.size for r in rows), Counter(), {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", next((d.text or "") for d in docs.collect() if d.doc_id == r.doc_id))) or r.doc_id == 9
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] = (r.source_size, r.target)
    names = sorted(x for x in size if x) + [None]
    open_, target, w = dict(zip(names, (5, 2, 1, 5), strict=True)), {}, total
    while True:
        level = w / sum(open_.values())
        over = [s for s, x in open_.items() if x * level > 3 * size[s][0]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s][0]
            w -= target[s]
            del open_[s]
    target |= {s: x * level for s, x in open_.items()}
    for s in names:
        assert size[s][1] == pytest.approx(target[s])
        assert abs(taken[s] - target[s]) <= 0.02 * total
    assert mixing.mix_report(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_exact_dedup(spark, docs, tmp_path):
    path = str(tmp_path / "d.parquet")
    docs.repartition(3).write.parquet(path)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    for digest in (exact_dedup.sha256, weak):
        rows = exact_dedup.exact_dedup(spark, path, digest, files_per_batch=1).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
        assert sum(r.kept for r in rows) == len(groups)
    docs.limit(0).write.parquet(str(tmp_path / "e.parquet"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "e.parquet")).count() == 0


def test_decontamination(spark, docs):
    long = [r.text for r in docs.collect() if r.text and len(r.text.split()) > 30]
    items = [(1, " ".join(long[0].split()[5:17]).upper()), (2, long[1].split()[0]), (3, None), (4, "..."), (None, " ".join(long[2].split()[:10])), (5, "nowhere to be found at all here in this table of words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for size in (1 << 20, 20):
        for r in decontam.decontaminate(docs, bench, table_bytes=size).collect():
            d = next(x for x in docs.collect() if x.doc_id == r.doc_id)
            w, hit, ids = split(d.text), set(), set()
            for i, t in items:
                v = split(t)
                for k in range(max(1, len(v) - 9) if v else 0):
                    p = v[k : k + 10]
                    for a in range(len(w) - len(p) + 1):
                        if w[a : a + len(p)] == p:
                            hit |= set(range(a, a + len(p)))
                            ids.add("null" if i is None else str(i))
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_simhash(spark, docs):
    rnd = random.Random(1)
    base = next(r.text for r in docs.collect() if r.text and len(r.text.split()) > 120).split()
    near = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(len(w))] = "changed"
        near.append((1000 + i, " ".join(w), "en", "a", 0, 1, "x"))
    both = docs.unionByName(spark.createDataFrame(near, KINDS))
    rows = simhash.near_duplicates(both).collect()
    fps = [int(r.fingerprint, 16) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), 1 << 60), r.doc_id)
    assert all(least.get(root(i)) == r.component_id for i, r in enumerate(rows)) and len(rows) == both.count()
    kept = simhash.keep_first(both)
    assert kept.columns == both.columns and kept.count() == len({root(i) for i in range(len(rows))})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_golay_keys_cover_four_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 500, dtype=np.int64)
    b = a.copy()
    for i in range(500):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    x, y = defaultdict(set), defaultdict(set)
    for v, to in ((a, x), (b, y)):
        for k, p in zip(*simhash.keys(v), strict=True):
            to[p].add(k)
    assert all(x[i] & y[i] for i in range(500))


def test_suffix_array():
    rnd = random.Random(2)
    for _ in range(800):
        s = [rnd.randint(1, rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 40))] + [0]
        sa = suffix_array(s)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = lcp_array(s, sa)
        for k in range(1, len(s)):
            n = lcp[k]
            assert s[sa[k] : sa[k] + n] == s[sa[k - 1] : sa[k - 1] + n] and s[sa[k] + n : sa[k] + n + 1] != s[sa[k - 1] + n : sa[k - 1] + n + 1]


@pytest.mark.parametrize("contexts", [16384, 2])
def test_suffix_dedup(spark, docs, monkeypatch, contexts):
    """Against all 400-byte strings, with the very long text, many rows that repeat, and groups that are dealt until one place is left."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    extra = next(r.text for r in docs.collect() if r.text and len(r.text) > 600)
    rnd = random.Random(5)
    noise = [" ".join(rnd.choice(["stone", "river", "cloud", "tree", "path"]) + str(rnd.randint(0, 9999)) for _ in range(70)) for _ in range(12)]
    odd = [(500, "before " + extra[100:550] + " after", "en", "a", 0, 1, "x"), (501, "ab" * 700, "en", "a", 0, 1, "x"), (502, "zz " + extra[90:495], "en", "a", 0, 1, "x")]
    odd += [(510 + i, noise[i] + extra[40 + 9 * i : 460 + 17 * i] + noise[i][::-1], "en", "a", 0, 1, "x") for i in range(12)]
    odd += [(530, noise[0] + "copy", "en", "a", 0, 1, "x")] * 1000
    few = docs.unionByName(spark.createDataFrame(odd, KINDS))
    texts = [(r.doc_id, (r.text or "").encode()) for r in few.collect()]
    times = Counter(texts)
    n = Counter()
    for (_, b), t in times.items():
        for k in range(len(b) - 399):
            n[xxhash.xxh3_128_digest(b[k : k + 400])] += t
    want = Counter()
    for (i, b), t in times.items():
        m, end = bytearray(len(b)), 0
        for k in range(len(b)):
            if k + 400 <= len(b) and n[xxhash.xxh3_128_digest(b[k : k + 400])] > 1:
                end = k + 400
            m[k] = k < end
        runs = sum(m[k] and not (k and m[k - 1]) for k in range(len(m)))
        want[i, len(b), sum(m), runs, hashlib.sha256(bytes(v for v, f in zip(b, m, strict=True) if not f)).hexdigest()] += t
    assert max(len(b) for _, b in texts) >= 100_000 and sum(k[2] > 0 for k in want) > 10
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeats(few).collect()) == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_repeated_strings_of_contexts():
    """The span of each context against all its strings, over all places and over stretches of them."""
    rnd = random.Random(6)
    for turn in range(60):
        base = [bytes(rnd.choice(b"ab") for _ in range(620)) for _ in range(2)]
        contexts = []
        for _ in range(rnd.randint(2, 9)):
            whole = bytearray(rnd.choice(base))
            whole[200:400] = base[0][200:400]
            for at in (rnd.randint(0, 215), rnd.randint(400, 619)):
                whole[at] ^= rnd.choice([0, 3])
            left = rnd.choice([200, 200, rnd.randint(0, 200)])
            contexts.append((bytes(whole[200 - left : rnd.choice([600, 600, rnd.randint(400, 600)])]), left, rnd.choice([1, 1, 1, 2])))
        contexts = list({c[:2]: c for c in contexts}.values())
        lo, hi = (0, 200) if turn % 2 else sorted(rnd.sample(range(201), 2))
        n = Counter()
        for c, a, t in contexts:
            for k in range(lo, min(hi, a) + 1):
                if len(c) >= a - k + 400:
                    n[k, c[a - k : a - k + 400]] += t
        want = []
        for c, a, _ in contexts:
            ks = [k for k in range(lo, min(hi, a) + 1) if len(c) >= a - k + 400 and n[k, c[a - k : a - k + 400]] > 1]
            want.append((-max(ks), 400 - min(ks)) if ks else None)
        assert suffix_dedup.repeats(contexts, lo, hi) == want


def test_token_counts(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    path = str(P.path("piece_bpe_32k.model"))
    sp = tokens.processor(path)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = tokens.count_tokens(docs, path, table=50).collect()
    assert len(rows) == docs.count()
    assert all(r.n_tokens == len(sp.encode(text[r.doc_id])) and r.n_bytes == len(text[r.doc_id].encode()) for r in rows)
    rnd = random.Random(1)
    for _ in range(500):
        s = "".join(rnd.choice(["a", "b ", "  ", "\n", "▁", " of", "é", "\0", "<s>", "x" * 70]) for _ in range(rnd.randint(0, 12)))
        assert sum(1 if p == "" else len(sp.encode(p)) for p in tokens.pre_tokens(s)) == len(sp.encode(s))
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_html(spark):
    page = """<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><header>Top</header><nav><a>m</a></nav>
    <article><h1>Head &amp; line</h1><div class="ad">buy</div><p>One  two
    three.<p>Sh&eacute;.</p><ul><li>a<li>b</ul><aside>side</aside></article><div id="comments"><p>I think that this is long enough to be read.</p></div><footer>f</footer>"""
    assert html_extract.main_text(page) == "Head & line\nOne two three.\nShé.\na\nb"
    plain = "<body><div class='menu'>x</div><div><p>A first paragraph of some length here.</p><p>Yes.</p><p>And the last of the paragraphs here.</p></div></body>"
    assert html_extract.main_text(plain).split("\n")[1] == "Yes."
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", "<p>", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].n_chars == len(got[1].text) and [got[i].text for i in (2, 3, 4)] == ["", "", ""]


def test_quality_and_language(spark):
    rnd = random.Random(4)
    good, bad = ["the river runs", "a house stands", "we walk home"], ["BUY!! NOW!!", "###$$$ %%%", "WIN!! CASH!!"]
    fr = ["la rivière coule", "une maison est là", "nous rentrons chez nous"]
    rows, labels = [], []
    for i in range(400):
        kind = i % 3
        text = " ".join(rnd.choice((good, bad, fr)[kind]) for _ in range(rnd.randint(3, 12)))
        rows.append((i, text, None if i % 50 == 0 else "fr" if kind == 2 else "en", "s", 0, 1, "x"))
        labels.append((i, 0 if kind == 1 else 1, 0))
    rows += [(None, None, None, None, None, 1, "x"), (1000, "", "en", "s", 0, 1, "x"), (1001, "123 !!", "en", "s", 0, 1, "x")]
    docs = spark.createDataFrame(rows, KINDS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, lab).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality.classify(docs, lab.limit(0)).agg(F.max("score")).first()[0] == 0.5
    assert quality.keep_good(docs, lab).columns == docs.columns
    lang = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert lang[None].lang_pred == lang[1000].lang_pred == lang[1001].lang_pred == "und"
    true = {r[0]: r[2] for r in rows if r[2] and r[0] is not None and r[0] < 400 and r[0] % 3 != 1}
    held = [i for i in true if lang[i].held_out]
    assert held and sum(lang[i].lang_pred == true[i] for i in held) / len(held) > 0.9
    n, df = langid.document_frequencies(docs.repartition(20))
    found = [c for c in (langid.counts(r[1]) for r in rows) if c is not None]
    assert n == len(found) and (df == sum(c > 0 for c in found)).all()
    assert langid.document_frequencies(docs.limit(0))[0] == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
