"""Removal of long byte strings that occur again anywhere, by suffix arrays of aligned contexts.

A string of LENGTH bytes holds WINDOW starts of GRAM-byte strings. Those whose hash is least among WINDOW
consecutive ones are anchors, and which they are depends on those bytes alone: wherever a long string occurs,
it holds the same anchors at the same places. So occurrences meet by the hash of an anchor, and all that can
repeat around an anchor lies in its context, the LENGTH - GRAM bytes before and the LENGTH bytes from it on.

Contexts that are equal meet as one class with a count before any bytes move. An anchor with one class needs
no bytes at all. Of others, one context of each class is read. A suffix array (see suffix_array) over the
contexts' words, cut in step with the anchor, finds which go on alike for as many words as a long string
must share; exact comparison of the bytes then says which strings repeat.

One task compares the contexts of one group. An anchor with very many classes is dealt to several groups: one
for each stretch of places where strings may start, and for what all strings that start there have in common.
In a group, contexts that are alike in all that matters there stand for each other. Groups that are still large
are dealt again; a group of a single place holds one string. So no group lands in one task, and all groups are
compared in the same way.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, map_texts, release, written
from strandline.llm.suffix_array import lcp_array, suffix_array

#: Bytes of a repeated string, bytes of an anchor, and starts of anchors in a string.
LENGTH, GRAM = 400, 200
WINDOW = LENGTH - GRAM + 1

#: Bytes of a symbol of the suffix array; a string shares so many whole symbols wherever it starts.
SYMBOL = 32
SHARED = (LENGTH - SYMBOL + 1) // SYMBOL

#: Contexts that one task compares as one group, some 10 MB of bytes and 100 MB with their suffix array.
CONTEXTS = 16_384

#: Stretches that the places of a group that is too large are parted into.
FAN = 6

_P = 0x9E3779B97F4A7C15 | 1


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    up, down = np.full(n + 1, _P, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each w consecutive values."""
    n = len(x)
    pad = -n % w
    edge = np.uint64(0xFFFFFFFFFFFFFFFF) if f is np.minimum else np.uint64(0)
    y = np.concatenate([x, np.full(pad, edge)]).reshape(-1, w)
    left = f.accumulate(y, 1).ravel()
    right = f.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return f(right[: n - w + 1], left[w - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a text; none if it is shorter than a long string."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = 1 << max(12, (n + 1).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n])])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    w = length - gram + 1
    least = _sliding(h, w, np.minimum)
    most = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(most, w, np.maximum) == h)
    return at, h[at].view(np.int64)


def _context(text: bytes, at: int) -> tuple[int, bytes]:
    """(place, bytes) of all that can repeat with the anchor."""
    lo = max(0, at - (LENGTH - GRAM))
    return lo, text[lo : at + LENGTH]


def _anchored(docs: DataFrame) -> DataFrame:
    """Of each row its key, and of its anchors the hashes, classes and places."""

    def make():
        from xxhash import xxh3_64_intdigest

        def one(text):
            raw = (text or "").encode()
            at, h = anchors(raw)
            c = np.zeros(len(at), np.int64)
            for k, a in enumerate(at.tolist()):
                lo, ctx = _context(raw, a)
                c[k] = xxh3_64_intdigest(ctx, a - lo) - (1 << 63)
            return len(raw), h, c, at.astype(np.int32)

        return lambda texts: list(zip(*map(one, texts), strict=True)) if texts else [[]] * 4

    return map_texts(docs, "n_bytes long, h array<long>, c array<long>, at array<int>", make, carry=("ra", "rb"))


def _runs(contexts: list[tuple[bytes, int, int]]) -> dict[int, list[list[int]]]:
    """Of each place j, in symbols from the anchor, the lists of contexts that share SHARED symbols from there on.

    Symbols that one context alone has part the contexts into stretches. Contexts with one stretch at one place
    share a row of the suffix array over all stretches; neighbours in it that go on alike make a list.
    """
    names: dict[bytes, int] = {}
    seen: list[int] = []
    cut_up = []
    for c, a, _ in contexts:
        first = -(a // SYMBOL)
        ids = []
        for at in range(a + SYMBOL * first, len(c) - SYMBOL + 1, SYMBOL):
            w = names.setdefault(c[at : at + SYMBOL], len(names))
            if w == len(seen):
                seen.append(0)
            seen[w] += 1
            ids.append(w)
        cut_up.append((first, ids))
    owners: dict[tuple, list[int]] = defaultdict(list)
    for x, (first, ids) in enumerate(cut_up):
        begin = 0
        for k in range(len(ids) + 1):
            if k == len(ids) or seen[ids[k]] < 2:
                if k - begin >= SHARED:
                    owners[first + begin, tuple(ids[begin:k])].append(x)
                begin = k + 1
    found: dict[int, list[list[int]]] = defaultdict(list)
    if not owners:
        return found
    ends = len(owners)
    s: list[int] = []
    at: list[tuple[int, list[int]]] = []
    for k, ((first, ids), xs) in enumerate(owners.items()):
        s += [w + ends for w in ids]
        s.append(ends - 1 - k)  # an end of its own, the last the least
        at += [(j, xs) for j in range(first, first + len(ids) + 1)]
    sa = suffix_array(s)
    lcp = lcp_array(s, sa) + [0]
    k, room = 0, len(s)
    while k < room:
        e = k + 1
        while lcp[e] >= SHARED:
            e += 1
        if e == k + 1:
            j, xs = at[sa[k]]
            if len(xs) > 1 and sa[k] + SHARED <= room and min(s[sa[k] : sa[k] + SHARED]) >= ends:
                found[j].append(xs)
        else:
            alike = defaultdict(list)
            for i in sa[k:e]:
                j, xs = at[i]
                alike[j] += xs
            for j, xs in alike.items():
                if len(xs) > 1:
                    found[j].append(xs)
        k = e
    return found


def _meet(contexts: list[tuple[bytes, int, int]], xs: list[int], j: int, lo: int, hi: int, known: dict[int, int], down: bool) -> None:
    """For each of xs, which share the run from place j on, the most (``down``) or least bytes before the anchor, from
    ``lo`` to ``hi``, from where another one of them has the same string, put into ``known``.

    Contexts alike around the run stand for each other. The others go on together as long as they share what all
    strings from ``near`` to ``far`` have in common, the preferred half first.
    """
    m, r = SYMBOL * j, SYMBOL * (j + SHARED)
    alike: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for x in xs:
        c, a, _ = contexts[x]
        alike[c[max(0, a - hi) : a + m], c[a + r : a - lo + LENGTH]].append(x)
    alone = []
    for group in alike.values():
        alone.append(group[0])
        if len(group) > 1:
            c, a, _ = contexts[group[0]]
            near, far = max(lo, LENGTH - len(c) + a), min(hi, a)
            if near <= far:
                for x in group:
                    known.setdefault(x, far if down else near)
    stack = [(alone, lo, hi)]
    while stack:
        xs, near, far = stack.pop()
        if len(xs) < 2 or all(x in known for x in xs):
            continue
        same: dict[bytes, list[int]] = {}
        for x in xs:
            c, a, _ = contexts[x]
            if near <= a and len(c) >= a - far + LENGTH:
                text = c[a - near : a + m] + c[a + r : a - far + LENGTH]  # what lies between is the shared run
                if text in same:
                    same[text].append(x)
                else:
                    same[text] = [x]
        for group in same.values():
            if len(group) > 1:
                if near == far:
                    for x in group:
                        known.setdefault(x, near)
                else:
                    half = (near + far) // 2
                    low, high = (group, near, half), (group, half + 1, far)
                    stack += [low, high] if down else [high, low]


def repeats(contexts: list[tuple[bytes, int, int]], lo: int = 0, hi: int = LENGTH - GRAM) -> list[tuple[int, int] | None]:
    """Of contexts (bytes, place of the anchor, count) of one anchor: the span, from the anchor, of their strings
    that start from ``lo`` to ``hi`` bytes before it and occur in another context, or in several rows of the own
    class; one span at most, as all those strings hold the anchor.

    The suffix array says which contexts share whole symbols. Of those, the bytes decide: the first and the last
    string of each context that another one has at the same place from the anchor.
    """
    runs = _runs(contexts)
    begin: dict[int, int] = {}
    end: dict[int, int] = {}
    for known, places, down in ((begin, sorted(runs), True), (end, sorted(runs, reverse=True), False)):
        for j in places:
            # strings that start less than a symbol before place j
            near, far = max(-SYMBOL * j, lo), min(SYMBOL - 1 - SYMBOL * j, hi)
            for xs in runs[j]:
                if near <= far and not all(x in known for x in xs):
                    _meet(contexts, xs, j, near, far, known, down)
    out: list[tuple[int, int] | None] = []
    for x, (c, a, n) in enumerate(contexts):
        far, near = min(hi, a), max(lo, LENGTH - len(c) + a)
        if n > 1 and near <= far:
            out.append((-far, LENGTH - near))
        else:
            out.append((-begin[x], LENGTH - end[x]) if x in begin else None)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _compare(batches):
    """Spans of classes from rows (h, lo, hi, shared, c, n, ctx, a) sorted by the first four and c; a class that comes twice counts once."""
    group: list[tuple] = []

    def done():
        if len(group) > 1:
            spans = repeats([(r[6], r[7], r[5]) for r in group], *group[0][1:3])
            rows = [(r[0], r[4], *x) for r, x in zip(group, spans, strict=True) if x]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "c", "a", "b"])

    for b in batches:
        for row in zip(*[col.to_pylist() for col in b.columns], strict=True):
            if group and row[:4] != group[0][:4]:
                yield from done()
                group = []
            if not group or row[4] != group[-1][4]:
                group.append(row)
    yield from done()


def _dealt(batches):
    """(h, c, n, lo, hi, shared, own, a, b) from (h, c, n, ctx, a, lo, hi): for each stretch of places lo to hi before the anchor
    that has room for a string, a digest of what its strings have in common, one of all that they hold, and where that lies."""
    from xxhash import xxh3_128_digest

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
    names = ["h", "c", "n", "lo", "hi", "shared", "own", "a", "b"]
    for batch in batches:
        out = []
        for h, c, n, ctx, a, lo, hi in zip(*[col.to_pylist() for col in batch.columns], strict=True):
            step = -(-(hi - lo + 1) // FAN)
            for near in range(lo, hi + 1, step):
                far = min(near + step - 1, hi)
                first, last = max(near, LENGTH - len(ctx) + a), min(far, a)
                if first <= last:
                    # strings of a context that ends early start in fewer places: those share more than they must
                    text = ctx[a - last : a - first + LENGTH]
                    shared = ctx[a - near : a - far + LENGTH]
                    out.append((h, c, n, near, far, xxh3_128_digest(shared), xxh3_128_digest(text, far - last), -last, LENGTH - first))
        for k in range(0, len(out), 10_000):
            cols = zip(*out[k : k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=names)


def class_contexts(known: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, c, n, ctx, a, classes): the context of one row of each class, and the anchor's place in it.

    ``known`` has (h, c, n, ra, rb, at, classes) of one row of each class, ``texts`` (ra, rb, text). Rows that repeat
    follow each other and are read once, but where Spark parts them for size.
    """

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        before = None
        for b in batches:
            rows = []
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if key == before:
                    continue
                before = key
                raw = (b.column(2)[i].as_py() or "").encode()
                for x in b.column(3)[i].as_py():
                    lo, ctx = _context(raw, x["at"])
                    rows.append((x["h"], x["c"], x["n"], ctx, x["at"] - lo, x["classes"]))
            for k in range(0, len(rows), 5000):
                cols = zip(*rows[k : k + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], names=["h", "c", "n", "ctx", "a", "classes"])

    wanted = known.groupBy("ra", "rb").agg(F.collect_list(F.struct("h", "c", "n", "at", "classes")).alias("wanted"))
    return texts.join(wanted, ["ra", "rb"]).select("ra", "rb", "text", "wanted").mapInArrow(run, "h long, c long, n long, ctx binary, a int, classes long")


def class_spans(contexts: DataFrame) -> DataFrame:
    """(h, c, a, b): what repeats around the anchors with several classes; a class may have several spans that overlap."""
    group = ["h", "lo", "hi", "shared"]
    cols = [*group, "c", "n", "ctx", "a"]
    whole = contexts.select("h", F.lit(0).alias("lo"), F.lit(LENGTH - GRAM).alias("hi"), F.lit(b"").alias("shared"), "c", "n", "ctx", "a", "classes")
    ready = whole.filter(F.col("classes") <= CONTEXTS).select(*cols)
    large = whole.filter(F.col("classes") > CONTEXTS)
    texts = None
    own = contexts.filter((F.col("classes") > CONTEXTS) & (F.col("n") > 1) & (F.octet_length("ctx") >= LENGTH))
    found = own.select("h", "c", (-F.col("a")).alias("a"), (F.octet_length("ctx") - F.col("a")).cast("int").alias("b"))
    while not large.isEmpty():
        if texts is None:  # counts of classes are added up from here on: a row that was read twice must not count twice
            large = cut(large.dropDuplicates(["h", "c"]))
            texts = large.select("h", "c", "ctx", "a")
        rows = cut(large.select("h", "c", "n", "ctx", "a", "lo", "hi").mapInArrow(_dealt, "h long, c long, n long, lo int, hi int, shared binary, own binary, a int, b int"))
        alike = rows.groupBy(*group, "own").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
        several = rows.join(alike.filter("n > 1").select(*group, "own"), [*group, "own"])
        found = found.unionByName(several.select("h", "c", "a", "b"))
        groups = alike.groupBy(*group).agg(F.count("*").alias("classes")).filter("classes > 1")
        left = alike.join(groups, group).select(*group, "c", "n", "classes").join(texts, ["h", "c"])
        left = cut(left.select(*cols, "classes"))
        ready = ready.unionByName(left.filter(F.col("classes") <= CONTEXTS).select(*cols))
        large = left.filter(F.col("classes") > CONTEXTS)
    compared = ready.repartition(*group).sortWithinPartitions(*group, "c").mapInArrow(_compare, "h long, c long, a int, b int")
    return compared.unionByName(found)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of documents.

    Texts are UTF-8 bytes, null is empty; a text under 400 bytes keeps all. A text that is there twice, in
    rows that repeat or not, loses every byte in both. Very long texts are read whole. Other columns are
    ignored; no rows give no rows. Rows are told apart, and equal contexts of an anchor put together, by
    128 bits of hashes of their whole bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["ra", "rb"]
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("ra"), F.xxhash64(F.lit(1), "doc_id", text).alias("rb"))
    found = cut(_anchored(keyed))
    occ = found.select(*key, F.inline(F.arrays_zip("h", "c", "at")), "n_bytes")
    occ = occ.select(*key, "h", "c", "at", F.least(F.col("n_bytes") - F.col("at"), F.lit(LENGTH)).cast("int").alias("tail"))
    # most anchors are there once: only the others move on. What occurs again is counted first, so that the join may part a hot anchor by size
    again = cut(occ.groupBy("h").agg(F.count("*").alias("t")).filter("t > 1").select("h"))
    occ = cut(occ.join(again, "h", "left_semi"))
    del found
    release(spark)
    # one row of each class, by least values of numbers: these are hashed, not sorted, and all come from one row
    one = F.xxhash64("ra", "rb", "at")
    classes = occ.groupBy("h", "c").agg(F.count("*").alias("n"), *[F.min_by(x, one).alias(x) for x in ("ra", "rb", "at", "tail")])
    sums = classes.groupBy("h").agg(F.count("*").alias("classes"))
    known = cut(classes.join(sums, "h"))
    release(spark)
    contexts, path = written(class_contexts(known.filter("classes > 1"), keyed.select(*key, "text")))
    release(spark)
    alone = known.filter("classes = 1").select("h", "c", (-F.least("at", F.lit(LENGTH - GRAM))).alias("a"), F.col("tail").alias("b"))
    spans = alone.unionByName(class_spans(contexts)).groupBy("h", "c").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = cut(spans)
    del known, alone
    release(spark, path)
    marks = occ.select(*key, "h", "c", "at").join(spans, ["h", "c"]).select(*key, F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")).alias("s"))
    marks = cut(marks.groupBy(*key).agg(F.collect_set("s").alias("marks")))
    del spans
    release(spark)

    def make():
        def one(packed):
            raw, at, n = packed["text"].encode(), 0, 0
            digest, spans = hashlib.sha256(), _merged([(m["a"], m["b"]) for m in packed["marks"]])
            for a, b in spans:
                digest.update(raw[at:a])
                n, at = n + b - a, b
            digest.update(raw[at:])
            return n, len(spans), digest.hexdigest()

        return lambda rows: list(zip(*map(one, rows), strict=True)) if rows else [[], [], []]

    hit = keyed.select(*key, "text").join(marks, key).select(*key, F.struct("text", "marks").alias("packed"))
    # repeated rows have one result: they are joined as they are, so that a hot row can be split, and meet without texts
    removed = cut(map_texts(hit, "n_removed long, n_spans long, kept string", make, carry=tuple(key), text="packed")).dropDuplicates(key)
    release(spark)
    whole = keyed.select("doc_id", *key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    out = whole.join(removed, key, "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
