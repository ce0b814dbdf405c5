"""SimHash near-duplicates, linked by Golay-code fuzzy hashing of fingerprint segments.

The perfect binary Golay code of 23 bits has exactly one of its 4096 codewords within 3 bits of any word,
and a word at distance 3 has five more at distance 4. A fingerprint is parted into segments of 22, 21 and 21
bits. If two fingerprints differ in at most 4 bits, then either some segment is equal and another differs in
at most 2 bits, or two segments differ in 1 bit each. Words at most 2 bits apart have a common codeword
within 4 bits; of words 1 bit apart, the nearest codeword of either is within 4 bits of the other. So one of
these keys agrees: (equal segment, codeword near the other), or (nearest of one, near the other) against
(near the one, nearest of the other).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, map_texts, row_key
from strandline.llm.graph import connected_components

#: Words of a shingle and bits that linked fingerprints may differ in.
SHINGLE, BITS = 4, 4

#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101

#: Runs of a key above this are split by 13-bit bands.
LONG_RUN = 4096

#: Key rows made from so many fingerprints at a time.
FINGERPRINTS_AT_ONCE = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes have."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, each set if over half the XXH64 (seed 42) of the shingles have it; 0 for no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: -size]]).tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)]
        counts += votes(np.array(part, np.uint64))
    return majority(counts, n)


def fingerprints(docs: DataFrame, size: int = SHINGLE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``fp``, the fingerprint as a signed 64-bit number."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))]

    return map_texts(docs, "fp bigint", make, carry=carry)


@lru_cache(1)
def decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the upper 12 bits, of the lower 11, errors): errors[s] are the errors of up to 4 bits
    with syndrome s, the least first, padded with the first."""

    def remainder(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        return v

    high = np.array([remainder(v << 11) for v in range(4096)])
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            errors[high[e >> 11] ^ (e & 2047)].append(e)
    return high, np.arange(2048), np.array([(e + e[:1] * 6)[:6] for e in errors])


def codewords(segment: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the nearest codeword and the others within 4 bits, 6 columns; fewer repeat the nearest."""
    high, low, errors = decoder()
    s = segment.astype(np.int64)
    return (s[:, None] ^ errors[high[s >> 11] ^ low[s & 2047]]) >> 11


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place of its fingerprint in fps): fingerprints at most 4 bits apart share a key."""
    u = fps.view(np.uint64)
    parts = [(u >> np.uint64(42)).astype(np.int64), (u >> np.uint64(21) & np.uint64((1 << 21) - 1)).astype(np.int64), (u & np.uint64((1 << 21) - 1)).astype(np.int64)]
    near = [codewords(p) for p in parts]
    made = []
    tag = 0
    for x in range(3):
        for y in range(3):
            if x != y:
                made.append((tag << 56) | (parts[x][:, None] << 12) | near[y])
                tag += 1
    for x, y in combinations(range(3), 2):
        made.append((tag << 56) | (near[x][:, :1] << 12) | near[y])
        made.append((tag << 56) | (near[x] << 12) | near[y][:, :1])
        tag += 1
    k = np.concatenate(made, axis=1)
    k.sort(axis=1)
    new = np.ones(k.shape, bool)
    new[:, 1:] = k[:, 1:] != k[:, :-1]
    return k[new], np.nonzero(new)[0]


def _emit_keys(batches):
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), FINGERPRINTS_AT_ONCE):
            part = fps[at : at + FINGERPRINTS_AT_ONCE]
            k, place = keys(part)
            yield pa.RecordBatch.from_pydict({"key": pa.array(k), "fp": pa.array(part[place])})


def _near(f: np.ndarray, x: np.uint64) -> np.ndarray:
    return np.bitwise_count(f ^ x) <= BITS


def _tree(f: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of distinct fingerprints f, each between fingerprints within the limit."""
    out, rest = [], f
    if len(f) > LONG_RUN:
        for shift in range(0, 64, 13):  # 4 errors leave one of 5 bands equal
            band = f >> np.uint64(shift) & np.uint64(0x1FFF)
            order = np.argsort(band, kind="stable")
            cuts = np.flatnonzero(np.diff(band[order])) + 1
            for part in np.split(f[order], cuts):
                if len(part) > 1:
                    out += _span(part)
        return out
    return _span(rest)


def _span(f: np.ndarray) -> list[tuple[int, int]]:
    out = []
    rest = f
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            close = _near(rest, x)
            if close.any():
                found = rest[close]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~close]
    return out


def _links(batches):
    """Links of fingerprints from rows sorted by key; a key's rows may cross batches."""

    def found(k: np.ndarray, f: np.ndarray):
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        sizes = ends - starts
        left, right = [], []
        for d in range(1, 8):  # short runs: all pairs at distance d in the order, for all runs at once
            at = np.arange(len(k) - d)
            at = at[(k[at] == k[at + d])]
            if not len(at):
                break
            at = at[np.repeat(sizes, sizes)[at] <= 8]
            ok = np.bitwise_count(f[at] ^ f[at + d]) <= BITS
            left.append(f[at[ok]])
            right.append(f[at[ok] + d])
        for i in np.flatnonzero(sizes > 8):
            pairs = _tree(np.unique(f[starts[i] : ends[i]]))
            left.append(np.array([p for p, _ in pairs], np.uint64))
            right.append(np.array([q for _, q in pairs], np.uint64))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
        ab = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.ascontiguousarray(ab[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(ab[:, 1]).view(np.int64))})

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        k, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        held.append((k, f))
        if k[-1] == held[0][0][0]:
            continue  # one key so far
        k, f = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(k, k[-1]))
        yield found(k[:last], f[:last])
        held = [(k[last:], f[last:])]
    if held:
        yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fps.fp`` just as all pairs within 4 bits do."""
    keyed = fps.mapInArrow(_emit_keys, "key bigint, fp bigint")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a bigint, b bigint")


def components(marked: DataFrame, least: str = "doc_id") -> DataFrame:
    """(fp, first) of every distinct fp of ``marked``: ``first`` is the least ``least`` of its component.

    Copies with one fingerprint meet in one row before anything is joined, so a group of copies costs as
    much as one document.
    """
    nodes = cut(marked.groupBy("fp").agg(F.min(least).alias("low")))
    rooted = connected_components(fingerprint_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = nodes.join(rooted, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("first"))
    return rooted.join(lows, "root").select("fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents.

    Null, empty and white texts have fingerprint zero, which links like any other. A null doc_id is never
    the smallest; a component of nulls has a null id. Repeated rows share a fingerprint. Other columns are
    ignored, and no rows give no rows. Whole texts count, however long.
    """
    marked = cut(fingerprints(docs.select("doc_id", "text")))
    known = components(marked)
    return marked.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, size: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of each component with all columns of docs: the smallest doc_id, of equals the least by a hash of the row.

    Pairs link whose fingerprints are within the limit of bits. With ``similarity``, these are candidates, as are those
    that bands of minima find farther apart, and pairs link whose sets of shingles of ``size`` words have at least that
    Jaccard similarity.
    """
    name = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(name)
    plain = plain.withColumn("__row", row_key(plain))
    key = F.struct(F.col(name["doc_id"]).isNull().alias("none"), F.col(name["doc_id"]).alias("id"), F.col("__row").alias("row"))
    from pyspark.sql import Window

    from strandline.llm import minhash

    texts = plain.select(key.alias("at"), F.col(name["text"]).alias("text"))
    if similarity is None:
        found = components(cut(fingerprints(texts, size, carry=("at",))), "at")
    else:
        found = minhash.firsts(texts, size, similarity)
    firsts = found.select(F.col("first.row").alias("__row")).distinct()

    nth = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    kept = plain.join(firsts, "__row").withColumn("__nth", nth).filter("__nth = 1")
    return kept.select(*[F.col(v).alias(k) for k, v in name.items()])
