"""Benchmark decontamination by Wu-Manber multi-pattern search over whole documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_texts

#: Words of a window.
WINDOW = 10

#: UTF-8 bytes of benchmark texts that one set of tables, which is broadcast, is built from.
TABLE_BYTES = 16 << 20

#: Bytes of text that one lane of the search walks through.
LANE = 1024

#: A-Z to a-z; what the word rule leaves out to a space.
_FOLD = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    """Every window of a text, its words parted and bounded by spaces; a text of fewer words is one window."""
    w = words(text)
    return {b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))} if w else set()


class Tables:
    """Wu-Manber tables of patterns of similar length.

    ``shift`` gives, for the hash of a block of B bytes that ends at some place, by how far the search may
    move on: the least distance from such a block to the end of the first m bytes of a pattern, or m - B + 1.
    Where it is 0, the bucket of the block's hash and the pattern's first bytes holds the strings to compare.
    """

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.b = b = 8 if m >= 24 else 4 if m >= 8 else 2
        self.bits = 20 if len(patterns) * m > 1 << 15 else 16
        self.shift = np.full(1 << self.bits, m - b + 1, np.uint32)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        for end in range(b, m + 1):
            block = np.zeros((len(heads), 8), np.uint8)
            block[:, :b] = heads[:, end - b : end]
            np.minimum.at(self.shift, self.hashed(block.view("<u8")[:, 0]), m - end)
        self.buckets = defaultdict(list)
        for p in sorted(patterns):
            self.buckets[p[m - b : m], p[:b]].append(p)
        self.keys = np.unique(np.array([self.key(int.from_bytes(a, "little"), int.from_bytes(z, "little")) for z, a in self.buckets], np.uint64))

    def hashed(self, block: np.ndarray) -> np.ndarray:
        return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    @staticmethod
    def key(first, last):
        if isinstance(first, int):
            return (first * 0xC2B2AE3D27D4EB4F + last * 0x165667B19E3779F9) % (1 << 64)
        return first * np.uint64(0xC2B2AE3D27D4EB4F) + last * np.uint64(0x165667B19E3779F9)

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """Every (place, pattern) in text. Lanes of LANE bytes move on together."""
        n = len(text)
        if n < self.m:
            return []
        padded = np.frombuffer(text + b"\0" * 8, np.uint8)
        mask = np.uint64((1 << 8 * self.b) - 1)
        at = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        pos = np.arange(self.m - self.b, n - self.b + 1, LANE)  # starts of the block that ends a window of m bytes
        stop = np.minimum(pos + LANE, n - self.b + 1)
        found = []
        while len(pos):
            block = at[pos] & mask
            step = self.shift[self.hashed(block)].astype(np.int64)
            zero = step == 0
            if zero.any():
                starts = pos[zero] - (self.m - self.b)
                found.append((starts, self.key(at[starts] & mask, block[zero])))
                step[zero] = 1
            pos = pos + step
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        if not found:
            return []
        starts, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        near = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)]
        out = []
        for s in starts[near == keys].tolist():
            for p in self.buckets.get((text[s + self.m - self.b : s + self.m], text[s : s + self.b]), ()):
                if text.startswith(p, s):
                    out.append((s, p))
        return out


class Benchmark:
    """Tables of a block of the benchmark; patterns of very different lengths go to tables of their own."""

    def __init__(self, items: list[tuple]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for item_id, text in items:
            for p in windows(text):
                self.items[p].append("null" if item_id is None else str(item_id))
        classes = defaultdict(list)
        for p in self.items:
            classes[(len(p) >= 8) + (len(p) >= 24) + (len(p) >= 40)].append(p)
        self.tables = [Tables(ps) for _, ps in sorted(classes.items())]

    def search(self, texts: list) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text: its count of words, hit spans of words and ids of items with occurring windows."""
        folded = [b" ".join(words(t)) for t in texts]
        starts = np.cumsum([0] + [len(f) + 3 for f in folded])
        text = b"".join(b"\0 " + f + b" " for f in folded)  # no pattern holds the zero byte that parts documents
        hits: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for t in self.tables:
            for s, p in t.find(text):
                d = int(np.searchsorted(starts, s, "right")) - 1
                hits[d].append((s - int(starts[d]) - 1, p))
        out = []
        for d, f in enumerate(folded):
            spans, ids = [], set()
            if d in hits:
                gaps = np.flatnonzero(np.frombuffer(b" " + f, np.uint8) == 32)
                for s, p in hits[d]:
                    first = int(np.searchsorted(gaps, s))
                    spans.append((first, first + p.count(b" ") - 1))
                    ids.update(self.items[p])
            out.append((f.count(b" ") + bool(f), spans, ids))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, table_bytes: int = TABLE_BYTES) -> Iterator[Benchmark]:
    """Search tables of the benchmark, read row by row into blocks of at most ``table_bytes`` of text (a longer item alone).

    One block at a time is held: the next is made when the one before has been sent.
    """
    items, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        n = len(r.text.encode())
        if items and size + n > table_bytes:
            yield Benchmark(items)
            items, size = [], 0
        items.append((r.item_id, r.text))
        size += n
    yield Benchmark(items)


def mark(docs: DataFrame, benchmark: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs with n_words, hits (merged spans of hit words, [first, end)) and hit_items (sorted ids).

    The tables of a block of the benchmark are of bounded size and are broadcast; each further block is a
    further map over the documents. No shuffle. Null texts have no words and no hits.
    """
    out = None
    cols = docs.columns
    for block in benchmark_blocks(benchmark, table_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        del block

        def make(sent=sent):
            def work(texts):
                found = sent.value.search(texts)
                return [[n for n, _, _ in found], [[{"first": a, "end": b} for a, b in _merged(s)] for _, s, _ in found], [sorted(i) for _, _, i in found]]

            return work

        one = map_texts(out if out is not None else docs, "__n long, __spans array<struct<first int, end int>>, __items array<string>", make, (out if out is not None else docs).columns)
        if out is None:
            out = one.select(*cols, F.col("__n").alias("n_words"), F.col("__spans").alias("hits"), F.col("__items").alias("hit_items"))
        else:
            spans, items = F.concat("hits", "__spans"), F.array_sort(F.array_union("hit_items", "__items"))
            out = one.select(*cols, "n_words", spans.alias("hits"), items.alias("hit_items"))
    last = F.array_sort("hits")
    # spans of several blocks may overlap: what lies before the furthest end so far counts once
    fold = F.aggregate(
        last,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(x["end"] - F.greatest(s["end"], x["first"]), F.lit(0))).alias("n")),
    )
    return out.withColumn("n_hit", fold["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents.

    A null or empty text has no words. Benchmark rows without words have no windows; a null item_id is
    written ``null``; ids that repeat count once. Repeated documents each get a row, other columns are ignored.
    Very long texts are searched whole. An empty benchmark hits nothing; no documents give no rows.
    """
    slim = docs.select("doc_id", "text")
    found = mark(slim, benchmark, table_bytes)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: sha256 of no item ids.
NO_ITEMS = hashlib.sha256(b"").hexdigest()
