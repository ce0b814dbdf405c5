"""Near-duplicates by the Jaccard similarity of their shingle sets.

SimHash links find candidates, MinHash bands find those whose fingerprints are farther apart, and the sets themselves
decide. Two sets of similarity s meet in a band with probability 1 - (1 - s^ROWS)^BANDS: 0.99995 at 0.8. Fingerprints
that links connect are one band more. Texts with one set stand for each other from the start.

Candidates that meet in bands form groups, which one task compares as long as they are small. In a larger group
each member is first compared with one member of each band that it meets others in. Where that does not connect
all members of a band, those outside its largest part are compared with all of the band, in blocks of bounded size.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, map_texts, release, written
from strandline.llm.graph import connected_components
from strandline.llm.simhash import _LOWER, fingerprint_links, majority, votes

#: Bands of a signature and minima of a band.
BANDS, ROWS = 25, 5

#: Shingles hashed for all minima at once, and those whose bits are counted at once.
SHINGLES_AT_ONCE, VOTES_AT_ONCE = 2048, 1 << 15

#: Shingles of a group, or of either side of a block, that one task holds; a longer set alone.
SHINGLES_HELD = 2_000_000


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, repeats included; one shingle for at most ``size`` words, none for no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of a text from the hashes of its shingles, as ``simhash.fingerprint`` makes it."""
    return majority(sum((votes(hashes[k : k + VOTES_AT_ONCE]) for k in range(0, len(hashes), VOTES_AT_ONCE)), np.zeros(64, np.int64)), len(hashes))


@lru_cache(1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(0)
    n = BANDS * ROWS
    return rnd.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rnd.integers(0, 1 << 64, n, np.uint64)


def bands(shingles: np.ndarray) -> list[int]:
    """A key for each band: the hash of its number and minima; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(shingles):
        return []
    a, b = _factors()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        h = shingles[None, at : at + SHINGLES_AT_ONCE] * a[:, None]
        h += b[:, None]
        np.minimum(least, h.min(1), out=least)
    made = [xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(made, np.uint64).view(np.int64).tolist()


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(flat))


def _marks(size: int):
    def make():
        from xxhash import xxh64_intdigest

        def of(texts):
            sets, fps = [], []
            for t in texts:
                hashes = shingle_hashes(t, size)
                sets.append(np.unique(hashes))
                fps.append(fingerprint_of(hashes))
            ids = np.array([xxh64_intdigest(s.tobytes(), 42) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            return [pa.array(ids), [len(s) for s in sets], [bands(s) for s in sets], pa.array(np.array(fps, np.uint64).view(np.int64))]

        return of

    return make


def spanning(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between sets at least so similar that connect just those that all such pairs connect."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    here = np.zeros(flat.max() + 1, bool)
    rest = np.arange(len(ids))
    out: list[tuple[int, int]] = []
    starts = np.cumsum(sizes) - sizes
    while len(rest) > 1:
        queue, gone = [rest[0]], np.array([True] + [False] * (len(rest) - 1))
        while queue:
            if gone.any():
                flat = flat[np.repeat(~gone, sizes[rest])]
                rest = rest[~gone]
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            if not len(rest):
                break
            x = queue.pop()
            here[parts[x]] = True
            common = np.add.reduceat(here[flat], starts, dtype=np.int64)
            here[parts[x]] = False
            gone = common / (sizes[x] + sizes[rest] - common) >= least
            out += [(ids[x], ids[y]) for y in rest[gone]]
            queue += list(rest[gone])
    return out


def _sets(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    ends = batch.column(at).offsets.to_numpy()
    flat = batch.column(at).values.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verified(least: float):
    def run(batches):
        """Links of groups from rows (root, sid, shingles) sorted by root and sid; a group may cross batches."""
        group, ids, sets, links = None, [], [], []
        for batch in batches:
            for root, sid, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(batch, 2), strict=True):
                if root != group:
                    links += spanning(ids, sets, least) if len(ids) > 1 else []
                    group, ids, sets = root, [], []
                    if len(links) > 10_000:
                        yield _rows(links)
                        links = []
                if not ids or ids[-1] != sid:
                    ids.append(sid)
                    sets.append(shingles.copy())
        links += spanning(ids, sets, least) if len(ids) > 1 else []
        yield _rows(links)

    return run


def _pairs(least: float):
    def run(batches):
        """The pairs of (a, b, set of a, set of b) that are similar."""
        for batch in batches:
            links = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(batch, 2), _sets(batch, 3), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common / (len(x) + len(y) - common) >= least:
                    links.append((a, b))
            yield _rows(links)

    return run


def _blocks(least: float):
    def run(batches):
        """Similar pairs of rows (key, zs, xs, right, sid, shingles) sorted by the first four: of a block, each left set with each right one."""
        block, ids, places, sizes = None, [], None, None
        held: list[np.ndarray] = []
        for batch in batches:
            links = []
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for key, zs, xs, right, sid, shingles in zip(*cols, _sets(batch, 5), strict=True):
                if (key, zs, xs) != block:
                    block, ids, held, places = (key, zs, xs), [], [], None
                if not right:
                    ids.append(sid)
                    held.append(shingles.copy())
                elif ids:
                    if places is None:  # all left sets are there: which of them hold a shingle
                        sizes = np.array(list(map(len, held)))
                        owner, flat = np.repeat(np.arange(len(held)), sizes), np.concatenate(held)
                        order = np.argsort(flat, kind="stable")
                        places = flat[order], owner[order]
                    lo, hi = np.searchsorted(places[0], shingles), np.searchsorted(places[0], shingles, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    common = np.bincount(places[1][at], minlength=len(held))
                    near = common / (sizes + len(shingles) - common) >= least
                    links += [(ids[i], sid) for i in np.flatnonzero(near) if ids[i] != sid]
            yield _rows(links)

    return run


LINKS = "a bigint, b bigint"


def _links_of_large(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that connect just those sets of large groups that all similar pairs of candidates connect.

    ``members`` has (key, sid, n) for the sets of a band, ``sets`` (sid, shingles).
    """
    star = members.join(members.groupBy("key").agg(F.min("sid").alias("a")), "key").filter("a != sid").select("a", F.col("sid").alias("b")).distinct()
    of = [sets.select(F.col("sid").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"]
    near = cut(star.join(of[0], "a").join(of[1], "b").select("a", "b", "sa", "sb").mapInArrow(_pairs(least), LINKS))
    rooted = members.join(connected_components(near).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = cut(rooted)
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    largest = parts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = cut(rooted.join(largest.select("key", "top"), "key").select("key", "sid", "n", (F.col("root") != F.col("top")).alias("out")))

    def blocks(amount):
        return F.ceil(F.coalesce(amount, F.lit(0)) / SHINGLES_HELD).cast("int")

    counts = open_.groupBy("key").agg(F.greatest(blocks(F.sum(F.when(F.col("out"), F.col("n")))), F.lit(1)).alias("nz"), F.greatest(blocks(F.sum("n")), F.lit(1)).alias("nx"))
    dealt = open_.join(counts, "key")
    part = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.filter("out").select("key", part("nz").alias("zs"), all_of("nx").alias("xs"), F.lit(False).alias("right"), "sid")
    right = dealt.select("key", all_of("nz").alias("zs"), part("nx").alias("xs"), F.lit(True).alias("right"), "sid")
    rows = left.unionByName(right).join(sets, "sid").select("key", "zs", "xs", "right", "sid", "shingles")
    more = rows.repartition("key", "zs", "xs").sortWithinPartitions("key", "zs", "xs", "right").mapInArrow(_blocks(least), LINKS)
    return near.unionByName(cut(more))


def _alike(marked: DataFrame) -> DataFrame:
    """(sid, n, key): one key for all sets with words whose SimHash fingerprints links connect."""
    prints = marked.filter("n > 0").select("sid", "n", "fp").distinct()
    rooted = connected_components(fingerprint_links(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    return prints.join(rooted, "fp", "left").select("sid", "n", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))


def firsts(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """(first): the least ``at`` of each group of rows (at, text) that pairs of at least the similarity connect.

    Texts with one set of shingles meet in one row before anything is joined. Texts without words form one group.
    Sets are made again, from the texts that met others, rather than kept for all.
    """
    marked, path = written(map_texts(rows, "sid bigint, n int, bands array<bigint>, fp bigint", _marks(size), carry=("at",)))
    nodes = cut(marked.groupBy("sid").agg(F.min("at").alias("at")))
    keyed = marked.select("sid", "n", F.explode("bands").alias("key")).unionByName(_alike(marked)).distinct()
    met = keyed.groupBy("key").agg(F.min("sid").alias("a"), F.count("*").alias("t")).filter("t > 1").drop("t")
    keyed = cut(keyed.join(met, "key"))
    groups = connected_components(keyed.filter("sid != a").select("a", F.col("sid").alias("b")).distinct())
    one = groups.withColumnRenamed("node", "sid").join(keyed.select("sid", "n").distinct(), "sid")
    sums = one.groupBy("root").agg(F.sum("n").alias("total"))
    one = cut(one.join(sums, "root").join(nodes, "sid").select("sid", "root", "at", (F.col("total") > SHINGLES_HELD).alias("large")))
    release(rows.sparkSession, path)

    def make():
        return lambda texts: [_lists([shingle_set(t, size) for t in texts])]

    held = map_texts(rows.join(one, "at").select("root", "sid", "large", "text"), "shingles array<bigint>", make, carry=("root", "sid", "large"))
    held, path = written(held)
    small = held.filter("not large").select("root", "sid", "shingles")
    links = cut(small.repartition("root").sortWithinPartitions("root", "sid").mapInArrow(_verified(similarity), LINKS))
    large = one.filter("large").select("sid")
    if not large.isEmpty():
        sets = held.filter("large").select("sid", "shingles").dropDuplicates(["sid"])
        links = links.unionByName(_links_of_large(keyed.join(large, "sid", "left_semi").select("key", "sid", "n"), sets, similarity))
    rooted = nodes.join(connected_components(links).withColumnRenamed("node", "sid"), "sid", "left").select("at", F.coalesce("root", "sid").alias("root"))
    out = cut(rooted.groupBy("root").agg(F.min("at").alias("first")).select("first"))
    release(rows.sparkSession, path)
    return out
