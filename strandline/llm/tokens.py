"""Token counts of whole texts by lookups of pre-token lengths in two tiers, without a shuffle of pre-tokens.

A piece of the model never holds its word mark (U+2581, for a space) after another character, so no merge
crosses a place where a space follows something else: the text falls into pre-tokens there, each of which
has its tokens whatever stands beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BoundedCache, map_texts

#: Entries of the broadcast table, of each task's summary, and of a worker's cache of misses.
TABLE, SUMMARY, CACHE = 30_000, 60_000, 300_000

#: Pre-tokens longer than this are encoded without being kept.
LONGEST = 64

MARK = "▁"


@lru_cache(1)
def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in p.lstrip(MARK) for p in map(sp.id_to_piece, range(sp.get_piece_size()))):
        raise ValueError("pieces of this model span pre-tokens")
    return sp


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first word mark, which the library puts before what it encodes."""
    text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " ":
        return [t[1:] for t in re.findall(r" +[^ ]*", " " + text)]
    return text.split(" ") if text else []


def merge_summaries(into: Counter, more: dict, most: int) -> Counter:
    """Misra-Gries: counts of the sum of two summaries, less the (most + 1)-th largest."""
    into.update(more)
    if len(into) > most:
        less = sorted(into.values(), reverse=True)[most]
        into = Counter({k: v - less for k, v in into.items() if v > less})
    return into


def frequent_pre_tokens(docs: DataFrame, table: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """Up to ``table`` of the most frequent pre-tokens of all texts.

    Each task sums up its texts in ``summary`` counters, summaries meet in a tree whose nodes hold as
    many, and the driver gets one. So no task, and not the driver, holds more, however large the input.
    """

    def summed(batches):
        kept: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                parts = pre_tokens(t.as_py() or "")
                for at in range(0, len(parts), 4 * summary):  # a very long text too fills no more counters
                    kept.update(x for x in parts[at : at + 4 * summary] if len(x) <= LONGEST)
                    if len(kept) > 4 * summary:
                        kept = merge_summaries(kept, {}, summary)
        kept = merge_summaries(kept, {}, table)
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "keys": pa.array([list(kept)], pa.list_(pa.string())), "n": pa.array([list(kept.values())], pa.list_(pa.int64()))})

    def joined(batches):
        kept: Counter = Counter()
        for b in batches:
            for keys, n in zip(b.column(1), b.column(2), strict=True):
                kept = merge_summaries(kept, dict(zip(keys.as_py(), n.as_py(), strict=True)), table)
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "keys": pa.array([list(kept)], pa.list_(pa.string())), "n": pa.array([list(kept.values())], pa.list_(pa.int64()))})

    kinds = "part int, keys array<string>, n array<bigint>"
    level = docs.select("text").mapInArrow(summed, kinds)
    parts = docs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 16)
        level = level.repartition(parts).mapInArrow(joined, kinds)
    found: Counter = Counter()
    for r in level.collect():
        found = merge_summaries(found, dict(zip(r["keys"], r["n"], strict=True)), table)
    return sorted(found, key=lambda k: (-found[k], k))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of documents.

    ``model`` is the path of a sentencepiece model, the same on every machine. A null text is empty and
    has 0 tokens. Rows are mapped one by one: repeats, extra columns and empty tables need no rule.
    """
    sp = processor(model)
    common = frequent_pre_tokens(docs, table)
    lengths = dict(zip(common, map(len, sp.encode(common, num_threads=1)), strict=True)) | {"": 1} if common else {"": 1}
    sent = docs.sparkSession.sparkContext.broadcast(lengths)

    def make():
        own = processor(model)
        cache = BoundedCache(lambda t: len(own.encode(t)), CACHE, sent.value)

        def count(text):
            n, long = 0, 0
            parts = pre_tokens(text)
            if len(text) > LONGEST * len(parts) // 8 and max(map(len, parts)) > LONGEST:
                long = sum(len(own.encode(t)) for t in parts if len(t) > LONGEST)
                parts = [t for t in parts if len(t) <= LONGEST]
            n = sum(map(cache.__getitem__, parts))
            return n + long

        return lambda texts: [[count(t) if t else 0 for t in texts]]

    counted = map_texts(docs.select("doc_id", "text"), "n_tokens long", make, carry=("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
