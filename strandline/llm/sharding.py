"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, running_offsets

#: Rows that one sort within a shard holds on average.
ROWS_PER_RUN = 256


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the 64-bit hash of key and shard: the least cost wins the key."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.ln(u) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(cost, shard) of the shard that wins the key; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(table, lambda s: F.struct(cost(key, s["i"], s["w"]).alias("cost"), s["i"].alias("shard"))))


def assign(df: DataFrame, key: str, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """df with ``shard`` and ``grown_shard``, the shard once one more of weight ``added`` is there.

    Only the key and the shards decide: no shuffle, and a new shard takes rows only into itself.
    A null key is a key like any other. Columns of df named shard or grown_shard are replaced.
    """
    n = len(weights)
    won = df.withColumn("__won", rendezvous(F.col(key), weights))
    more = cost(F.col(key), F.lit(n), F.lit(float(added)))
    return (
        won.withColumn("grown_shard", F.when(more < F.col("__won.cost"), F.lit(n)).otherwise(F.col("__won.shard")))
        .withColumn("shard", F.col("__won.shard"))
        .drop("__won")
    )


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """Every document's place: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``. size is the UTF-8 bytes of the text plus 16 (null: 16), text_crc32 that of
    the UTF-8 bytes (null: of none). A null doc_id is one key, repeated rows each get a slot, an
    empty table gives an empty result, and other columns are ignored. Slots follow runs of hashed
    (doc_id, size, crc32), so a shard is ordered run by run and never in one task.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = cut(assign(slim, "doc_id", weights))
    runs = max(1, placed.count() // (len(weights) * ROWS_PER_RUN))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(runs)))
    starts = running_offsets(placed, "shard", "run", F.lit(1), "before")
    w = Window.partitionBy("shard", "run").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.withColumn("__rank", F.row_number().over(w) - 1)
    return ranked.join(starts, ["shard", "run"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("__rank")).cast("long").alias("slot"),
        "grown_shard",
    )
