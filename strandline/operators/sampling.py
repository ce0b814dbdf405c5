"""Deterministic samples with exact counts in groups. Order within a group is that of a seeded hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(seed: int, key: str) -> list[Column]:
    return [F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


def _ranked(df: DataFrame, strata: Sequence[str], most: int, seed: int, key: str) -> DataFrame:
    """The first ``most`` rows of each group and their rank. A sample of so many rows takes no others, and a bounded
    rank lets each task drop the rest before the shuffle, however large the group."""
    w = Window.partitionBy(*strata).orderBy(*_order(seed, key))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)


def proportional(df: DataFrame, strata: Sequence[str], target: int, seed: int, key: str = "physical_window_id") -> DataFrame:
    """target rows in proportion to the strata: whole parts first, then by largest remainder and size."""
    total = df.count()
    if not 0 < target <= total:
        raise ValueError(f"target rows must lie within 1 and {total}")
    if not strata:
        return df.orderBy(*_order(seed, key)).limit(target)
    exact = F.col("n") * F.lit(float(target)) / F.lit(float(total))
    q = df.groupBy(*strata).agg(F.count("*").alias("n")).withColumn("q", F.floor(exact)).withColumn("f", exact - F.col("q"))
    one = Window.partitionBy(F.lit(0))
    q = q.withColumn("left", target - F.sum("q").over(one)).withColumn("k", F.row_number().over(one.orderBy(F.desc("f"), F.desc("n"), *strata)))
    q = q.withColumn("quota", F.col("q") + (F.col("k") <= F.col("left")).cast("int")).select(*strata, "quota")
    r = _ranked(df, strata, target, seed, key)
    q = q.withColumnsRenamed({s: f"__{s}" for s in strata})
    cond = F.expr(" and ".join(f"{s} <=> __{s}" for s in strata))
    return r.join(q, cond).filter("__r <= quota").drop("__r", "quota", *[f"__{s}" for s in strata])


def round_robin(df: DataFrame, strata: Sequence[str], target: int, seed: int, key: str = "physical_window_id") -> DataFrame:
    """Equal quotas, bounded by group sizes, what is left dealt on in group order: the first target rows by (rank in group, group)."""
    r = _ranked(df, strata, target, seed, key)
    return r.orderBy("__r", *strata).limit(target).drop("__r")


def equal_quota_fill(df: DataFrame, strata: Sequence[str], target: int, seed: int, key: str = "physical_window_id") -> DataFrame:
    """max(1, T // G) rows of each group, one more of the first T % G, then a fill from all other rows, T in all."""
    groups = df.select(*strata).distinct()
    g = groups.withColumn("__g", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*strata))).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0))))
    base = F.greatest(F.floor(F.lit(target) / F.col("__n")), F.lit(1))
    g = g.withColumn("__q", base + (F.col("__g") <= F.greatest(F.lit(target) - base * F.col("__n"), F.lit(0))).cast("int"))
    g = g.withColumnsRenamed({s: f"__k{s}" for s in strata})
    r = _ranked(df, strata, target, seed, key).join(g, F.expr(" and ".join(f"{s} <=> __k{s}" for s in strata)))
    r = r.withColumn("__fill", (F.col("__r") > F.col("__q")).cast("int"))
    return r.orderBy("__fill", "__r", "__g").limit(target).select(*df.columns)


def capped(df: DataFrame, strata: Sequence[str], cap: int, seed: int, key: str = "physical_window_id") -> DataFrame:
    """At most cap rows of each group."""
    return _ranked(df, strata, cap, seed, key).drop("__r")


def latency_sample(df: DataFrame, strata: Sequence[str], target: int, seed: int, key: str = "physical_window_id") -> DataFrame:
    """A capped sample (T // 48 + 1 of each group), trimmed or filled to T rows."""
    cap = max(1, target // 48 + 1)
    few = capped(df, strata, cap, seed, key)
    rest = df.join(few.select(key), key, "left_anti")
    both = few.withColumn("__f", F.lit(0)).unionByName(rest.withColumn("__f", F.lit(1)))
    return both.orderBy("__f", *_order(seed, key)).limit(target).drop("__f")


def resume(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose keys are not done; done rows with a null key are ignored."""
    return tasks.join(done.dropna(subset=list(keys)).select(*keys), list(keys), "left_anti")


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the greatest order."""
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    return r.filter("__r = 1").drop("__r")
