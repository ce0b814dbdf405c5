"""Exact ranks and quantiles of a column without ordering all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each factor of e in magnitude: about 0.1 % of a value.
FINE = 1024


def bucket(x: Column) -> Column:
    """A number that never falls as x grows, from x alone: fine steps in magnitude down to one millionth."""
    return F.floor(F.asinh(x * 1e6) * FINE).cast("long")


def value_ranks(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, x, n, before, total): each value of the group, its rows, the rows of smaller ones, all rows.

    Null and NaN are left out. Equal values meet before anything is ordered; then values are ordered within
    buckets, and the buckets, whose number depends on the spread of the values only, by their sums.
    """
    ok = df.select(*by, F.col(x).cast("double").alias(x)).filter(F.col(x).isNotNull() & ~F.isnan(x))
    n = ok.groupBy(*by, x).agg(F.count("*").alias("n")).withColumn("__b", bucket(F.col(x)))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = n.groupBy(*by, "__b").agg(F.sum("n").alias("__s"))
    sums = sums.withColumn("__o", F.sum("__s").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).withColumn("total", F.sum("__s").over(group))
    inside = Window.partitionBy(*by, "__b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__i", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    other = sums.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(by)], F.col("__b").alias("__c"), F.coalesce("__o", F.lit(0)).alias("__o"), "total")
    same = F.col("__b") == F.col("__c")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    return n.join(other, same).select(*by, x, "n", (F.col("__o") + F.col("__i")).alias("before"), "total")


def quantiles(df: DataFrame, x: str, qs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row for each group with exact quantiles, linear between neighbours, under the names given."""
    r = value_ranks(df, x, by)
    both = []
    for name, q in qs.items():
        place = F.lit(float(q)) * (F.col("total") - 1)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            both.append(F.max(F.when(F.col("before") <= at, F.col(x))).alias(f"__{end}_{name}"))
    out = r.groupBy(*by).agg(F.max("total").alias("__t"), *both)

    def between(name: str, q: float) -> Column:
        lo, hi, place = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.lit(float(q)) * (F.col("__t") - 1)
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place)))

    return out.select(*by, *[between(k, q).alias(k) for k, q in qs.items()])
