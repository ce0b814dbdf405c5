"""Array expressions on windows: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: expressions inside lambdas are otherwise computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def finite_only(a: Column) -> Column:
    return F.filter(F.transform(a, finite), lambda x: x.isNotNull())


def mean(a: Column) -> Column:
    return let(a, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)))


def std(a: Column) -> Column:
    """Population standard deviation of an array without nulls; null for an empty one."""
    return let(a, lambda v: let(mean(v), lambda m: F.when(F.size(v) > 0, F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))))


def filled(a: Column) -> Column:
    """Missing and infinite values replaced by the mean of the others, or 0."""
    return let(F.coalesce(mean(finite_only(a)), F.lit(0.0)), lambda m: F.transform(a, lambda x: F.coalesce(finite(x), m)))


def quantile(a: Column, q: float) -> Column:
    """Quantile with linear interpolation of an array without nulls."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(place).cast("int")
        return F.get(s, lo) + (F.get(s, F.least(lo + 1, F.size(s) - 1)) - F.get(s, lo)) * (place - lo)

    return let(F.sort_array(a), at)


def tail(a: Column, n: Column) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)


def index_pairs(a: Column) -> Column:
    """(t, x) of the finite values, t counted from 0 over all."""
    return F.filter(F.transform(a, lambda x, i: F.struct(i.cast("double").alias("t"), finite(x).alias("x"))), lambda p: p["x"].isNotNull())


def slope(a: Column) -> Column:
    """Least-squares slope over the places of finite values; 0 for fewer than two."""

    def of(p: Column) -> Column:
        n = F.size(p)
        means = F.struct((F.aggregate(p, F.lit(0.0), lambda s, x: s + x["t"]) / n).alias("t"), (F.aggregate(p, F.lit(0.0), lambda s, x: s + x["x"]) / n).alias("x"))

        def fitted(m: Column) -> Column:
            sxy = F.aggregate(p, F.lit(0.0), lambda s, x: s + (x["t"] - m["t"]) * (x["x"] - m["x"]))
            sxx = F.aggregate(p, F.lit(0.0), lambda s, x: s + (x["t"] - m["t"]) * (x["t"] - m["t"]))
            return sxy / sxx

        return F.when(n >= 2, let(means, fitted)).otherwise(0.0)

    return let(index_pairs(a), of)


def autocorrelation(a: Column, lag: Column) -> Column:
    """Products of centred values lag apart over the centred sum of squares; 0 beyond the length or without variance."""

    def of(c: Column) -> Column:
        keep = F.greatest(F.size(c) - lag, F.lit(0))
        den = total(F.transform(c, lambda x: x * x))
        num = total(F.zip_with(F.slice(c, F.lit(1), keep), F.slice(c, F.least(lag + 1, F.size(c)), keep), lambda x, y: x * y))
        return F.when((lag > 0) & (lag < F.size(c)) & (den > EPS), num / den).otherwise(0.0)

    return let(centred(a), of)


def centred(a: Column) -> Column:
    return let(a, lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m)))


def squared_error(y: Column, yhat: Column) -> Column:
    return mean(F.zip_with(y, yhat, lambda a, b: (a - b) * (a - b)))


def absolute_error(y: Column, yhat: Column) -> Column:
    return mean(F.zip_with(y, yhat, lambda a, b: F.abs(a - b)))
