"""Fifteen light features of a window's history."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.arrays import EPS, autocorrelation, filled, finite_only, let, mean, quantile, slope, std, tail
from strandline.functions.spectra import by_length, row_spectral, spectral
from strandline.functions.spectra import filled as fill

FEATURES = (
    "mean std median iqr min max amplitude last_value missing_ratio slope recent_std_ratio acf_lag1 acf_period spectral_entropy dominant_frequency_strength"
).split()


#: Features that come from the power spectrum, and their names there.
SPECTRAL = {"spectral_entropy": "entropy", "dominant_frequency_strength": "dominance"}


def features(history: Column, full: Column, period: Column, recent: float = 0.25) -> dict[str, Column]:
    """Measures of the finite values of a history, or of the history filled with their mean, all within the JVM."""
    ok = finite_only(history)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    last = tail(full, F.greatest(F.ceil(F.size(full) * recent).cast("int"), F.lit(2)))
    return {
        "mean": zero(mean(ok)),
        "std": zero(std(ok)),
        "median": zero(quantile(ok, 0.5)),
        "iqr": zero(quantile(ok, 0.75) - quantile(ok, 0.25)),
        "min": zero(F.array_min(ok)),
        "max": zero(F.array_max(ok)),
        "amplitude": zero(F.array_max(ok) - F.array_min(ok)),
        "last_value": zero(F.get(ok, F.size(ok) - 1)),
        "missing_ratio": 1 - F.size(ok) / F.size(history),
        "slope": slope(history),
        "recent_std_ratio": std(last) / (std(full) + 1e-8),
        "acf_lag1": autocorrelation(full, F.lit(1)),
        "acf_period": autocorrelation(full, period),
    }


def batched(x: np.ndarray, period: np.ndarray, recent: float = 0.25) -> dict[str, np.ndarray]:
    """All features of the rows of x, which have one length; not finite is missing."""
    n = x.shape[1]
    bad = ~np.isfinite(x)
    there = (~bad).sum(1)
    some = there > 0
    full = fill(x, bad)
    kept = np.where(bad, 0.0, x)
    m = kept.sum(1) / np.maximum(there, 1)
    c = np.where(bad, 0.0, x - m[:, None])
    order = np.sort(np.where(bad, np.inf, x), axis=1)

    def quantile_of(q):
        place = np.maximum(there - 1, 0) * q
        lo = np.floor(place).astype(int)
        a, b = np.take_along_axis(order, lo[:, None], 1)[:, 0], np.take_along_axis(order, np.minimum(lo + 1, np.maximum(there - 1, 0))[:, None], 1)[:, 0]
        with np.errstate(invalid="ignore"):
            return np.where(some, a + (b - a) * (place - lo), 0.0)

    low, high = np.where(some, np.where(bad, np.inf, x).min(1), 0.0), np.where(some, np.where(bad, -np.inf, x).max(1), 0.0)
    last = n - 1 - np.argmax(~bad[:, ::-1], 1)
    t = np.where(bad, 0.0, np.arange(n, dtype=float))
    tc = np.where(bad, 0.0, np.arange(n) - (t.sum(1) / np.maximum(there, 1))[:, None])
    sxx = (tc * tc).sum(1)
    f = full - full.mean(1, keepdims=True)
    total = (f * f).sum(1)

    def correlation(lag):
        out = np.zeros(len(x))
        for k in np.unique(lag):
            at = (lag == k) & (0 < k < n) & (total > EPS)
            if at.any():
                out[at] = (f[at, : n - k] * f[at, k:]).sum(1) / total[at]
        return out

    tail_ = full[:, -min(n, max(2, math.ceil(n * recent))) :]
    entropy, dominance = row_spectral(full)
    values = (
        np.where(some, m, 0.0), np.sqrt((c * c).sum(1) / np.maximum(there, 1)), quantile_of(0.5), quantile_of(0.75) - quantile_of(0.25), low, high, high - low,
        np.where(some, x[np.arange(len(x)), last], 0.0), 1 - there / n, np.where(there >= 2, (tc * c).sum(1) / np.where(sxx > 0, sxx, 1.0), 0.0),
        tail_.std(1) / (full.std(1) + 1e-8), correlation(np.ones(len(x), int)), correlation(period), entropy, dominance,
    )
    return dict(zip(FEATURES, values, strict=True))


def proxy_batches(windows: DataFrame) -> DataFrame:
    """What proxy_table makes, by NumPy over Arrow batches: the faster way for long histories."""
    keep = [c for c in windows.columns if c not in ("history", "target")]
    schema = T.StructType([windows.schema[c] for c in keep] + [T.StructField(f, T.DoubleType()) for f in FEATURES])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            period = b.column(len(keep) + 1).fill_null(0).to_numpy(zero_copy_only=False).astype(int)
            made = np.zeros((len(FEATURES), b.num_rows))
            for at, x in by_length(b.column(len(keep))):
                if not x.shape[1]:
                    raise ValueError("empty history")
                for k, v in enumerate(batched(x, period[at]).values()):
                    made[k, at] = v
            yield pa.RecordBatch.from_arrays([*[b.column(i).cast(arrow.field(i).type) for i in range(len(keep))], *map(pa.array, made)], schema=arrow)

    return windows.select(*keep, "history", F.col("period").alias("__p")).mapInArrow(run, schema)


def proxy_table(windows: DataFrame) -> DataFrame:
    """Windows with history to their features; the target is not read. An empty history raises.

    Spectra are made in Arrow batches, all else in the JVM; no shuffle.
    """
    h = F.when(F.size("history") == 0, F.raise_error(F.lit("empty history")).cast("array<double>")).otherwise(F.col("history"))
    keep = [c for c in windows.columns if c not in ("history", "target")]

    def packed(h: Column) -> Column:
        return let(filled(h), lambda full: F.struct(*[c.cast("double").alias(k) for k, c in features(h, full, F.col("period")).items()]))

    made = windows.select(*keep, let(h, packed).alias("f"), spectral(F.col("history")).alias("s"))
    return made.select(*keep, *[F.col(f"s.{SPECTRAL[k]}" if k in SPECTRAL else f"f.{k}").alias(k) for k in FEATURES])
