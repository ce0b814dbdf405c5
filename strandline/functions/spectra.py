"""Power spectra of arrays, transformed in Arrow batches: all arrays of one length at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of arrays that are transformed at once.
VALUES_AT_ONCE = 1 << 20


def by_length(arrays: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of the arrays of each length, a bounded number of values at a time; null is empty."""
    if not len(arrays):
        return
    ends = arrays.offsets.to_numpy()
    values = arrays.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.where(arrays.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        step = max(1, VALUES_AT_ONCE // max(1, int(n)))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, values[ends[part][:, None] + np.arange(n)]


def power(x: np.ndarray) -> np.ndarray:
    """Squared magnitudes of the discrete Fourier transform of each centred row, without frequency 0."""
    return np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)[:, 1:]) ** 2


def row_spectral(x: np.ndarray, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Entropy over its greatest, and dominance, of each row's power; 0, 0 without power or for short rows."""
    zero = np.zeros(len(x))
    if x.shape[1] < 4:
        return zero, zero
    p = power(x)
    total = p.sum(1)
    ok = total > eps
    share = p / np.where(ok, total, 1.0)[:, None]
    entropy = -(share * np.log(share + eps)).sum(1) / np.log(p.shape[1])
    return np.where(ok, entropy, 0.0), np.where(ok, share.max(1), 0.0)


def row_forecastability(x: np.ndarray) -> np.ndarray:
    """1 less each row's spectral entropy over its greatest; 1 for a constant or empty row, and for one of a single frequency."""
    one = np.ones(len(x))
    if x.shape[1] < 4:
        return one
    p = power(x) + 1e-12
    share = p / p.sum(1, keepdims=True)
    entropy = -(share * np.log(share)).sum(1) / np.log(p.shape[1])
    return np.where(x.std(1) < 1e-12, one, np.clip(1 - entropy, 0.0, 1.0))


def filled(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Rows with the bad values replaced by the mean of the row's others, or 0."""
    if not bad.any():
        return x
    there = (~bad).sum(1)
    mean = np.where(bad, 0.0, x).sum(1) / np.maximum(there, 1)
    return np.where(bad, mean[:, None], x)


@F.arrow_udf(T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("dominance", T.DoubleType())]))
def _spectral(a: pa.Array) -> pa.Array:
    out = np.zeros((2, len(a)))
    for at, x in by_length(a):
        out[:, at] = row_spectral(filled(x, ~np.isfinite(x)))
    return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["entropy", "dominance"])


def spectral(a: Column) -> Column:
    """struct(entropy, dominance) of the power spectrum of an array whose missing and infinite values count as the mean of the others.

    ``a`` is a column as it is read: Spark does not hand over arrays made by lambdas, nor calls from inside one.
    """
    return _spectral(a)


def forecastability(a: Column, most: int) -> Column:
    """1 less the spectral entropy over its greatest, of at most ``most`` values at truncated equal distances, missing ones as the
    mean of the others. ``a`` as in ``spectral``."""

    @F.arrow_udf(T.DoubleType())
    def measured(a: pa.Array) -> pa.Array:
        out = np.ones(len(a))
        for at, x in by_length(a):
            n = x.shape[1]
            if n > most:
                x = x[:, np.arange(most) * (n - 1) // (most - 1)]
            out[at] = row_forecastability(filled(x, np.isnan(x)))
        return pa.array(out)

    return measured(a)
