"""Three array views of histories and a fixed projection of them, as Arrow maps in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.arrays import finite, let, mean, std
from strandline.operators.checks import ensure_unique_key

HEIGHT, WIDTH, CLIP = 64, 192, 5.0

#: Rows of up to so many values are stretched by a matrix product.
NARROW = 64

#: Windows whose views are made at once, and those that the encoder takes at once, so that they stay in the cache.
AT_ONCE, ENCODED_AT_ONCE = 64, 4

#: Windows among which equal histories are found: those of an Arrow batch of 10,000 rows.
BATCH = 10_000

#: Values that GELU takes at once.
VALUES_AT_ONCE = 32768


def normalize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centred rows over max(std / 0.4, 1e-5), not finite to 0, clipped; with the means and deviations."""
    x = np.where(np.isfinite(x), x, 0.0)
    m, s = x.mean(1), np.sqrt(x.var(1) + 1e-5)
    z = (x - m[:, None]) / np.maximum(s / 0.4, 1e-5)[:, None]
    return np.clip(np.where(np.isfinite(z), z, 0.0), -CLIP, CLIP), m, s


def unit(z: np.ndarray) -> np.ndarray:
    return np.clip((z + CLIP) / (2 * CLIP), 0.0, 1.0)


def _weights(n: int, to: int, corners: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.linspace(0, n - 1, to) if corners else np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
    lo = np.floor(at).astype(int)
    return lo, np.minimum(lo + 1, n - 1), at - lo


def resize(x: np.ndarray, to: int, axis: int, corners: bool = False) -> np.ndarray:
    """Linear interpolation along an axis, with ends aligned or pixel centres aligned."""
    n = x.shape[axis]
    lo, hi, w = _weights(n, to, corners)
    if axis == x.ndim - 1 and n <= NARROW:
        by = np.zeros((n, to))
        np.add.at(by, (lo, np.arange(to)), 1 - w)
        np.add.at(by, (hi, np.arange(to)), w)
        return (x.reshape(-1, n) @ by).reshape(*x.shape[:-1], to)
    shape = [1] * x.ndim
    shape[axis] = to
    w = w.reshape(shape)
    return np.take(x, lo, axis) * (1 - w) + np.take(x, hi, axis) * w


def line_view(z: np.ndarray) -> np.ndarray:
    """In each column 1 less the distance from the value's height, which only the rows on either side of it do not make 0."""
    y = unit(z if z.shape[1] == WIDTH else resize(z, WIDTH, 1, corners=True)) * (HEIGHT - 1)
    low = y.astype(np.int64)
    high = np.minimum(low + 1, HEIGHT - 1)
    out = np.zeros((len(y), HEIGHT, WIDTH))
    row, column = np.arange(len(y))[:, None], np.arange(WIDTH)
    out[row, high, column] = 1 - np.abs(high - y)
    out[row, low, column] = 1 - np.abs(low - y)
    return out


def cycles_of(z: np.ndarray, period: int) -> tuple[np.ndarray, int]:
    """Cycles as rows, padded with zeros at the right and scaled to [0, 1]; with the padding."""
    p = max(1, int(period))
    cycles = -(-z.shape[1] // p)
    pad = cycles * p - z.shape[1]
    return unit(np.pad(z, ((0, 0), (0, pad))).reshape(len(z), cycles, p)), pad


def fold_view(z: np.ndarray, period: int) -> tuple[np.ndarray, int, int]:
    """The cycles stretched to a picture; with the padding and the number of cycles."""
    rows, pad = cycles_of(z, period)
    return resize(resize(rows, HEIGHT, 1), WIDTH, 2), pad, rows.shape[1]


def log_power(z: np.ndarray) -> np.ndarray:
    """Logarithm of the power of each frequency, without that of frequency 0, over the greatest."""
    p = np.abs(np.fft.rfft(z - z.mean(1, keepdims=True), axis=1)) ** 2
    p[:, 0] = 0
    p = np.log1p(p)
    return p / np.maximum(p.max(1, keepdims=True), 1e-5)


def power_view(z: np.ndarray) -> np.ndarray:
    p = np.clip(resize(log_power(z), WIDTH, 1), 0, 1)
    return np.broadcast_to(p[:, None, :], (len(p), HEIGHT, WIDTH))


def views(x: np.ndarray, period: int) -> tuple[np.ndarray, dict]:
    z, m, s = normalize(x)
    out = np.empty((len(z), 3, HEIGHT, WIDTH), np.float32)
    out[:, 0] = line_view(z)
    out[:, 1], pad, cycles = fold_view(z, period)
    out[:, 2] = power_view(z)
    return out, {"norm_mean": m, "norm_std": s, "padding_length": pad, "num_cycles": cycles}


def projection(dims: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((3 * (HEIGHT // 8) * (WIDTH // 8), dims)).astype(np.float32) / 24


def _map(windows: DataFrame, kinds: str, made, rows: int = 128) -> DataFrame:
    """Windows with the fields ``kinds``, made of ``rows`` windows at most at once: made(histories of one length, period)
    gives an array for each field, with a value or a row of values for each history."""
    keep = [c for c in windows.columns if c not in ("history", "target")]
    fields = T._parse_datatype_string(kinds).fields
    schema = T.StructType([windows.schema[c] for c in keep] + fields)

    def column(a: np.ndarray, kind: pa.DataType) -> pa.Array:
        if a.ndim == 1:
            return pa.array(a, kind)
        ends = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a.ravel(), kind.value_type), type=kind)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        kinds = [arrow.field(len(keep) + k).type for k in range(len(fields))]
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                history, period = part.column(len(keep)), part.column(len(keep) + 1).to_numpy(zero_copy_only=False)
                if history.null_count:
                    raise ValueError("a window without a history")
                values, ends = history.values.to_numpy(zero_copy_only=False).astype(float), history.offsets.to_numpy()
                groups, of = np.unique(np.stack([np.diff(ends), period], 1), axis=0, return_inverse=True)
                of = of.ravel()
                cols: list = [[] for _ in fields]
                for g, (n, p) in enumerate(groups.tolist()):
                    x = values[ends[:-1][of == g][:, None] + np.arange(int(n))]
                    for col, a, kind in zip(cols, made(x, p), kinds, strict=True):
                        col.append(column(a, kind))
                place = pa.array(np.argsort(np.argsort(of, kind="stable")))
                one = [col[0] if len(col) == 1 else pa.concat_arrays(col).take(place) for col in cols]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + one, schema=arrow)

    return windows.select(*keep, "history", F.col("period").alias("__p")).mapInArrow(run, schema)


def imageize(windows: DataFrame) -> DataFrame:
    """Windows with ``view`` (3 x 64 x 192 values in [0, 1], row by row) and how it was made."""

    def made(x, period):
        v, meta = views(x, period)
        counts = (np.full(len(v), meta[k], np.int32) for k in ("padding_length", "num_cycles"))
        return v.reshape(len(v), -1), meta["norm_mean"], meta["norm_std"], *counts

    return _map(windows, "view array<float>, norm_mean double, norm_std double, padding_length int, num_cycles int", made)


def extents(windows: DataFrame) -> DataFrame:
    """Windows with ``values``, ``low`` and ``high``: the size, least and greatest value of ``view``, taken where it is made."""

    def made(x, period):
        x, of = distinct(x)
        seen = []
        for k in range(0, len(x), AT_ONCE):
            v = views(x[k : k + AT_ONCE], period)[0].reshape(-1, 3 * HEIGHT * WIDTH)
            seen.append((np.full(len(v), v.shape[1], np.int32), v.min(1), v.max(1)))
        return tuple(np.concatenate(a)[of] for a in zip(*seen, strict=True))

    return _map(gathered(windows), "values int, low float, high float", made, BATCH)


def ink(windows: DataFrame) -> DataFrame:
    """Windows with ``line``: of the line view, the mean row of each column, weighted by the values there."""
    rows = np.arange(HEIGHT)[None, :, None]

    def made(x, period):
        v = line_view(normalize(x)[0])
        return ((v * rows).sum(1) / v.sum(1),)

    return _map(windows, "line array<double>", made)


def folded(windows: DataFrame) -> DataFrame:
    """Windows with ``fold``: the cycles of the period view, row by row, before they are stretched."""
    return _map(windows, "fold array<double>", lambda x, period: (cycles_of(normalize(x)[0], period)[0].reshape(len(x), -1),))


def powers(windows: DataFrame) -> DataFrame:
    """Windows with ``power``: the spectrum of the power view before it is stretched."""
    return _map(windows, "power array<double>", lambda x, period: (log_power(normalize(x)[0]),))


def image_index(windows: DataFrame) -> DataFrame:
    """What imageize says of each window, without the arrays, in the JVM."""
    keep = [c for c in windows.columns if c not in ("history", "target")]
    x = F.transform("history", lambda v: F.coalesce(finite(v), F.lit(0.0)))
    m = let(x, lambda a: F.struct(mean(a).alias("m"), std(a).alias("s")))
    p, n = F.greatest(F.col("period"), F.lit(1)), F.size("history")
    cycles = F.ceil(n / p).cast("int")
    out = windows.select(*keep, m.alias("__m"), (cycles * p - n).cast("int").alias("padding_length"), cycles.alias("num_cycles"))
    return out.select(*keep, F.col("__m.m").alias("norm_mean"), F.sqrt(F.col("__m.s") * F.col("__m.s") + 1e-5).alias("norm_std"), "padding_length", "num_cycles")


#: Channels of the two convolutions of the encoder.
CONVOLUTIONS = (16, 32)


def encoder_weights(dims: int, seed: int = 0, views: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seeded, untrained (weights, biases) of two 3 x 3 convolutions and a linear layer, uniform within 1 / sqrt(inputs)."""
    rnd, out, n = np.random.default_rng(seed), [], views
    for m in CONVOLUTIONS:
        bound = 1 / np.sqrt(9 * n)
        out.append((rnd.uniform(-bound, bound, (9 * n, m)).astype(np.float32), rnd.uniform(-bound, bound, m).astype(np.float32)))
        n = m
    bound = 1 / np.sqrt(n)
    return [*out, (rnd.uniform(-bound, bound, (n, dims)).astype(np.float32), rnd.uniform(-bound, bound, dims).astype(np.float32))]


def gelu(x: np.ndarray) -> np.ndarray:
    """x, overwritten by x times the normal distribution's share below it, by an error function good to 1.5e-7."""
    flat = x.reshape(-1)  # a view: x is contiguous
    held = np.empty((3, min(flat.size, VALUES_AT_ONCE)), np.float32)
    for at in range(0, flat.size, VALUES_AT_ONCE):
        v = flat[at : at + VALUES_AT_ONCE]
        a, t, s = held[:, : len(v)]
        np.abs(v, out=a)
        # The coefficients of the approximation 7.1.26 of Abramowitz and Stegun, halved.
        np.multiply(a, np.float32(0.3275911 * 0.7071067811865476), out=t)
        t += np.float32(1)
        np.reciprocal(t, out=t)
        np.multiply(t, np.float32(1.061405429 / 2), out=s)
        for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
            s += np.float32(c / 2)
            s *= t
        s *= a
        np.multiply(v, v, out=t)
        t *= np.float32(-0.5)
        np.exp(t, out=t)
        s *= t
        np.maximum(v, 0, out=v)
        v -= s
    return x


def convolve(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Channels x rows x height x width through a 3 x 3 convolution of stride 2 with a border of zeros of 1."""
    c, n, h, w = x.shape
    ho, wo = (h + 1) // 2, (w + 1) // 2
    patches = np.zeros((3, 3, c, n, ho, wo), np.float32)
    for i in range(3):
        for j in range(3):
            part = x[:, :, 1 if i == 0 else i - 1 :: 2, 1 if j == 0 else j - 1 :: 2]
            top, left = int(i == 0), int(j == 0)
            part = part[:, :, : ho - top, : wo - left]
            patches[i, j, :, :, top : top + part.shape[2], left : left + part.shape[3]] = part
    out = weights.T @ patches.reshape(9 * c, n * ho * wo)
    out += bias[:, None]
    return out.reshape(-1, n, ho, wo)


def encode(v: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Views (rows x views x height x width) through convolution, GELU, convolution, GELU, mean over places, linear layer."""
    w, b = weights[-1]
    out = np.empty((len(v), w.shape[1]), np.float32)
    for at in range(0, len(v), ENCODED_AT_ONCE):
        x = np.moveaxis(v[at : at + ENCODED_AT_ONCE], 1, 0)
        for filters, bias in weights[:-1]:
            x = gelu(convolve(x, filters, bias))
        out[at : at + ENCODED_AT_ONCE] = x.mean((2, 3)).T @ w + b
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of x, told apart by their bytes, and the place of each row among them."""
    if not x.size:
        return x, np.arange(len(x))
    rows = np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel()
    _, first, of = np.unique(rows, return_index=True, return_inverse=True)
    return x[first], of.ravel()


def gathered(windows: DataFrame) -> DataFrame:
    """Windows with equal histories and periods beside each other, as far as that leaves tasks of like size."""
    name = "__equal"
    near = windows.withColumn(name, F.xxhash64("history", "period")).hint("rebalance", name)
    return near.sortWithinPartitions(name).drop(name)


def embed(windows: DataFrame, dims: int = 32, seed: int = 0, encoder: str = "cnn") -> DataFrame:
    """``z``: the views through a small untrained encoder with seeded weights. ``cnn`` has two strided convolutions, ``projection``
    projects 8 x 8 block means, which is many times faster. Weights of another encoder take their place. Windows with equal
    histories and periods, as of series that rest, come together first, and each history of a batch is encoded once."""
    if encoder not in ("cnn", "projection"):
        raise ValueError(f"unknown encoder {encoder}")
    w = projection(dims, seed) if encoder == "projection" else encoder_weights(dims, seed)

    def encoded(x, period):
        v, _ = views(x, period)
        if encoder == "cnn":
            return encode(v, w)
        small = v.reshape(len(v), 3, HEIGHT // 8, 8, WIDTH // 8, 8).mean((3, 5)).reshape(len(v), -1)
        return np.tanh(small @ w)

    def made(x, period):
        x, of = distinct(x)
        return (np.concatenate([encoded(x[k : k + AT_ONCE], period) for k in range(0, len(x), AT_ONCE)])[of],)

    return _map(gathered(windows), "z array<float>", made, BATCH)


def aligned(views: DataFrame, index: DataFrame, key: str = "physical_window_id") -> DataFrame:
    """Stored views beside their index, by key: one that is missing on either side, or that comes twice, raises."""
    v, i = ensure_unique_key(views, [key], "views"), ensure_unique_key(index, [key], "index")
    both = v.withColumn("__v", F.lit(1)).join(i.withColumn("__i", F.lit(1)), key, "full")
    bad = F.raise_error(F.concat(F.when(F.col("__v").isNull(), "no view for ").otherwise("no index row for "), F.col(key))).cast("boolean")
    return both.filter(F.when(F.col("__v").isNull() | F.col("__i").isNull(), bad).otherwise(True)).drop("__v", "__i")
