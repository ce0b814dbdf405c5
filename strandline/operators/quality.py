"""Series quality, regime cells and their tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.arrays import centred, let, mean, total
from strandline.functions.ranks import quantiles, value_ranks
from strandline.functions.spectra import forecastability
from strandline.operators.panel import ITEM, downsample

METRICS = ("trend_strength", "seasonality_strength", "forecastability")
LETTERS = ("T", "S", "F")
CELLS = tuple(f"{t}T_{s}S_{f}F" for t in ("high", "low") for s in ("high", "low") for f in ("high", "low"))


def missing_ratio(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda x: x.isNull() | F.isnan(x))) / F.size(values)).otherwise(1.0)


def cleaned(values: Column) -> Column:
    """NaN and null replaced by the mean of the others, zeros if there are none."""
    there = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return let(F.coalesce(mean(there), F.lit(0.0)), lambda m: F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x), m).otherwise(x)))


def seasonality(a: Column, period: Column) -> Column:
    """Absolute correlation of the series with itself a period later; 0 if it is not defined."""
    n = F.greatest(F.size(a) - period, F.lit(0))
    pair = F.struct(centred(F.slice(a, F.lit(1), n)).alias("x"), centred(F.slice(a, period + 1, n)).alias("y"))

    def of(c: Column) -> Column:
        sxy = total(F.zip_with(c["x"], c["y"], lambda p, q: p * q))
        sxx, syy = total(F.transform(c["x"], lambda p: p * p)), total(F.transform(c["y"], lambda q: q * q))
        return let(F.struct(sxy.alias("xy"), sxx.alias("xx"), syy.alias("yy")), lambda s: F.when((s["xx"] > 1e-24) & (s["yy"] > 1e-24), F.abs(s["xy"] / F.sqrt(s["xx"] * s["yy"]))).otherwise(0.0))

    return F.when((n >= 2) & (period > 0), let(pair, of)).otherwise(0.0)


def trend(a: Column) -> Column:
    """Share of variance that a line explains, within 0 and 1; 0 for fewer than three values."""

    def of(c: Column) -> Column:
        n = F.size(c)
        sxy = total(F.transform(c, lambda x, i: (i - (n - 1) / 2.0) * x))
        sst = total(F.transform(c, lambda x: x * x))
        sums = F.struct((sxy * sxy / (n * (n * n - 1.0) / 12.0)).alias("line"), sst.alias("all"))
        share = let(sums, lambda s: F.least(F.greatest(1 - (s["all"] - s["line"]) / (s["all"] + 1e-12), F.lit(0.0)), F.lit(1.0)))
        return F.when(n >= 3, share).otherwise(0.0)

    return let(centred(a), of)


def quality(series: DataFrame, period: Column, most: int = 2048) -> DataFrame:
    """Series (… , values) with effective length, missing ratio and the three measures; values are dropped.

    Spectra are made in Arrow batches, as sums over all pairs of values and frequencies would be slow on long series.
    """

    def measured(c: Column, p: Column) -> Column:
        p = F.least(p, F.greatest(F.floor(F.size(c) / 2).cast("int"), F.lit(2)))
        return let(c, lambda v: F.struct(seasonality(v, p).alias("seasonality_strength"), trend(v).alias("trend_strength")))

    keep = [c for c in series.columns if c != "values"]
    few = series.select(*keep, downsample(F.col("values"), most).alias("__v"), period.alias("__p"), forecastability(F.col("values"), most).alias("forecastability"))
    clean = few.select(*keep, F.size("__v").alias("eff_length"), missing_ratio(F.col("__v")).alias("missing_ratio"), "forecastability", measured(cleaned(F.col("__v")), F.col("__p")).alias("__m"))
    return clean.select(*keep, "eff_length", "missing_ratio", "forecastability", "__m.*")


def item_quality(channels: DataFrame) -> DataFrame:
    """Means of the channels' measures, missing ones left out."""
    return channels.groupBy(*ITEM).agg(*[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in METRICS], F.count("*").alias("channels"))


def label(highs: Sequence[Column]) -> Column:
    """The cell of three tests; a null test counts as low."""
    return F.concat_ws("_", *[F.concat(F.when(F.coalesce(h, F.lit(False)), "high").otherwise("low"), F.lit(x)) for h, x in zip(highs, LETTERS, strict=True)])


def median_cells(items: DataFrame) -> DataFrame:
    """Cells by the exact medians over all rows, which a row of their own brings to each; at the median is high."""
    m = items.agg(*[F.median(c).alias(f"{c}_median") for c in METRICS])
    return items.crossJoin(F.broadcast(m)).withColumn("tsf_cell", label([F.col(c) >= F.col(f"{c}_median") for c in METRICS]))


def threshold_cells(items: DataFrame, tau: float = 0.4) -> DataFrame:
    """Cells by a fixed threshold; only above it is high, NaN is low."""
    return items.withColumn("tsf_cell", label([F.when(~F.isnan(c), F.col(c) > tau) for c in METRICS]))


def item_channel_mean(channels: DataFrame, n_channels: int, tau: float = 0.4) -> DataFrame:
    """Means of an item's channels with its cell, cluster (first by channel that is not null, or -1) and completeness."""
    g = channels.groupBy(*ITEM).agg(
        *[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in METRICS],
        F.coalesce(F.min_by("cluster", F.when(F.col("cluster").isNotNull(), F.col("channel"))), F.lit(-1)).alias("official_cluster_code"),
        F.count_distinct("channel").alias("channels"),
    )
    return threshold_cells(g, tau).withColumn("complete", F.col("channels") == n_channels)


def cell_distribution(units: DataFrame, counts: DataFrame, unit_keys: Sequence[str] = tuple(ITEM)) -> DataFrame:
    """Units and windows by cell and setting, for each subset and combined, with k-shot flags.

    Windows of an item count once for each unit of it, so channels multiply them.
    """
    u = units.withColumn("g", F.explode(F.array(F.col("subset"), F.lit("combined"))))
    sizes = u.groupBy(F.col("g"), "tsf_cell").agg(F.count_distinct(*unit_keys).alias("unit_count"))
    w = u.join(counts, ITEM).groupBy("g", "tsf_cell", "seq_len", "pred_len").agg(*[F.sum(F.when(F.col("split") == s, F.col("item_windows")).otherwise(0)).alias(f"{s}_windows") for s in ("train", "valid", "test")])
    out = w.join(sizes, ["g", "tsf_cell"]).withColumnRenamed("g", "subset")
    return out.withColumns({f"supports_{k}shot": F.col("unit_count") >= k for k in (1, 5, 10, 50)})


def quantile_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, maximum and mean of each column; what is no number is left out."""
    x = F.expr("try_cast(v.x as double)")
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("x")) for c in columns])).alias("v")).select(*by, "v.metric", x.alias("x"))
    rows = rows.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    keys = [*by, "metric"]
    s = rows.groupBy(*keys).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.count("x").alias("n"))
    q = quantiles(rows, "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys).withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.expr(" and ".join(f"{k} <=> __{k}" for k in keys))
    return s.join(q, same, "left").select(*keys, "min", "p25", "p50", "p75", "max", "mean", "n")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of average ranks. Ranks come from counts of distinct values, not from one long sort."""
    t = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()

    def ranks(c: str) -> DataFrame:
        return value_ranks(t, c).select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    return t.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def compare(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("stl", "proxy")) -> DataFrame:
    """Two labellings of items side by side with columns suffixed, and whether their cells agree."""
    cols = [*METRICS, "tsf_cell"]
    x, y = (d.select(*ITEM, *[F.col(c).alias(f"{c}_{n}") for c in cols]) for d, n in zip((left, right), names, strict=True))
    return x.join(y, ITEM).withColumn("same_cell", F.col(f"tsf_cell_{names[0]}") == F.col(f"tsf_cell_{names[1]}"))


def evaluate_series(series: DataFrame, kernel, schema: str) -> DataFrame:
    """An outside quality kernel (values, period) -> dict for each series, in Arrow batches; no shuffle."""
    import pandas as pd

    def run(parts):
        for p in parts:
            rows = [kernel(v, int(k)) for v, k in zip(p["values"], p["period"], strict=True)]
            made = pd.DataFrame(rows, index=p.index)
            yield pd.concat([p.drop(columns=["values"]), made], axis=1)

    return series.mapInPandas(run, schema)
