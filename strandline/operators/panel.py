"""Panels, series and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.arrays import finite

ITEM = ["subset", "item_id"]
SERIES = [*ITEM, "channel"]
SETTINGS = ((96, 96), (192, 96), (336, 96))


def first_items(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the n smallest item ids of each subset."""
    items = panel.select(*ITEM).distinct()
    few = items.withColumn("k", F.row_number().over(Window.partitionBy("subset").orderBy("item_id"))).filter(F.col("k") <= n)
    return panel.join(few.drop("k"), ITEM, "left_semi")


def to_long(panel: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row for each time and channel."""
    return panel.unpivot([c for c in panel.columns if c not in channels], list(channels), "channel", "value")


def indexed(panel: DataFrame) -> DataFrame:
    """The 0-based place of each row in its item by time, as ``idx``."""
    return panel.withColumn("idx", F.row_number().over(Window.partitionBy(*ITEM).orderBy("date_time")) - 1)


def series(panel: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(subset, item_id, channel, values, length): arrays in time order, one shuffle by item."""
    packed = panel.groupBy(*ITEM).agg(F.sort_array(F.collect_list(F.struct("date_time", *channels))).alias("rows"))

    def values(channel: str) -> Column:
        return F.transform("rows", lambda r: r[channel].cast("double")).alias("values")

    arrays = F.array(*[F.struct(F.lit(c).alias("channel"), values(c)) for c in channels])
    return packed.select(*ITEM, F.explode(arrays).alias("s")).select(*ITEM, "s.channel", "s.values", F.size("s.values").alias("length"))


def lengths(panel: DataFrame) -> DataFrame:
    """Rows and first and last time of each item."""
    return panel.groupBy(*ITEM).agg(F.count("*").alias("length"), F.min("date_time").alias("start_time"), F.max("date_time").alias("end_time"))


def valid_start(pre: Column, valid_share: float = 0.2) -> Column:
    """Where valid starts among ``pre`` rows before the cut-off."""
    return pre - F.floor(pre * valid_share).cast("int")


def split_bounds(panel: DataFrame, cutoff: str, valid_share: float = 0.2) -> DataFrame:
    """(subset, item_id, split, split_start_idx, split_end_idx, item_length), half open.

    Test starts at the cut-off; valid is the truncated share of what lies before, train the rest.
    """
    n = panel.groupBy(*ITEM).agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("date_time") < F.lit(cutoff).cast("timestamp")).cast("int").alias("pre"))
    n = n.withColumn("cut", valid_start(F.col("pre"), valid_share))
    bounds = [("train", F.lit(0), F.col("cut")), ("valid", F.col("cut"), F.col("pre")), ("test", F.col("pre"), F.col("n"))]
    rows = F.array(*[F.struct(F.lit(s).alias("split"), a.alias("split_start_idx"), b.alias("split_end_idx")) for s, a, b in bounds])
    return n.select(*ITEM, F.explode(rows).alias("b"), F.col("n").alias("item_length")).select(*ITEM, "b.*", "item_length")


def split_lengths(panel: DataFrame, cutoff: str) -> DataFrame:
    return split_bounds(panel, cutoff).select(*ITEM, "split", (F.col("split_end_idx") - F.col("split_start_idx")).alias("split_length"))


def window_count(length: Column, history: Column | int, pred: Column | int) -> Column:
    """Dense windows that lie in a stretch of that length."""
    return F.greatest(length - history - pred + 1, F.lit(0))


def window_counts(panel: DataFrame, cutoff: str, channels: int, settings: Sequence[tuple[int, int]] = SETTINGS) -> DataFrame:
    """Windows of each item, split and (history, pred) setting; channel windows are item windows times channels."""
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("seq_len"), F.lit(p).alias("pred_len")) for h, p in settings]))
    rows = split_lengths(panel, cutoff).withColumn("s", grid).select(*ITEM, "split", "split_length", "s.*")
    rows = rows.withColumn("item_windows", window_count(F.col("split_length"), F.col("seq_len"), F.col("pred_len")))
    return rows.withColumn("channel_windows", F.col("item_windows") * channels)


def downsample(values: Column, most: int) -> Column:
    """At most so many values at truncated equal distances, both ends among them."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / F.lit(most - 1)).cast("int"))
    return F.when(n > most, F.transform(at, lambda i: F.get(values, i))).otherwise(values)


def strided(df: DataFrame, order: Sequence[str], stride: int, most: int | None = None) -> DataFrame:
    """Every stride-th row in the order given, the first ``most`` of them.

    The first are found among the least rows of each task. Without ``most``, rows are counted within equal
    values of all columns of the order but the last, and these groups are put in order by their counts.
    """
    one = Window.partitionBy(F.lit(0))
    if most:
        first = df.orderBy(*order).limit(stride * most)
        return first.withColumn("__i", F.row_number().over(one.orderBy(*order)) - 1).filter(F.col("__i") % stride == 0).drop("__i")
    group = list(order[:-1])
    if not group:
        return df.withColumn("__i", F.row_number().over(one.orderBy(*order)) - 1).filter(F.col("__i") % stride == 0).drop("__i")
    before = F.sum("__n").over(one.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1))
    offsets = df.groupBy(*group).agg(F.count("*").alias("__n")).withColumn("__o", F.coalesce(before, F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)], "__o")
    same = F.expr(" and ".join(f"{c} <=> __g{k}" for k, c in enumerate(group)))
    rows = df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(order[-1])) - 1).join(offsets, same)
    return rows.filter((F.col("__o") + F.col("__r")) % stride == 0).select(*df.columns)


def replicate(items: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Each item's measures once for each channel."""
    return items.withColumn("channel", F.explode(F.array(*map(F.lit, channels))))


def representative(panel: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(subset, item_id, date_time, value): the mean of the channels' z-scores at each time, missing values left out."""
    w = Window.partitionBy(*ITEM)
    z = [(finite(F.col(c).cast("double")) - F.avg(finite(F.col(c).cast("double"))).over(w)) / (F.stddev_pop(finite(F.col(c).cast("double"))).over(w) + 1e-8) for c in channels]
    there = F.filter(F.array(*z), lambda x: x.isNotNull())
    return panel.select(*ITEM, "date_time", F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)).alias("value"))
