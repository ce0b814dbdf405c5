"""Registries of forecast windows with reproducible identifiers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.checks import require_columns
from strandline.operators.panel import ITEM, valid_start

POLICIES = ("overlap", "strict_within_split")


@dataclass(frozen=True)
class RegistryConfig:
    """What a registry holds. ``overlap`` lets valid and test histories reach into
    the split before; a policy of another name that ends in _overlap does the same under that name."""

    history_len: int = 192
    pred_len: int = 96
    sample_stride: int = 96
    channels: tuple[str, ...] = ("ind_1", "ind_2", "ind_3", "ind_4", "ind_5")
    subsets: tuple[str, ...] = ("hour", "min")
    split_strategy: str = "temporal"
    split_context_policy: str = "overlap"
    cutoff: str = "2023-07-28 00:00:00"
    item_level_split: bool = False
    dataset: str = "panel"
    revision: str = "1"
    data_version: str = "1"


@dataclass(frozen=True)
class Periods:
    by_subset: dict = field(default_factory=lambda: {"hour": 24, "min": 144})

    def column(self, subset: str = "subset") -> Column:
        out = F.lit(None).cast("int")
        for k, v in sorted(self.by_subset.items()):
            out = F.when(F.col(subset) == k, F.lit(v)).otherwise(out)
        return out


def canonical(data: dict) -> str:
    return json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(data: dict, length: int) -> str:
    return hashlib.sha1(canonical(data).encode()).hexdigest()[:length]


# The fields of the configuration and the layouts of ids are those that equal ids need.


def config_hash(config: RegistryConfig) -> str:
    return digest(asdict(config), 12)


def base_registry_id(config: RegistryConfig, prefix: str = "reg") -> str:
    """Names the legal windows, whatever the stride and the channels."""
    legal = {k: v for k, v in asdict(config).items() if k not in ("sample_stride", "channels")}
    return f"{prefix}_h{config.history_len}_p{config.pred_len}_{config.split_context_policy}_{digest(legal, 8)}"


def sample_set_id(config: RegistryConfig, prefix: str = "reg") -> str:
    return f"{base_registry_id(config, prefix)}_stride{config.sample_stride}_{digest(asdict(config), 8)}"


def window_id(config: RegistryConfig) -> Column:
    """First 16 hex digits of the SHA-1 of the canonical JSON of a window's identity."""
    fields = {
        "channel": F.col("channel"),
        "data_version": F.lit(config.data_version),
        "dataset": F.lit(config.dataset),
        "history_len": F.lit(config.history_len),
        "item_id": F.col("item_id"),
        "pred_len": F.lit(config.pred_len),
        "revision": F.lit(config.revision),
        "split": F.col("split"),
        "subset": F.col("subset"),
        "target_start_idx": F.col("target_start_idx"),
    }
    return F.substring(F.sha1(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]))), 1, 16)


def offsets(split: Column, start: Column, end: Column, history: int, pred: int, stride: int, policy: str) -> Column:
    """Target starts of the windows of a split; an empty array if none fits. Under an overlap policy, valid and test start at their split's start."""
    if stride <= 0:
        raise ValueError("the stride must be positive")
    if policy not in POLICIES and not policy.endswith("_overlap"):
        raise ValueError(f"unknown policy {policy}")
    first = start + history if policy == "strict_within_split" else F.when(split == "train", start + history).otherwise(start)
    last = end - pred
    return F.when(first <= last, F.sequence(first, last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _stop(test: Column, why: str, value: Column, kind: str) -> Column:
    """value, or an error that names the item if the test holds."""
    return F.when(test, F.raise_error(F.concat(F.lit(f"{why} in item "), F.col("item_id").cast("string"))).cast(kind)).otherwise(value)


def _items(panel: DataFrame, codebook: DataFrame, config: RegistryConfig, values: bool) -> DataFrame:
    """One row for each item: its times in order, with ``values`` its rows in order too, its splits, its cluster and cell. The only
    shuffle, by item.

    An item with several or unknown clusters raises.
    """
    ordered = F.sort_array(F.collect_list(F.struct("date_time", *config.channels) if values else F.col("date_time"))).alias("rows")
    one = panel.groupBy(*ITEM).agg(ordered, F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    one = one.withColumn("times", F.transform("rows", lambda r: r["date_time"]) if values else F.col("rows")).withColumn("item_length", F.size("times"))
    one = one.withColumn("pre", F.size(F.filter("times", lambda t: t < F.lit(config.cutoff).cast("timestamp"))))
    one = one.withColumn("cut", valid_start(F.col("pre")))
    bounds = (("train", F.lit(0), F.col("cut")), ("valid", F.col("cut"), F.col("pre")), ("test", F.col("pre"), F.col("item_length")))
    one = one.withColumn("splits", F.array(*[F.struct(F.lit(k).alias("split"), a.alias("split_start_idx"), b.alias("split_end_idx")) for k, a, b in bounds]))
    book = codebook.select(F.col("official_cluster_code").alias("lo"), "official_tsf_cell")
    found = one.join(book, "lo", "left")
    cell = _stop(F.col("official_tsf_cell").isNull(), "cluster without cell", F.col("official_tsf_cell"), "string")
    return found.select(*ITEM, "rows", "times", "item_length", "splits", F.col("lo").alias("official_cluster"), _stop(F.col("lo") != F.col("hi"), "several clusters", cell, "string").alias("official_tsf_cell"))


def build_registry(panel: DataFrame, codebook: DataFrame, config: RegistryConfig, periods: Periods | None = None, prefix: str = "reg", values: Sequence[str] = ()) -> DataFrame:
    """One row for each window and channel. Items are the only shuffle key.

    ``values`` may name ``history`` and ``target``: then these arrays are cut beside the windows, without a join.
    A window that starts before its item raises.
    """
    require_columns(panel, [*ITEM, "date_time", "cluster", *config.channels], "panel")
    periods = periods or Periods()
    h, p = config.history_len, config.pred_len
    items = _items(panel.filter(F.col("subset").isin(*config.subsets)), codebook, config, bool(values))

    def channel(c: str) -> Column:
        arrays = [F.transform("rows", lambda r: r[c].cast("double")).alias("values")] if values else []
        return F.struct(F.lit(c).alias("channel"), *arrays)

    series = F.array(*map(channel, config.channels))
    rows = items.withColumn("c", F.explode(series)).select(*ITEM, "times", "item_length", "splits", "official_cluster", "official_tsf_cell", "c.*")

    def window(s: Column, t: Column) -> Column:
        arrays = {"history": F.slice("values", t - h + 1, F.lit(h)), "target": F.slice("values", t + 1, F.lit(p))}
        return F.struct(
            s["split"].alias("split"),
            s["split_start_idx"].alias("split_start_idx"),
            s["split_end_idx"].alias("split_end_idx"),
            _stop(t < h, "a window starts before the first row", t, "int").alias("target_start_idx"),
            *[F.get("times", i).alias(f"{k}_time") for k, i in (("history_start", t - h), ("history_end", t - 1), ("target_start", t), ("target_end", t + p - 1))],
            *[arrays[v].alias(v) for v in values],
        )

    def of_split(s: Column) -> Column:
        at = offsets(s["split"], s["split_start_idx"], s["split_end_idx"], h, p, config.sample_stride, config.split_context_policy)
        return F.transform(at, lambda t: window(s, t))

    # what a window needs is cut out before windows become rows, so that these do not carry their whole series
    rows = rows.withColumn("w", F.explode(F.flatten(F.transform("splits", of_split))))
    rows = rows.select(*ITEM, "channel", "item_length", "official_cluster", "official_tsf_cell", "w.*")
    # written out here, where they are left out if nothing reads them
    rows = rows.withColumns({f"{k}_time": F.date_format(f"{k}_time", "yyyy-MM-dd'T'HH:mm:ss") for k in ("history_start", "history_end", "target_start", "target_end")})
    start = F.col("target_start_idx")
    pid = window_id(config)
    return rows.select(
        *[F.lit(v).alias(k) for k, v in (("dataset", config.dataset), ("revision", config.revision), ("data_version", config.data_version))],
        *ITEM,
        "channel",
        "split",
        "target_start_idx",
        F.lit(h).alias("history_len"),
        F.lit(p).alias("pred_len"),
        (start - h).alias("start_idx"),
        F.lit(config.sample_stride).alias("sample_stride"),
        F.lit(config.split_context_policy).alias("split_context_policy"),
        F.lit(base_registry_id(config, prefix)).alias("base_registry_id"),
        F.lit(sample_set_id(config, prefix)).alias("sample_set_id"),
        F.lit(config_hash(config)).alias("config_hash"),
        pid.alias("physical_window_id"),
        pid.alias("window_id"),
        periods.column().alias("period"),
        "official_cluster",
        "official_tsf_cell",
        (start - h).alias("history_start_idx"),
        start.alias("history_end_idx"),
        (start + p).alias("target_end_idx"),
        "history_start_time",
        "history_end_time",
        "target_start_time",
        "target_end_time",
        "split_start_idx",
        "split_end_idx",
        "item_length",
        (F.col("split_end_idx") - F.col("split_start_idx")).alias("split_length"),
        *values,
    )


def count_table(registry: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct windows and distinct items of each group; null is a group."""
    return registry.groupBy(*columns).agg(F.count("*").alias("rows"), F.count_distinct("physical_window_id").alias("windows"), F.count_distinct("subset", "item_id").alias("items"))


def registry_audit(registry: DataFrame) -> DataFrame:
    """One row: totals, and the smallest group of (split, subset), of (split, subset, cell) and of (subset, item, channel)."""
    sums = registry.agg(F.count("*").alias("rows"), F.count_distinct("physical_window_id").alias("windows"), F.count_distinct("subset", "item_id").alias("items"), F.count_distinct("channel").alias("channels"))
    fine = registry.groupBy("split", "subset", "official_tsf_cell").agg(F.count("*").alias("n"))
    small = fine.groupBy("split", "subset").agg(F.sum("n").alias("m"), F.min("n").alias("k")).agg(F.min("m").alias("min_split_subset"), F.min("k").alias("min_split_subset_cell"))
    units = registry.groupBy("subset", "item_id", "channel").agg(F.count("*").alias("n")).agg(F.min("n").alias("min_item_channel"))
    return sums.crossJoin(small).crossJoin(units)  # one row each


#: The tables of the audit and their columns.
COUNT_TABLES = {
    "split": ("split",),
    "subset": ("subset",),
    "cell": ("official_tsf_cell",),
    "split_subset_cell": ("split", "subset", "official_tsf_cell"),
    "item_channel": ("subset", "item_id", "channel"),
}


def audit_tables(registry: DataFrame) -> dict[str, DataFrame]:
    """The five tables of counts of the audit."""
    return {name: count_table(registry, columns) for name, columns in COUNT_TABLES.items()}


def with_values(registry: DataFrame, series: DataFrame, target: bool = True) -> DataFrame:
    """The registry with ``history`` and ``target`` arrays; a window outside its series raises."""
    joined = registry.join(series.select(*ITEM, "channel", "values"), [*ITEM, "channel"], "left")
    end = F.col("target_end_idx" if target else "history_end_idx")
    bad = F.col("values").isNull() | (F.col("history_start_idx") < 0) | (end > F.size("values")) | (F.col("history_start_idx") >= F.col("history_end_idx"))
    values = F.when(bad, F.raise_error(F.concat(F.lit("no values for window "), F.col("physical_window_id"))).cast("array<double>")).otherwise(F.col("values"))
    out = joined.withColumn("history", F.slice(values, F.col("history_start_idx") + 1, F.col("history_end_idx") - F.col("history_start_idx")))
    if target:
        out = out.withColumn("target", F.slice("values", F.col("target_start_idx") + 1, F.col("target_end_idx") - F.col("target_start_idx")))
    return out.drop("values")
