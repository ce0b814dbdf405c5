"""Checks of keys and columns, and small validations of arguments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ensure_unique_key(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """df, whose rows raise as they are read if a key comes twice. A part of the plan: nothing runs before df does."""
    n = F.count("*").over(Window.partitionBy(*keys))
    key = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    twice = F.raise_error(F.concat(F.lit(f"{name} repeats the key {', '.join(keys)}: "), key)).cast("boolean")
    return df.withColumn("__n", n).filter(F.when(F.col("__n") > 1, twice).otherwise(True)).drop("__n")


def parse_list(text: str | Sequence[str]) -> list[str]:
    """A comma list as its parts; empty is an error."""
    parts = [p.strip() for p in (text.split(",") if isinstance(text, str) else text) if p.strip()]
    if not parts:
        raise ValueError("the list is empty")
    return parts


def expert_ids(ids: str | Sequence[str], known: Iterable[str]) -> list[str]:
    """Names of experts: not empty, known and without repeats."""
    found = parse_list(ids)
    if unknown := sorted(set(found) - set(known)):
        raise ValueError(f"unknown experts {unknown}")
    if len(set(found)) != len(found):
        raise ValueError("experts are named twice")
    return found


def single_value(df: DataFrame, column: str) -> DataFrame:
    """One row: the only distinct value of a column that is not null, or null if there are several or none."""
    return df.agg(F.when(F.count_distinct(column) == 1, F.min(column)).alias(column))


def one_length(windows: DataFrame) -> DataFrame:
    """The windows, all of one history and one forecast length: several raise."""
    both = F.array_distinct(F.collect_set(F.struct("history_len", "pred_len")).over(Window.partitionBy("split")))
    bad = F.raise_error(F.lit("windows of several lengths")).cast("boolean")
    return windows.withColumn("__n", F.size(both)).filter(F.when(F.col("__n") > 1, bad).otherwise(True)).drop("__n")


def numbered(columns: Sequence[str], prefix: str) -> list[str]:
    """Columns prefix0, prefix1, ... in the order of their numbers."""
    return sorted((c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
