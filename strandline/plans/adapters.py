"""A panel of weekly supplier series from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import panel as P
from strandline.operators.codebook import CODES, official_codebook
from strandline.operators.registry import Periods, RegistryConfig, build_registry

CHANNELS = ("ind_1", "ind_2", "ind_3")
CUTOFF = "2000-07-01 00:00:00"
PERIODS = Periods({"hour": 4, "min": 13})
CONFIG = RegistryConfig(history_len=24, pred_len=8, sample_stride=8, channels=CHANNELS, cutoff=CUTOFF)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subset, item_id, date_time, cluster, ind_1 quantity, ind_2 lines, ind_3 largest line number) by supplier and week."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("l_suppkey") % 8).cast("int"))
    return line.groupBy(
        F.when(F.col("l_suppkey") % 2 == 0, "hour").otherwise("min").alias("subset"),
        F.col("l_suppkey").alias("item_id"),
        F.date_trunc("week", "l_shipdate").alias("date_time"),
        code.alias("cluster"),
    ).agg(F.sum("l_quantity").alias("ind_1"), F.count("*").cast("double").alias("ind_2"), F.max("l_linenumber").cast("double").alias("ind_3"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.series(panel(spark, sf_dir), CHANNELS)


def registry(spark: SparkSession, sf_dir: str, config: RegistryConfig = CONFIG) -> DataFrame:
    return build_registry(panel(spark, sf_dir), official_codebook(spark), config, PERIODS)


def windows(spark: SparkSession, sf_dir: str, target: bool = True, config: RegistryConfig = CONFIG) -> DataFrame:
    return build_registry(panel(spark, sf_dir), official_codebook(spark), config, PERIODS, values=("history", "target") if target else ("history",))


#: Windows as long as those of the published timings.
LONG = RegistryConfig(history_len=192, pred_len=96, sample_stride=8, channels=CHANNELS, cutoff=CUTOFF)


def long_windows(spark: SparkSession, sf_dir: str, target: bool = True) -> DataFrame:
    """Windows of 192 and 96 days over daily series of 64 groups of suppliers."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("item_id", F.col("l_suppkey") % 64)
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("item_id") % 8).cast("int"))
    days = line.groupBy(F.when(F.col("item_id") % 2 == 0, "hour").otherwise("min").alias("subset"), "item_id", F.date_trunc("day", "l_shipdate").alias("date_time"), code.alias("cluster")).agg(
        F.sum("l_quantity").alias("ind_1"), F.count("*").cast("double").alias("ind_2"), F.max("l_linenumber").cast("double").alias("ind_3")
    )
    return build_registry(days, official_codebook(spark), LONG, PERIODS, values=("history", "target") if target else ("history",))
