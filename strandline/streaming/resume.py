"""Incremental evaluation of arriving series with Structured Streaming: batch results, keep-last reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.sampling import keep_last, resume
from strandline.sources.tables import found


def finished(spark: SparkSession, out: str) -> DataFrame | None:
    """Results of the batches whose writing ended, or None; what a lost job left half written is not read."""
    done = [p.removesuffix("/_SUCCESS") for p in found(spark, f"{out}/batch_seq=*/_SUCCESS")]
    return spark.read.option("basePath", out).parquet(*done) if done else None


def evaluate_arrivals(source: DataFrame, evaluate: Callable[[DataFrame], DataFrame], keys: Sequence[str], out: str, checkpoint: str) -> None:
    """Evaluates each batch's keys that have no result yet and appends them; a batch run again replaces its own."""

    def run(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        done = finished(spark, out)
        todo = batch if done is None else resume(batch, done.filter(F.col("batch_seq") != k), keys)
        evaluate(todo).write.mode("overwrite").parquet(f"{out}/batch_seq={k}")

    source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def results(spark, out: str, keys: Sequence[str]) -> DataFrame:
    """The last result of each key. Without any finished batch this raises."""
    done = finished(spark, out)
    if done is None:
        raise FileNotFoundError(f"no finished batch in {out}")
    return keep_last(done, keys, "batch_seq")
