"""Audits of caches and gates, pathology of errors, and splits that keep items apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.arrays import finite
from strandline.operators.experts import WINDOW
from strandline.operators.oracle import worst_windows


def proxy_coverage(windows: DataFrame, proxy: DataFrame) -> DataFrame:
    """One row: windows, rows of the proxy table, windows that have one, and windows that have none. Only ids are read."""
    w, p = windows.select(WINDOW).withColumn("__w", F.lit(1)), proxy.select(WINDOW).distinct().withColumn("__p", F.lit(1))
    both = w.join(p, WINDOW, "left").agg(F.count("*").alias("windows"), F.count("__p").alias("joined"))
    rows = proxy.select(WINDOW).agg(F.count("*").alias("proxy_rows"))
    return both.crossJoin(rows).select("windows", "proxy_rows", "joined", (F.col("windows") - F.col("joined")).alias("missing"))  # one row each


def cache_audit(predictions: DataFrame, errors: DataFrame, pred_len: int | None = None) -> DataFrame:
    """One row: rows, whether keys are unique, windows of both tables and of their overlap, experts, and whether every
    forecast is as long as the manifest says."""
    key = [WINDOW, F.col("expert_id").cast("string").alias("expert_id")]
    p = predictions.select(*key, F.size("yhat").alias("n")).groupBy(WINDOW, "expert_id").agg(F.count("*").alias("p"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    e = errors.select(*key).groupBy(WINDOW, "expert_id").agg(F.count("*").alias("e"))
    by_window = p.join(e, [WINDOW, "expert_id"], "full").groupBy(WINDOW)
    w = by_window.agg(F.sum("p").alias("p"), F.sum("e").alias("e"), F.max("p").alias("mp"), F.max("e").alias("me"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("expert_id").alias("x"))
    s = w.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("prediction_rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("error_rows"),
        F.coalesce(F.max("mp") <= 1, F.lit(True)).alias("unique_prediction_key"),
        F.coalesce(F.max("me") <= 1, F.lit(True)).alias("unique_error_key"),
        F.count_if(F.col("p").isNotNull()).alias("prediction_windows"),
        F.count_if(F.col("e").isNotNull()).alias("error_windows"),
        F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("window_overlap"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("x")))), ",").alias("experts"),
    )
    same = F.col("lo").eqNullSafe(F.col("hi"))
    return s.withColumn("horizon", F.when(same, F.col("lo"))).withColumn("horizon_matches_manifest", F.lit(True) if pred_len is None else same & (F.col("hi") == pred_len)).drop("lo", "hi")


def checked_predictions(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """Predictions beside their targets; one without a target, or of another length, raises."""
    j = predictions.join(targets.select(WINDOW, "target"), WINDOW, "left")
    missing = F.raise_error(F.concat(F.lit("no target for "), F.col(WINDOW))).cast("array<double>")
    shape = F.raise_error(F.concat(F.lit("a prediction of another length than its target for "), F.col(WINDOW))).cast("array<double>")
    return j.withColumn("target", F.when(F.col("target").isNull(), missing).when(F.size("target") != F.size("yhat"), shape).otherwise(F.col("target")))


def std_bin(std: Column) -> Column:
    """The power of ten that a deviation reaches; null for one that is not positive and finite."""
    x = finite(std)
    return F.when(x > 0, F.floor(F.log10(x)).cast("int"))


def by_std_bin(errors: DataFrame, std: str = "scaler_std") -> DataFrame:
    """Rows, mean errors and share of the expert's total mse by expert and power of ten of the window's deviation."""
    fine = errors.groupBy("expert_id", std_bin(F.col(std)).alias("std_bin")).agg(F.count("*").alias("windows"), F.avg("mse").alias("mean_mse"), F.avg("mae").alias("mean_mae"), F.max("mse").alias("max_mse"), F.sum("mse").alias("s"))
    total = fine.groupBy("expert_id").agg(F.sum("s").alias("t"))
    return fine.join(total, "expert_id").select("expert_id", "std_bin", "windows", "mean_mse", "mean_mae", "max_mse", F.try_divide("s", "t").alias("mse_share"))


def outlier_contribution(errors: DataFrame, tops: Sequence[int] = (1, 10, 100)) -> DataFrame:
    """What share of an expert's total mse its worst windows hold, for each number of them."""
    worst = worst_windows(errors, max(tops))
    k = F.explode(F.array(*[F.lit(t) for t in tops])).alias("top")
    return worst.select("*", k).filter("worst_rank <= top").groupBy("expert_id", "top").agg(F.sum("share").alias("mse_share"), F.min("mse").alias("least_mse"))


def item_split(df: DataFrame, shares: dict[str, float], seed: int, keys: Sequence[str] = ("subset", "item_id")) -> DataFrame:
    """df with ``item_split``: whole items go to one part, by a seeded hash and in these shares, so that parts have no item in common."""
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    u = F.conv(F.substring(F.sha1(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, at = F.lit(None).cast("string"), sum(shares.values())
    for part, share in reversed(list(shares.items())):
        out = F.when(u < at, F.lit(part)).otherwise(out)
        at -= share
    return df.withColumn("item_split", out)


def gate_report(errors: DataFrame, gates: DataFrame, by: Sequence[str] = (), eps: float = 1e-8) -> DataFrame:
    """Of gates (gate, physical_window_id, expert_id, gate_weight) against ranked errors with soft-oracle weights: the divergence
    KL(soft oracle || gate), the mean mse and mae that the weights expect, the gates' entropy and the share of the oracle gap that
    they close between the best fixed expert and the oracle."""
    j = errors.join(gates, [WINDOW, "expert_id"])
    w, q = F.col("gate_weight"), F.col("soft_oracle_weight")
    kl = F.when(q > 0, q * (F.ln(q + eps) - F.ln(w + eps))).otherwise(0.0)
    one = j.groupBy("gate", WINDOW, *by).agg(
        F.sum(kl).alias("kl"), F.sum(w * F.col("mse")).alias("mse"), F.sum(w * F.col("mae")).alias("mae"), F.sum(-w * F.ln(w + eps)).alias("entropy"), F.min("mse").alias("oracle")
    )
    sums = one.groupBy("gate", *by).agg(F.count("*").alias("windows"), F.avg("kl").alias("kl"), F.avg("mse").alias("mean_mse"), F.avg("mae").alias("mean_mae"), F.avg("entropy").alias("gate_entropy"), F.avg("oracle").alias("oracle_mse"))
    fixed = errors.groupBy(*by, "expert_id").agg(F.avg("mse").alias("m")).groupBy(*by).agg(F.min("m").alias("best_fixed_mse"))
    out = sums.join(fixed, list(by)) if by else sums.crossJoin(fixed)  # one row without groups
    return out.withColumn("gap_reduction", F.try_divide(F.col("best_fixed_mse") - F.col("mean_mse"), F.col("best_fixed_mse") - F.col("oracle_mse")))


def baseline_gates(errors: DataFrame) -> DataFrame:
    """The gates without input: all weight on the expert that is best over all windows, and equal weights."""
    best = errors.groupBy("expert_id").agg(F.avg("mse").alias("m")).agg(F.min(F.struct("m", "expert_id"))["expert_id"].alias("__best"))
    n = errors.agg(F.count_distinct("expert_id").alias("__n"))
    rows = errors.select(WINDOW, "expert_id").crossJoin(F.broadcast(best)).crossJoin(F.broadcast(n))  # one row each
    gates = F.explode(F.array(F.struct(F.lit("fixed_best").alias("gate"), (F.col("expert_id") == F.col("__best")).cast("double").alias("gate_weight")), F.struct(F.lit("uniform").alias("gate"), (1.0 / F.col("__n")).alias("gate_weight"))))
    return rows.select(WINDOW, "expert_id", gates.alias("g")).select("g.gate", WINDOW, "expert_id", "g.gate_weight")
