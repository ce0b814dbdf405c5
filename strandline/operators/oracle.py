"""Summaries of experts: fixed, oracle and ensemble, overall and by group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.arrays import absolute_error, let, squared_error
from strandline.functions.ranks import quantiles
from strandline.operators.checks import ensure_unique_key
from strandline.operators.experts import EXPERTS, WINDOW, scored


def union_caches(tables: Sequence[DataFrame], experts: Sequence[str] | None = None) -> DataFrame:
    """All caches' rows of the experts asked for; a repeated (window, expert) raises."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    if experts:
        out = out.filter(F.col("expert_id").cast("string").isin(*map(str, experts)))
    return ensure_unique_key(out, [WINDOW, "expert_id"], "caches")


def common_windows(df: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Rows of the experts asked for in windows that have all of them."""
    rows = df.filter(F.col("expert_id").cast("string").isin(*map(str, experts)))
    full = rows.groupBy(WINDOW).agg(F.count_distinct("expert_id").alias("n")).filter(F.col("n") == len(set(map(str, experts)))).select(WINDOW)
    return rows.join(full, WINDOW, "left_semi")


def _groups(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Each row once for the whole and once for each grouping column, as (group_kind, group_value)."""
    kinds = [("overall", F.lit("all"))] + [(c, F.col(c).cast("string")) for c in by if c in df.columns]
    g = F.explode(F.array(*[F.struct(F.lit(k).alias("group_kind"), v.alias("group_value")) for k, v in kinds]))
    return df.withColumn("__g", g).withColumns({"group_kind": F.col("__g.group_kind"), "group_value": F.col("__g.group_value")}).drop("__g"), ["group_kind", "group_value"]


def per_window(errors: DataFrame, by: Sequence[str] = (), temperature: float = 1.0) -> DataFrame:
    """One row for each window: least and mean mse, the mae of the expert with the least mse, entropy of soft weights."""
    z = -F.col("mse") / max(temperature, 1e-8)
    best = F.min_by(F.struct("mae", "expert_id"), F.struct("mse", "expert_id"))
    collected = errors.groupBy(WINDOW, *by).agg(F.min("mse").alias("oracle_mse"), best["mae"].alias("oracle_mae"), F.avg("mse").alias("mean_mse"), F.collect_list(z).alias("z"))
    e = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    s = F.greatest(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), F.lit(1e-8))
    entropy = F.aggregate(F.transform(e, lambda x: -(x / s) * F.ln(x / s + 1e-8)), F.lit(0.0), lambda a, x: a + x)
    return collected.withColumn("entropy", entropy).drop("z")


#: Measures of a window that the audit averages, by the name of the average.
AVERAGED = {"oracle_mse": "oracle_mse", "oracle_mae": "oracle_mae", "uniform_proxy_mse": "mean_mse", "true_uniform_mse": "uniform_mse", "true_uniform_mae": "uniform_mae", "soft_oracle_entropy": "entropy"}


def _averages(df: DataFrame, keys: Sequence[str], by: Sequence[str], averaged: dict[str, str]) -> DataFrame:
    """Rows and averages for the whole and for each value of each column of ``by``: rows are summed up once, by all of
    ``by`` together, and these few sums are what is copied for each grouping."""
    fine = df.groupBy(*by, *keys).agg(F.count("*").alias("__rows"), *[f(c).alias(f"__{k}_{n}") for n, c in averaged.items() for k, f in (("s", F.sum), ("n", F.count))])
    g, group = _groups(fine, by)
    sums = g.groupBy(*group, *keys).agg(F.sum("__rows").alias("__rows"), *[F.sum(f"__{k}_{n}").alias(f"__{k}_{n}") for n in averaged for k in "sn"])
    return sums.select(*group, *keys, "__rows", *[F.try_divide(f"__s_{n}", f"__n_{n}").alias(n) for n in averaged])


def _gaps(df: DataFrame) -> DataFrame:
    return df.withColumn("oracle_gap", F.col("best_fixed_mse") - F.col("oracle_mse")).withColumn("gap_vs_uniform", F.col("true_uniform_mse") - F.col("oracle_mse"))


def oracle_audit(errors: DataFrame, uniform: DataFrame | None = None, by: Sequence[str] = ("split", "subset", "official_tsf_cell"), temperature: float = 1.0) -> DataFrame:
    """One row overall and for each value of each grouping column.

    Best fixed is the expert with the least mean mse (ties: mean mae, then name). The oracle takes each
    window's least mse. ``uniform`` (physical_window_id, uniform_mse, uniform_mae) adds the true ensemble.
    """
    own = [c for c in by if c in errors.columns]
    keys = ["group_kind", "group_value"]
    fixed = _averages(errors, ["expert_id"], own, {"m": "mse", "a": "mae"}).groupBy(*keys).agg(F.min(F.struct("m", "a", "expert_id")).alias("f"))
    fixed = fixed.select(*keys, F.col("f.expert_id").alias("best_fixed_expert"), F.col("f.m").alias("best_fixed_mse"), F.col("f.a").alias("best_fixed_mae"))
    w = per_window(errors, own, temperature)
    if uniform is not None:
        w = w.join(uniform.select(WINDOW, "uniform_mse", "uniform_mae"), WINDOW, "left")
    else:
        w = w.withColumns({"uniform_mse": F.lit(None).cast("double"), "uniform_mae": F.lit(None).cast("double")})
    sums = _averages(w, [], own, AVERAGED).withColumnRenamed("__rows", "windows")
    out = sums.join(fixed.withColumnsRenamed({k: f"f_{k}" for k in keys}), F.expr(" and ".join(f"{k} <=> f_{k}" for k in keys))).drop(*[f"f_{k}" for k in keys])
    return _gaps(out)


def window_audit(windows: DataFrame, experts: Sequence[str] = tuple(EXPERTS), by: Sequence[str] = ("split", "subset", "official_tsf_cell"), temperature: float = 1.0) -> DataFrame:
    """The audit straight from windows with history and target: experts, ensemble and oracle are scored beside their window,
    in one pass, and only sums for each value of ``by`` are shuffled."""
    own = [c for c in by if c in windows.columns]
    rows = scored(windows, experts)
    z = F.transform("e", lambda x: -x["mse"] / max(temperature, 1e-8))
    soft = let(z, lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))
    share = let(soft, lambda a: let(F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(1e-8)), lambda t: F.transform(a, lambda x: x / t)))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, x: s - x * F.ln(x + 1e-8))
    best = F.array_min(F.transform("e", lambda x: F.struct(x["mse"].alias("mse"), x["expert_id"].alias("expert_id"), x["mae"].alias("mae"))))
    mean_mse = F.aggregate("e", F.lit(0.0), lambda s, x: s + x["mse"]) / F.size("e")
    each = {f"__{m}{k}": F.get("e", F.lit(k))[m] for k in range(len(experts)) for m in ("mse", "mae")}
    flat = rows.select(*own, best.alias("b"), mean_mse.alias("mean_mse"), entropy.alias("entropy"), F.col("u.mse").alias("uniform_mse"), F.col("u.mae").alias("uniform_mae"), *[c.alias(k) for k, c in each.items()])
    flat = flat.withColumns({"oracle_mse": F.col("b.mse"), "oracle_mae": F.col("b.mae")}).drop("b")
    sums = _averages(flat, [], own, AVERAGED | {k: k for k in each}).withColumnRenamed("__rows", "windows")
    f = F.array_min(F.array(*[F.struct(F.col(f"__mse{k}").alias("m"), F.col(f"__mae{k}").alias("a"), F.lit(n).alias("expert_id")) for k, n in enumerate(experts)]))
    out = sums.withColumn("f", f).withColumns({"best_fixed_expert": F.col("f.expert_id"), "best_fixed_mse": F.col("f.m"), "best_fixed_mae": F.col("f.a")})
    return _gaps(out.drop("f", *each))


def oracle_summary(errors: DataFrame) -> DataFrame:
    """The overall row: windows, best fixed, oracle, uniform proxy and gap; zero windows and nulls without rows."""
    s = errors.groupBy(WINDOW).agg(F.min("mse").alias("o"), F.avg("mse").alias("u")).agg(F.count("*").alias("windows"), F.avg("o").alias("oracle_mse"), F.avg("u").alias("uniform_proxy_mse"))
    f = errors.groupBy("expert_id").agg(F.avg("mse").alias("m")).agg(F.min(F.struct("m", "expert_id")).alias("f"))
    both = s.crossJoin(f)  # one row each
    return both.select("windows", F.col("f.expert_id").alias("best_fixed_expert"), F.col("f.m").alias("best_fixed_mse"), "oracle_mse", "uniform_proxy_mse", (F.col("f.m") - F.col("oracle_mse")).alias("oracle_gap"))


def uniform_ensemble(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """(physical_window_id, uniform_mse, uniform_mae): errors of the mean of the experts' predictions.

    Arrays stay arrays: one row for each window and expert is shuffled. ``scored`` does without where experts are made here.
    """
    ys = predicted.groupBy(WINDOW).agg(F.collect_list("yhat").alias("ys"))
    both = ys.join(targets.select(WINDOW, "target"), WINDOW)
    mean = F.transform("target", lambda y, i: F.aggregate("ys", F.lit(0.0), lambda s, a: s + F.get(a, i)) / F.size("ys"))
    u = let(mean, lambda m: F.struct(squared_error(F.col("target"), m).alias("mse"), absolute_error(F.col("target"), m).alias("mae")))
    return both.select(WINDOW, u.alias("u")).select(WINDOW, F.col("u.mse").alias("uniform_mse"), F.col("u.mae").alias("uniform_mae"))


def expert_metrics(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean errors, top-1 rate and windows of each expert; with groups also its rank there by mse."""
    w = Window.partitionBy(WINDOW)
    order = "expert_order" if "expert_order" in errors.columns else "expert_id"
    top = errors.withColumn("__t", (F.row_number().over(w.orderBy("mse", order)) == 1).cast("double"))
    out = top.groupBy(*by, "expert_id").agg(F.avg("mse").alias("mean_mse"), F.avg("mae").alias("mean_mae"), F.avg("__t").alias("top1_rate"), F.count_distinct(WINDOW).alias("windows"))
    return out.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(*by).orderBy("mean_mse", "expert_id"))) if by else out


def cell_model_matrix(errors: DataFrame, cell: str = "official_tsf_cell") -> DataFrame:
    return expert_metrics(errors, [cell]).withColumnRenamed("rank_in_group", "rank_in_cell")


def comparison(tables: Sequence[DataFrame], experts: Sequence[str]) -> DataFrame:
    """The audit of windows that all experts have, overall, by split and by cell."""
    return oracle_audit(common_windows(union_caches(tables, experts), experts), by=("split", "official_tsf_cell"))


def weighted_mean(batches: DataFrame, metric: Column, n: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean of batch means weighted by their samples."""
    return batches.groupBy(*by).agg((F.sum(metric * n) / F.sum(n)).alias("value"), F.sum(n).alias("samples"))


def macro_mean(errors: DataFrame, unit: Sequence[str], by: Sequence[str] = ("expert_id",)) -> DataFrame:
    """Mean over units (items, cells) of the mean mse in each."""
    inner = errors.groupBy(*by, *unit).agg(F.avg("mse").alias("m"), F.avg("mae").alias("a"))
    return inner.groupBy(*by).agg(F.avg("m").alias("macro_mse"), F.avg("a").alias("macro_mae"), F.count("*").alias("units"))


def robust_metrics(errors: DataFrame, drop_top: int = 1, winsor: float = 0.99, delta: float = 1.0) -> DataFrame:
    """Each expert's mean mse without its worst windows, winsorized at a quantile, and the Huber loss of its root."""
    # the last of the windows to drop: all that come after it stay
    worst = errors.select("expert_id", F.col("mse").alias("__m"), F.col(WINDOW).alias("__w"))
    worst = worst.withColumn("k", F.row_number().over(Window.partitionBy("expert_id").orderBy(F.desc("__m"), "__w"))).filter(F.col("k") <= drop_top).filter(F.col("k") == drop_top).drop("k")
    r = errors.join(worst, "expert_id", "left").join(quantiles(errors, "mse", {"cap": winsor}, ["expert_id"]), "expert_id", "left")
    stays = (F.col("mse") < F.col("__m")) | ((F.col("mse") == F.col("__m")) & (F.col(WINDOW) > F.col("__w"))) if drop_top else F.lit(True)
    root = F.sqrt("mse")
    huber = F.when(root <= delta, F.col("mse") / 2).otherwise(delta * (root - delta / 2))
    return r.groupBy("expert_id").agg(F.avg(F.when(stays, F.col("mse"))).alias("drop_top_mse"), F.avg(F.least("mse", "cap")).alias("winsorized_mse"), F.avg(huber).alias("huber"))


def worst_windows(errors: DataFrame, top: int = 100) -> DataFrame:
    """The windows with the largest mse of each expert, their rank and their share of its total."""
    # a rank with a bound keeps few rows of each task before the shuffle; totals are sums of their own
    w = Window.partitionBy("expert_id").orderBy(F.desc("mse"), WINDOW)
    r = errors.select("expert_id", WINDOW, "mse").withColumn("worst_rank", F.row_number().over(w)).filter(F.col("worst_rank") <= top)
    totals = errors.groupBy("expert_id").agg(F.sum("mse").alias("__t"))
    return r.join(totals, "expert_id").select("expert_id", WINDOW, "mse", "worst_rank", (F.col("mse") / F.col("__t")).alias("share"))


def cache_overlap(caches: dict[str, DataFrame]) -> DataFrame:
    """Rows, distinct keys, windows and experts of each cache, and the windows that all of them have."""
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("cache"), WINDOW, F.col("expert_id").cast("string").alias("expert_id")) for k, df in caches.items()])
    every = tagged.select("cache", WINDOW).distinct().groupBy(WINDOW).count().filter(F.col("count") == len(caches)).agg(F.count("*").alias("common_windows"))
    own = tagged.groupBy("cache").agg(
        F.count("*").alias("rows"),
        F.count_distinct(WINDOW, "expert_id").alias("keys"),
        F.count_distinct(WINDOW).alias("windows"),
        F.array_join(F.sort_array(F.collect_set("expert_id")), ",").alias("experts"),
    )
    return own.crossJoin(every)


def prediction_scale(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """Distribution of predictions, targets and absolute errors over all steps of each expert, of finite values."""
    both = predicted.join(targets.select(WINDOW, "target"), WINDOW)
    steps = both.select("expert_id", F.explode(F.arrays_zip("yhat", "target")).alias("s")).select("expert_id", "s.yhat", "s.target")
    kinds = [("prediction", F.col("yhat")), ("target", F.col("target")), ("abs_error", F.abs(F.col("yhat") - F.col("target")))]
    v = steps.select("expert_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("x")) for k, x in kinds])).alias("v")).select("expert_id", "v.kind", "v.x")
    ok = F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    keys, shares = ["expert_id", "kind"], {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    s = v.groupBy(*keys).agg(F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"), (F.count(ok) / F.count("*")).alias("finite_rate"))
    q = quantiles(v.withColumn("x", ok), "x", shares, keys)
    return s.join(q, keys, "left").select(*keys, "min", "max", "mean", "std", *shares, "finite_rate")
