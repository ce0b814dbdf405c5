"""Statistical experts, prediction and error tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.arrays import absolute_error, filled, let, mean, slope, squared_error, tail
from strandline.operators.checks import ensure_unique_key, expert_ids

WINDOW = "physical_window_id"


def _steps(pred: Column) -> Column:
    return F.sequence(F.lit(0), pred - 1)


def last_value(history: Column, period: Column, pred: Column) -> Column:
    return F.array_repeat(F.element_at(history, -1), pred)


def seasonal_naive(history: Column, period: Column, pred: Column) -> Column:
    """The last period repeated; a shorter history is repeated whole, no period means the last value."""
    base = tail(history, F.greatest(F.least(period, F.size(history)), F.lit(1)))
    return let(base, lambda b: F.transform(_steps(pred), lambda i: F.get(b, F.pmod(i, F.size(b)).cast("int"))))


def recent_mean(history: Column, period: Column, pred: Column) -> Column:
    width = F.greatest(F.ceil(F.size(history) * 0.25).cast("int"), F.lit(1))
    return F.array_repeat(mean(tail(history, width)), pred)


def linear_trend(history: Column, period: Column, pred: Column) -> Column:
    n = F.size(history)
    line = F.struct(mean(history).alias("mean"), slope(history).alias("slope"))
    return let(line, lambda m: F.transform(_steps(pred), lambda i: m["mean"] + m["slope"] * (n + i - (n - 1) / 2.0)))


#: Experts as functions of (history, period, pred_len).
EXPERTS: dict[str, Callable[[Column, Column, Column], Column]] = {f.__name__: f for f in (last_value, seasonal_naive, recent_mean, linear_trend)}


def _made(names: Sequence[str], known: dict, p: Column):
    """history -> the array of the experts' structs (expert_id, expert_order, yhat)."""
    return lambda h: F.array(*[F.struct(F.lit(n).alias("expert_id"), F.lit(k).alias("expert_order"), known[n](h, p, F.col("pred_len")).alias("yhat")) for k, n in enumerate(names)])


def predictions(windows: DataFrame, experts: Sequence[str] = tuple(EXPERTS), period: int = 0, registered: dict | None = None) -> DataFrame:
    """One row for each window and expert with its array ``yhat``. period 0 means each window's own."""
    known = EXPERTS | (registered or {})
    made = _made(expert_ids(experts, known), known, F.lit(period) if period else F.col("period"))
    keep = [c for c in windows.columns if c not in ("history", "target")]
    return windows.select(*keep, F.explode(let(filled(F.col("history")), made)).alias("e")).select(*keep, "e.*")


def scored(windows: DataFrame, experts: Sequence[str] = tuple(EXPERTS), period: int = 0, registered: dict | None = None) -> DataFrame:
    """One row for each window with ``e``, its experts' (expert_id, expert_order, mse, mae), and ``u``, the (mse, mae) of the mean of
    their predictions. Nothing is shuffled: predictions meet the target and each other beside their window."""
    known = EXPERTS | (registered or {})
    names = expert_ids(experts, known)
    made = _made(names, known, F.lit(period) if period else F.col("period"))
    keep = [c for c in windows.columns if c not in ("history", "target")]

    def errors_of(p: Column) -> Column:
        y = F.col("target")
        e = F.transform(p, lambda v: F.struct(v["expert_id"].alias("expert_id"), v["expert_order"].alias("expert_order"), squared_error(y, v["yhat"]).alias("mse"), absolute_error(y, v["yhat"]).alias("mae")))
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, z: x + z), [F.get(p, F.lit(k))["yhat"] for k in range(len(names))])
        u = let(F.transform(total, lambda x: x / len(names)), lambda m: F.struct(squared_error(y, m).alias("mse"), absolute_error(y, m).alias("mae")))
        return F.struct(e.alias("e"), u.alias("u"))

    return windows.select(*keep, let(let(filled(F.col("history")), made), errors_of).alias("__s")).select(*keep, "__s.*")


def training_rows(windows: DataFrame) -> DataFrame:
    """The windows, all of which must be of the train split: another one raises."""
    bad = F.raise_error(F.concat(F.lit("training saw a window of split "), F.coalesce("split", F.lit("null")), F.lit(": "), F.col(WINDOW))).cast("boolean")
    return windows.filter(F.when(F.col("split").eqNullSafe("train"), True).otherwise(bad))


def model_inputs(windows: DataFrame, scalers: DataFrame | None = None, keys: Sequence[str] = ("subset", "item_id", "channel")) -> DataFrame:
    """Histories and targets as a model takes them, in single precision, beside ``raw_target`` for final errors: scaled by the scalers
    of ``train_scalers`` if given, else as they are. A window without a scaler raises."""
    raw = windows.withColumn("raw_target", F.col("target"))
    if scalers is None:
        return raw.withColumns({c: F.transform(c, lambda x: x.cast("float").cast("double")) for c in ("history", "target")})
    j = raw.join(scalers, list(keys), "left")
    std = F.when(F.col("scaler_std").isNull(), F.raise_error(F.concat(F.lit("no scaler for "), F.col(WINDOW))).cast("double")).otherwise(F.col("scaler_std"))
    return j.withColumns({c: scale(F.col(c), F.col("scaler_mean"), std) for c in ("history", "target")})


def ingest_predictions(registry: DataFrame, external: DataFrame, expert: str) -> DataFrame:
    """Predictions (physical_window_id, yhat) of an outside model as an expert; a missing window or a wrong length raises."""
    joined = registry.join(ensure_unique_key(external.select(WINDOW, "yhat"), [WINDOW], "predictions"), WINDOW, "left")
    bad = F.col("yhat").isNull() | (F.size("yhat") != F.col("pred_len"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no prediction of the right length for "), F.col(WINDOW))).cast("array<double>")).otherwise(F.col("yhat"))
    return joined.withColumn("yhat", checked).withColumn("expert_id", F.lit(expert)).withColumn("expert_order", F.lit(0))


def errors(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """predicted with mse and mae against (physical_window_id, target)."""
    joined = predicted.join(targets.select(WINDOW, "target"), WINDOW)
    return joined.withColumn("mse", squared_error(F.col("target"), F.col("yhat"))).withColumn("mae", absolute_error(F.col("target"), F.col("yhat"))).drop("target", "yhat")


def ranked(errors: DataFrame, temperature: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Rank of each expert in its window by mse, the best of them, and soft-oracle weights. Ties go by expert order."""
    w = Window.partitionBy(WINDOW)
    order = "expert_order" if "expert_order" in errors.columns else "expert_id"
    z = -F.col("mse") / max(temperature, eps)
    out = errors.withColumn("rank_in_window", F.row_number().over(w.orderBy("mse", order))).withColumn("is_oracle_top1", F.col("rank_in_window") == 1)
    out = out.withColumn("__e", F.exp(z - F.max(z).over(w)))
    return out.withColumn("soft_oracle_weight", F.col("__e") / F.greatest(F.sum("__e").over(w), F.lit(eps))).drop("__e")


def error_table(windows: DataFrame, experts: Sequence[str] = tuple(EXPERTS), temperature: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """Windows with history and target to ranked errors. Targets are only read to score.

    Experts are scored and ranked beside their windows: no shuffle.
    """
    rows = scored(windows, experts)
    keep = [c for c in rows.columns if c not in ("e", "u")]

    def of(e: Column) -> Column:
        z = F.transform(e, lambda x: -x["mse"] / max(temperature, eps))
        w = let(z, lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))
        order = F.array_sort(F.transform(e, lambda x: F.struct(x["mse"].alias("mse"), x["expert_order"].alias("expert_order"))))
        both = F.struct(w.alias("w"), order.alias("order"))
        return let(
            both,
            lambda b: F.transform(
                e,
                lambda x: F.struct(
                    x["expert_id"].alias("expert_id"),
                    x["expert_order"].alias("expert_order"),
                    x["mse"].alias("mse"),
                    x["mae"].alias("mae"),
                    F.array_position(F.transform(b["order"], lambda o: o["expert_order"]), x["expert_order"]).cast("int").alias("rank_in_window"),
                    (F.get(b["w"], x["expert_order"]) / F.greatest(F.aggregate(b["w"], F.lit(0.0), lambda s, v: s + v), F.lit(eps))).alias("soft_oracle_weight"),
                ),
            ),
        )

    out = rows.select(*keep, F.explode(let(F.col("e"), of)).alias("x")).select(*keep, "x.*")
    return out.withColumn("is_oracle_top1", F.col("rank_in_window") == 1)


def _moments(a: Column) -> Column:
    """struct(n, m, v): size, mean and population variance of an array without nulls."""
    return let(a, lambda x: let(mean(x), lambda m: F.struct(F.size(x).alias("n"), m.alias("m"), (F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(x)).alias("v"))))


def _scaler(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and deviation of all values of each group from the moments ``__m`` of arrays: numbers, not values, are shuffled."""
    n, m, v = (F.col(f"__m.{k}") for k in "nmv")
    sums = rows.filter(n > 0).groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * m).alias("s"), F.sum(n * v).alias("within"), F.sum(n * m * m).alias("q"))
    centre = F.col("s") / F.col("n")
    return sums.select(*by, centre.alias("scaler_mean"), (F.sqrt(F.greatest((F.col("within") + F.col("q") - F.col("s") * centre) / F.col("n"), F.lit(0.0))) + 1e-8).alias("scaler_std"))


def train_scalers(series: DataFrame, train_lengths: DataFrame, by: Sequence[str] = ("subset", "item_id", "channel")) -> DataFrame:
    """Mean and population deviation plus 1e-8 of the train segments; other ``by`` columns give scalers of cells."""
    cut = series.join(train_lengths, ["subset", "item_id"])
    return _scaler(cut.select(*by, _moments(F.slice("values", F.lit(1), F.col("train_length"))).alias("__m")), by)


def global_scaler(windows: DataFrame) -> DataFrame:
    """One row: mean and deviation of all history and target values of train windows, overlaps counted again."""
    x = windows.filter("split = 'train'").select(_moments(F.concat("history", "target")).alias("__m"))
    return _scaler(x, [])


def scale(a: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std in single precision. Spark divides floats as doubles, so the quotient is rounded once more."""
    return F.transform(a, lambda x: ((x.cast("float") - mean.cast("float")) / std.cast("float")).cast("float").cast("double"))


def unscale(a: Column, mean: Column, std: Column) -> Column:
    return F.transform(a, lambda x: (x.cast("float") * std.cast("float") + mean.cast("float")).cast("double"))


def normalized_errors(predicted: DataFrame, targets: DataFrame, scalers: DataFrame, keys: Sequence[str] = ("subset", "item_id", "channel")) -> DataFrame:
    """Ranked errors of predictions scaled by their series' scaler against scaled targets."""
    p = predicted.join(scalers, list(keys)).withColumn("yhat", scale(F.col("yhat"), F.col("scaler_mean"), F.col("scaler_std")))
    both = p.join(targets.select(WINDOW, "target"), WINDOW).withColumn("target", scale(F.col("target"), F.col("scaler_mean"), F.col("scaler_std")))
    out = both.withColumn("mse", squared_error(F.col("target"), F.col("yhat"))).withColumn("mae", absolute_error(F.col("target"), F.col("yhat")))
    return ranked(out.drop("target", "yhat", "scaler_mean", "scaler_std"))


def train_cap(registry: DataFrame, most: int, order: Sequence[str]) -> DataFrame:
    """The first train rows in the order given, and all rows of other splits."""
    first = registry.filter("split = 'train'").orderBy(*order).limit(most)
    return first.unionByName(registry.filter("split != 'train' OR split IS NULL"))
