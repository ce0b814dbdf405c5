"""Audits, gates, guards and batched kernels on small tables worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import spectra
from strandline.operators import audit, checks, codebook, experts, images, latency, proxy, quality


def errors(spark):
    rows = [("w1", "a", 1.0, 1.0, 0.8), ("w1", "b", 4.0, 2.0, 0.2), ("w2", "a", 9.0, 3.0, 0.0), ("w2", "b", 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "physical_window_id string, expert_id string, mse double, mae double, soft_oracle_weight double")


def test_gates(spark):
    e = errors(spark)
    got = {r.gate: r for r in audit.gate_report(e, audit.baseline_gates(e)).collect()}
    # b is best on average (2.5 against 5), the oracle has 1
    assert (got["fixed_best"].mean_mse, got["uniform"].mean_mse, got["uniform"].oracle_mse, got["uniform"].best_fixed_mse) == (2.5, 3.75, 1.0, 2.5)
    assert got["fixed_best"].gap_reduction == 0 and got["uniform"].gap_reduction == pytest.approx(-1.25 / 1.5)
    kl = (0.8 * math.log(0.8 / 0.5) + 0.2 * math.log(0.2 / 0.5) + math.log(2)) / 2
    assert got["uniform"].kl == pytest.approx(kl, abs=1e-6) and got["uniform"].gate_entropy == pytest.approx(math.log(2), abs=1e-6)


def test_cache_audit_and_checks(spark):
    p = spark.createDataFrame([("w1", "a", [1.0, 2.0]), ("w1", "a", [1.0, 2.0]), ("w2", "b", [1.0, 2.0, 3.0])], "physical_window_id string, expert_id string, yhat array<double>")
    r = audit.cache_audit(p, errors(spark), 2).first()
    assert (r.prediction_rows, r.error_rows, r.unique_prediction_key, r.unique_error_key) == (3, 4, False, True)
    assert (r.prediction_windows, r.error_windows, r.window_overlap, r.experts, r.horizon, r.horizon_matches_manifest) == (2, 2, 2, "a,b", None, False)
    none = audit.cache_audit(p.limit(0), errors(spark).limit(0)).first()
    assert (none.prediction_rows, none.unique_prediction_key, none.prediction_windows) == (0, True, 0)
    t = spark.createDataFrame([("w1", [1.0, 2.0]), ("w2", [1.0, 2.0])], "physical_window_id string, target array<double>")
    with pytest.raises(Exception, match="another length"):
        audit.checked_predictions(p, t).collect()
    with pytest.raises(Exception, match="no target"):
        audit.checked_predictions(p.filter("physical_window_id = 'w1'"), t.filter("physical_window_id = 'w2'")).collect()
    cover = audit.proxy_coverage(t, t.limit(1).union(t.limit(1))).first()
    assert (cover.windows, cover.proxy_rows, cover.joined, cover.missing) == (2, 2, 1, 1)


def test_pathology(spark):
    e = errors(spark).withColumn("scaler_std", F.when(F.col("physical_window_id") == "w1", 0.5).otherwise(250.0))
    bins = {(r.expert_id, r.std_bin): (r.windows, r.mean_mse, r.mse_share) for r in audit.by_std_bin(e).collect()}
    assert bins[("a", -1)] == (1, 1.0, 0.1) and bins[("a", 2)] == (1, 9.0, 0.9) and bins[("b", 2)] == (1, 1.0, 0.2)
    top = {(r.expert_id, r.top): r.mse_share for r in audit.outlier_contribution(errors(spark), (1, 2)).collect()}
    assert top == {("a", 1): 0.9, ("a", 2): 1.0, ("b", 1): 0.8, ("b", 2): 1.0}
    assert audit.by_std_bin(e.withColumn("scaler_std", F.lit(0.0))).first().std_bin is None


def test_item_split_keeps_items_apart(spark):
    df = spark.range(4000).selectExpr("'hour' as subset", "id % 1000 as item_id")
    got = audit.item_split(df, {"train": 0.6, "test": 0.4}, 1)
    assert got.groupBy("item_id").agg(F.count_distinct("item_split").alias("n")).filter("n > 1").count() == 0
    assert abs(got.filter("item_split = 'train'").count() / 4000 - 0.6) < 0.06


def window(spark, split="train", history=(1.0, 2.0, 4.0)):
    kinds = "physical_window_id string, subset string, item_id long, channel string, split string, period int, history_len int, pred_len int, history array<double>, target array<double>"
    return spark.createDataFrame([("w", "hour", 1, "ind_1", split, 2, len(history), 2, list(history), [8.0, 0.1])], kinds)


def test_guards_and_inputs(spark):
    assert experts.training_rows(window(spark)).count() == 1
    for split in ("valid", None):
        with pytest.raises(Exception, match="training saw"):
            experts.training_rows(window(spark, split)).collect()
    assert checks.one_length(window(spark)).count() == 1
    with pytest.raises(Exception, match="several lengths"):
        checks.one_length(window(spark).union(window(spark, history=(1.0, 2.0)))).collect()
    raw = experts.model_inputs(window(spark)).first()
    assert raw.target == [8.0, float(np.float32(0.1))] and raw.raw_target == [8.0, 0.1]
    scalers = spark.createDataFrame([("hour", 1, "ind_1", 2.0, 4.0)], "subset string, item_id long, channel string, scaler_mean double, scaler_std double")
    assert experts.model_inputs(window(spark), scalers).first().history == [-0.25, 0.0, 0.5]
    with pytest.raises(Exception, match="no scaler"):
        experts.model_inputs(window(spark), scalers.limit(0)).collect()


def test_short_series_and_spectra(spark):
    rows = [(i, v) for i, v in enumerate([[1.0], [1.0, 2.0], [1.0, 2.0, 5.0], [1.0, float("nan"), 5.0], [None, None], [], [3.0] * 9])]
    df = spark.createDataFrame(rows, "k int, values array<double>")
    got = {r.k: r for r in quality.quality(df, F.lit(4)).collect()}
    assert all(r.forecastability == 1.0 for r in got.values()) and got[3].missing_ratio == pytest.approx(1 / 3) and got[5].missing_ratio == 1.0
    x = np.random.default_rng(0).standard_normal((3, 31))
    c = x - x.mean(1, keepdims=True)
    direct = np.array([[abs(sum(v * np.exp(-2j * np.pi * k * i / 31) for i, v in enumerate(r))) ** 2 for k in range(1, 16)] for r in c])
    assert spectra.power(x) == pytest.approx(direct)


def test_batched_features_are_those_of_the_jvm(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(60):
        h = rnd.standard_normal(rnd.choice([1, 2, 3, 8, 24])).round(3).tolist()
        h = [float("nan") if rnd.random() < 0.1 else float("inf") if rnd.random() < 0.05 else v for v in h] if i % 3 else h
        rows.append((f"w{i}", int(rnd.choice([0, 1, 2, 5])), h))
    rows.append(("none", 2, [float("nan")] * 5))
    w = spark.createDataFrame(rows, "physical_window_id string, period int, history array<double>")
    a, b = ({r.physical_window_id: r for r in f(w).collect()} for f in (proxy.proxy_table, proxy.proxy_batches))
    for k in a:
        for f in proxy.FEATURES:
            assert b[k][f] == pytest.approx(a[k][f], abs=1e-9), (k, f, rows)


def test_views_pixel_by_pixel():
    z = np.random.default_rng(2).standard_normal((2, 10)) * 2
    lines = images.line_view(z)
    fold, pad, cycles = images.fold_view(z, 4)
    assert (pad, cycles) == (2, 3)
    for b in range(2):
        for c in (0, 17, 100, 191):
            at = c * 9 / 191
            k = int(at)
            y = z[b, k] * (1 - at + k) + z[b, min(k + 1, 9)] * (at - k)
            y = min(max((y + 5) / 10, 0), 1)
            assert [max(0, 1 - abs(r - y * 63)) for r in range(64)] == pytest.approx(lines[b, :, c].tolist(), abs=1e-9)
        cells = [[min(max(((z[b, 4 * r + c] if 4 * r + c < 10 else 0) + 5) / 10, 0), 1) for c in range(4)] for r in range(3)]
        for r, c in ((0, 0), (20, 60), (33, 100), (63, 191)):
            i, j = (min(max((v + 0.5) * n / m - 0.5, 0), n - 1) for v, n, m in ((r, 3, 64), (c, 4, 192)))
            p, q = int(i), int(j)
            s, t = min(p + 1, 2), min(q + 1, 3)
            want = (cells[p][q] * (1 - j + q) + cells[p][t] * (j - q)) * (1 - i + p) + (cells[s][q] * (1 - j + q) + cells[s][t] * (j - q)) * (i - p)
            assert fold[b, r, c] == pytest.approx(want)
    flat = images.power_view(np.full((1, 8), 3.0))
    assert flat.max() == 0


def test_encoder_place_by_place():
    rnd = np.random.default_rng(3)
    v = rnd.random((2, 3, 6, 8)).astype(np.float32)
    weights = images.encoder_weights(5, seed=4)

    def conv(x, w, b):  # channels x height x width
        c, h, n = x.shape
        out = np.zeros((w.shape[1], (h + 1) // 2, (n + 1) // 2))
        for i in range(out.shape[1]):
            for j in range(out.shape[2]):
                for y in range(3):
                    for k in range(3):
                        r, s = 2 * i + y - 1, 2 * j + k - 1
                        if 0 <= r < h and 0 <= s < n:
                            out[:, i, j] += x[:, r, s] @ w[(3 * y + k) * c : (3 * y + k + 1) * c]
        return out + b[:, None, None]

    gelu = np.vectorize(lambda x: x * 0.5 * (1 + math.erf(x / math.sqrt(2))))
    for row, got in zip(v, images.encode(v, weights), strict=True):
        x = row.astype(float)
        for w, b in weights[:-1]:
            x = gelu(conv(x, w, b))
        assert got == pytest.approx(x.mean((1, 2)) @ weights[-1][0] + weights[-1][1], abs=1e-5)
    assert (images.encoder_weights(5, seed=4)[0][0] == weights[0][0]).all()


def test_alignment_and_latency(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2)], "physical_window_id string, view int")
    i = spark.createDataFrame([("b", "y"), ("a", "x")], "physical_window_id string, note string")
    assert sorted(tuple(r) for r in images.aligned(v, i).collect()) == [("a", 1, "x"), ("b", 2, "y")]
    for left, right, why in ((v.limit(1), i, "no view"), (v, i.limit(1), "no index row"), (v.union(v), i, "repeats the key")):
        with pytest.raises(Exception, match=why):
            images.aligned(left, right).collect()
    rows = latency.sweep(spark, history=24, batches=(1, 4), repeat=1, components=("proxy", "views", "encoder")).collect()
    assert len(rows) == 6 and all(r.total_ms > 0 and r.ms_per_window == pytest.approx(r.total_ms / r.batch) for r in rows)
    with pytest.raises(ValueError):
        latency.sweep(spark, batches=(0,))


def test_semantics_and_moves(spark):
    items = spark.createDataFrame(
        [("hour", 1, 0, "highT_highS_highF", "highT_highS_highF", 0.5), ("min", 2, 0, "highT_highS_highF", "lowT_highS_highF", 0.7), ("min", 3, 0, "lowT_highS_highF", "lowT_highS_highF", float("nan"))],
        "subset string, item_id long, official_cluster_code int, stl_tsf_cell string, proxy_tsf_cell string, x double",
    )
    items = items.select("*", *[F.col("x").alias(f"{n}_{m}") for n in ("stl", "proxy") for m in quality.METRICS])
    r = codebook.semantics_with_quantiles(items).first()
    assert (r.hour_items, r.min_items, r.stl_trend_strength_p50, r.stl_trend_strength_max) == (1, 2, 0.6, 0.7)
    got = {x.item_id: (x.stl_proxy_agree, x.cluster_semantic_match) for x in codebook.item_semantics(items).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False)}
