"""Panels, splits, registries, experts and summaries against values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import codebook, experts, oracle, panel, proxy, quality, registry, sampling


@pytest.fixture(scope="module")
def toy(spark):
    """Two items of 20 and 12 rows, half an hour apart; 15 and 10 of them lie before the cut-off."""
    cut = dt.datetime(2024, 3, 1)
    rows = [("min", item, cut + dt.timedelta(minutes=30 * (i - pre)), c, float(i * i), float(5 - i)) for item, c, n, pre in ((7, 8, 20, 15), (9, 26, 12, 10)) for i in range(n)]
    return spark.createDataFrame(rows, "subset string, item_id long, date_time timestamp, cluster int, ind_1 double, ind_2 double")


CONFIG = registry.RegistryConfig(history_len=4, pred_len=2, sample_stride=2, channels=("ind_1",), subsets=("min",), cutoff="2024-03-01 00:00:00")


def test_split_bounds(toy):
    rows = panel.split_bounds(toy, CONFIG.cutoff).filter("item_id = 7").collect()
    assert sorted((r.split, r.split_start_idx, r.split_end_idx) for r in rows) == [("test", 15, 20), ("train", 0, 12), ("valid", 12, 15)]


def test_registry_counts_and_ids(spark, toy):
    r = registry.build_registry(toy, codebook.official_codebook(spark), CONFIG)
    rows = r.collect()
    # item 7: train from 4 to 10, valid at 12, test at 15 and 17; item 9: train (0 to 8) at 4 and 6, valid (8 to 10) at 8, test (10 to 12) at 10
    assert sorted((x.item_id, x.split, x.target_start_idx) for x in rows) == [
        (7, "test", 15), (7, "test", 17), (7, "train", 4), (7, "train", 6), (7, "train", 8), (7, "train", 10), (7, "valid", 12),
        (9, "test", 10), (9, "train", 4), (9, "train", 6), (9, "valid", 8),
    ]
    first = next(x for x in rows if (x.item_id, x.target_start_idx) == (7, 15))
    assert (first.history_start_idx, first.target_end_idx, first.history_start_time, first.target_end_time) == (11, 17, "2024-02-29T22:00:00", "2024-03-01T00:30:00")
    assert first.official_tsf_cell == "highT_lowS_lowF" and first.period == 144
    assert len({x.physical_window_id for x in rows}) == len(rows) and len(r.columns) == 35 - 3
    other = registry.RegistryConfig(**{**CONFIG.__dict__, "sample_stride": 1})
    assert registry.base_registry_id(other) == registry.base_registry_id(CONFIG) and registry.sample_set_id(other) != registry.sample_set_id(CONFIG)
    one = rows[0]
    want = registry.digest({"channel": one.channel, "data_version": "1", "dataset": "panel", "history_len": 4, "item_id": one.item_id, "pred_len": 2, "revision": "1", "split": one.split, "subset": "min", "target_start_idx": one.target_start_idx}, 16)
    assert one.physical_window_id == want


def test_values_beside_windows_are_those_of_the_join(spark, toy):
    book = codebook.official_codebook(spark)
    two = registry.RegistryConfig(**{**CONFIG.__dict__, "channels": ("ind_1", "ind_2")})
    cut = registry.build_registry(toy, book, two, values=("history", "target"))
    joined = registry.with_values(registry.build_registry(toy, book, two), panel.series(toy, two.channels))
    cols = ["physical_window_id", "history", "target"]
    got = sorted(tuple(r) for r in cut.select(cols).collect())
    assert got == sorted(tuple(r) for r in joined.select(cols).collect()) and len(got) == 22
    assert [49.0, 64.0] in [r[2] for r in got] or [64.0, 81.0] in [r[2] for r in got]


def test_wrong_panels_raise(spark, toy):
    book = codebook.official_codebook(spark)
    for bad, why in ((toy.withColumn("cluster", F.lit(1)), "without cell"), (toy.withColumn("cluster", F.when(F.col("ind_1") < 9, 8).otherwise(26)), "several clusters")):
        with pytest.raises(Exception, match=why):
            registry.build_registry(bad, book, CONFIG).collect()
    long = registry.RegistryConfig(**{**CONFIG.__dict__, "history_len": 9})
    with pytest.raises(Exception, match="before the first row"):  # valid of item 9 starts at 8
        registry.build_registry(toy, book, long).collect()
    with pytest.raises(ValueError):
        registry.build_registry(toy.drop("ind_1"), book, CONFIG)


def test_strict_policy(spark, toy):
    c = registry.RegistryConfig(**{**CONFIG.__dict__, "split_context_policy": "strict_within_split", "sample_stride": 2, "channels": ("ind_1", "ind_2")})
    rows = registry.build_registry(toy, codebook.official_codebook(spark), c).filter("split = 'train'").collect()
    assert {(r.item_id, r.channel, r.target_start_idx) for r in rows} == {(i, c, t) for i, last in ((7, 10), (9, 6)) for c in ("ind_1", "ind_2") for t in range(4, last + 1, 2)}
    valid = registry.build_registry(toy, codebook.official_codebook(spark), c).filter("split = 'valid'")
    assert valid.count() == 0  # three rows hold no history of four and target of two
    with pytest.raises(ValueError):
        registry.offsets(F.lit("train"), F.lit(0), F.lit(9), 3, 2, 0, "overlap")


def window(spark, history, target, period=4):
    kinds = "physical_window_id string, split string, subset string, official_tsf_cell string, period int, pred_len int, history array<double>, target array<double>"
    return spark.createDataFrame([("w", "test", "hour", "c", period, len(target), history, target)], kinds)


def test_experts(spark):
    w = window(spark, [5.0, 1.0, 9.0, 5.0, 2.0, 8.0], [5.0, 2.0, 8.0], 3)
    got = {r.expert_id: r.yhat for r in experts.predictions(w).collect()}
    assert got["last_value"] == [8.0] * 3 and got["seasonal_naive"] == [5.0, 2.0, 8.0] and got["recent_mean"] == [5.0] * 3
    # mean 5, slope (-2.5 * 5 - 1.5 - 4.5 + 2.5 + 3 + 20) / 17.5 = 0.4, from the middle at 2.5
    assert got["linear_trend"] == pytest.approx([6.4, 6.8, 7.2])
    errors = {r.expert_id: r for r in experts.error_table(w).collect()}
    assert errors["seasonal_naive"].mse == 0 and errors["seasonal_naive"].is_oracle_top1 and errors["last_value"].mse == 15 and errors["recent_mean"].mse == 6
    assert sorted(r.rank_in_window for r in errors.values()) == [1, 2, 3, 4] and errors["last_value"].rank_in_window == 4
    assert sum(r.soft_oracle_weight for r in errors.values()) == pytest.approx(1)
    beside = experts.scored(w).first()
    assert beside.u.mse == pytest.approx(((6.1 - 5) ** 2 + (5.45 - 2) ** 2 + (7.05 - 8) ** 2) / 3) and len(beside.e) == 4
    short = {r.expert_id: r.yhat for r in experts.predictions(window(spark, [1.0, 2.0], [0.0] * 5, 7)).collect()}
    assert short["seasonal_naive"] == [1.0, 2.0, 1.0, 2.0, 1.0]


ERRORS = [
    ("w1", "train", "hour", "x", "naive", 2.0, 1.0), ("w1", "train", "hour", "x", "line", 5.0, 2.0), ("w1", "train", "hour", "x", "tree", 0.5, 0.5),
    ("w2", "valid", "min", "y", "naive", 3.0, 1.5), ("w2", "valid", "min", "y", "line", 1.0, 0.8), ("w2", "valid", "min", "y", "tree", 8.0, 2.5),
    ("w3", "valid", "min", "y", "naive", 70.0, 7.0),
]


def test_oracle_and_ensemble(spark):
    e = spark.createDataFrame(ERRORS, "physical_window_id string, split string, subset string, official_tsf_cell string, expert_id string, mse double, mae double")
    names = ["naive", "line", "tree"]
    s = oracle.oracle_summary(oracle.common_windows(e, names)).first()
    assert (s.windows, s.best_fixed_expert, s.best_fixed_mse, s.oracle_mse, s.oracle_gap, s.uniform_proxy_mse) == (2, "naive", 2.5, 0.75, 1.75, 3.25)
    y = [("w1", "a", [0.0, 3.0]), ("w1", "b", [2.0, 3.0]), ("w2", "a", [4.0, 0.0]), ("w2", "b", [0.0, 0.0])]
    p = spark.createDataFrame(y, "physical_window_id string, expert_id string, yhat array<double>")
    t = spark.createDataFrame([("w1", [2.0, 2.0]), ("w2", [1.0, 0.0])], "physical_window_id string, target array<double>")
    u = {r.physical_window_id: (r.uniform_mse, r.uniform_mae) for r in oracle.uniform_ensemble(p, t).collect()}
    assert u == {"w1": (1.0, 1.0), "w2": (0.5, 0.5)}
    kinds = {(r.group_kind, r.group_value) for r in oracle.oracle_audit(e).collect()}
    assert ("overall", "all") in kinds and ("split", "valid") in kinds and ("official_tsf_cell", "y") in kinds
    assert oracle.oracle_summary(e.limit(0)).first().windows == 0
    with pytest.raises(Exception, match="caches repeats the key"):
        oracle.union_caches([e, e]).collect()


def test_proxy(spark):
    f = proxy.proxy_table(window(spark, [6.0, 2.0, 7.0, 5.0], [9.0], 24)).first()
    assert (f["mean"], f["last_value"], f["max"], f["missing_ratio"], f["amplitude"], f["acf_period"]) == (5, 5, 7, 0, 5, 0) and f["slope"] == pytest.approx(0.2)
    g = proxy.proxy_table(window(spark, [4.0, float("nan"), 2.0, 6.0, 8.0], [9.0], 2)).first()
    assert g["missing_ratio"] == pytest.approx(0.2) and g["mean"] == 5 and math.isfinite(g["spectral_entropy"])


def test_cells_and_codebook(spark):
    q = spark.createDataFrame([("min", 5, 0.41, 0.39, 0.9), ("min", 6, 0.4, 0.4, 0.4), ("min", 8, float("nan"), 0.7, 0.1)], "subset string, item_id long, trend_strength double, seasonality_strength double, forecastability double")
    assert [r.tsf_cell for r in quality.threshold_cells(q).orderBy("item_id").collect()] == ["highT_lowS_highF", "lowT_lowS_lowF", "lowT_highS_lowF"]
    book = {r.official_cluster_code: r.official_tsf_cell for r in codebook.official_codebook(spark).collect()}
    assert book[0] == "highT_highS_highF" and book[26] == "lowT_lowS_lowF" and book[24] == "lowT_lowS_highF"
    n = codebook.agreement_count(F.lit("highT_lowS_highF"), F.lit("highT_highS_highF"))
    assert spark.range(1).select(n.alias("n")).first().n == 2


def test_samplers(spark):
    rows = [(f"w{i:02d}", "abcd"[i % 4]) for i in range(12)]
    df = spark.createDataFrame(rows, "physical_window_id string, g string")
    for f in (sampling.proportional, sampling.round_robin, sampling.equal_quota_fill):
        got = f(df, ["g"], 8, 7).collect()
        assert len(got) == 8 and {g: sum(r.g == g for r in got) for g in "abcd"} == dict.fromkeys("abcd", 2)
        assert sorted(got) == sorted(f(df, ["g"], 8, 7).collect())
    assert sampling.capped(df, ["g"], 2, 7).count() == 8
    with pytest.raises(ValueError):
        sampling.proportional(df, ["g"], 13, 7)


def test_resume_ignores_null_keys(spark):
    tasks = spark.createDataFrame([("hour", 1), ("hour", 2), ("min", 1)], "subset string, item_id long")
    done = spark.createDataFrame([("hour", 1), ("min", 1), (None, 2)], "subset string, item_id long")
    assert [tuple(r) for r in sampling.resume(tasks, done, ["subset", "item_id"]).collect()] == [("hour", 2)]


def test_representative(spark):
    start = dt.datetime(2023, 5, 5)
    rows = [("min", 4, start + dt.timedelta(days=i), a, b) for i, (a, b) in enumerate([(1.0, 6.0), (3.0, 0.0), (8.0, 3.0)])]
    df = spark.createDataFrame(rows, "subset string, item_id long, date_time timestamp, ind_1 double, ind_2 double")
    got = [r.value for r in panel.representative(df, ["ind_1", "ind_2"]).orderBy("date_time").collect()]
    # (x - 4) / sqrt(26 / 3) and (x - 3) / sqrt(6), averaged
    assert got == pytest.approx([0.102848, -0.782214, 0.679366], abs=1e-6)
