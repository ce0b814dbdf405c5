"""Ranks and quantiles against NumPy, strided rows against plain lists."""

import numpy as np
from pyspark.sql import functions as F

from strandline.functions.ranks import bucket, quantiles, value_ranks
from strandline.operators import oracle, panel, sampling


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = {"a": np.round(rng.normal(0, 50, 400), 1), "b": np.full(30, 7.0), None: np.exp(rng.normal(0, 30, 99))}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    qs = {"low": 0.0, "q": 0.37, "half": 0.5, "top": 1.0}
    got = {r["g"]: r for r in quantiles(df, "x", qs, ["g"]).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        for name, q in qs.items():
            assert np.isclose(got[g][name], np.quantile(xs, q), rtol=1e-12)
    ranks = value_ranks(df.filter("g = 'a'"), "x").collect()
    for r in ranks:
        assert (r["n"], r["before"], r["total"]) == ((values["a"] == r["x"]).sum(), (values["a"] < r["x"]).sum(), 400)


def test_quantiles_without_rows(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert quantiles(df, "x", {"h": 0.5}, ["g"]).count() == 0


def test_bucket_never_falls(spark):
    xs = sorted([-1e300, -5.0, -1e-9, -0.0, 0.0, 1e-12, 3.0, 3.0000000001, 1e200, float("inf"), float("-inf")])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(bucket(F.col("x"))).collect()]
    assert got == sorted(got)


def test_strided_without_bound(spark):
    rows = [(g, t) for g in ("b", "a", None) for t in range(10)]
    df = spark.createDataFrame(rows, "g string, t int").repartition(4)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(map(tuple, panel.strided(df, ["g", "t"], 4).collect()), key=str) == sorted(want[::4], key=str)
    assert sorted(map(tuple, panel.strided(df, ["g", "t"], 4, 3).collect()), key=str) == sorted(want[::4][:3], key=str)


def test_worst_and_robust_with_ties(spark):
    rows = [("e", f"w{i}", float(x), float(x)) for i, x in enumerate([9, 9, 1, 2, 3])] + [("f", "w0", 4.0, 4.0)]
    df = spark.createDataFrame(rows, "expert_id string, physical_window_id string, mse double, mae double")
    got = {r["expert_id"]: r["drop_top_mse"] for r in oracle.robust_metrics(df).collect()}
    assert got == {"e": 15 / 4, "f": None}
    worst = oracle.worst_windows(df, 2).filter("expert_id = 'e'").orderBy("worst_rank").collect()
    assert [(r["physical_window_id"], r["share"]) for r in worst] == [("w0", 9 / 24), ("w1", 9 / 24)]


def test_samples_of_more_rows_than_there_are(spark):
    df = spark.createDataFrame([(str(i), i % 3) for i in range(9)], "physical_window_id string, g int")
    assert sampling.equal_quota_fill(df, ["g"], 20, 7).count() == 9
    assert sampling.round_robin(df, ["g"], 20, 7).count() == 9
    assert sampling.equal_quota_fill(df, ["g"], 8, 7).count() == 8
