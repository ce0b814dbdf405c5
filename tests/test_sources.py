"""Round trips of sources and sinks, and evaluation of arriving series that resumes."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.sources import tables as T
from strandline.streaming.resume import evaluate_arrivals, finished, results


def test_panel_and_codebook(spark, tmp_path):
    for s in ("hour", "min"):
        spark.createDataFrame([(i, float(i)) for i in (3, 1, 2)], "item_id long, ind_1 double").write.parquet(f"{tmp_path}/test_{s}-0.parquet")
    p = T.read_panel(spark, str(tmp_path), ["hour", "min"], items=2)
    assert sorted((r.subset, r.item_id) for r in p.collect()) == [("hour", 1), ("hour", 2), ("min", 1), ("min", 2)]
    (tmp_path / "book.csv").write_text("note,official_tsf_cell,official_cluster_code\nx,highT_highS_highF,0\n")
    assert [tuple(r) for r in T.read_codebook(spark, f"{tmp_path}/book.csv").collect()] == [(0, "highT_highS_highF")]
    (tmp_path / "bad.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        T.read_codebook(spark, f"{tmp_path}/bad.csv")


def test_registry(spark, tmp_path):
    rows = [(f"w{i}", "hour", i % 3, "train", i, "c") for i in range(9)]
    reg = spark.createDataFrame(rows, "physical_window_id string, subset string, item_id long, split string, target_start_idx int, channel string")
    path = T.write_registry(reg, f"{tmp_path}/reg", full=False)
    assert path.endswith("reg_partial")
    with pytest.raises(Exception):
        T.write_registry(reg, f"{tmp_path}/reg", full=False)
    head = T.read_registry(spark, path, head=2)
    assert [r.physical_window_id for r in head.collect()] == ["w0", "w3"]
    assert T.read_registry(spark, path, sample=lambda r: r.filter("item_id = 1")).count() == 3
    with pytest.raises(ValueError):
        T.read_registry(spark, path, head=2, sample=lambda r: r)


def test_caches_and_manifest(spark, tmp_path):
    for e in ("a", "b"):
        errors = spark.createDataFrame([("w0", e, 1.0), ("w1", e, 2.0)], "physical_window_id string, expert_id string, mse double")
        T.write_cache(f"{tmp_path}/{e}", errors.select("physical_window_id", "expert_id"), errors, errors.limit(1), {"note": "é"})
    assert T.read_manifest(spark, f"{tmp_path}/a/manifest.json") == {"experts": ["a"], "note": "é"}
    assert T.read_caches(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], experts=["b"]).count() == 2
    with pytest.raises(Exception):
        T.read_caches(spark, [f"{tmp_path}/a", f"{tmp_path}/a"]).collect()
    with pytest.raises(ValueError):
        T.write_cache(f"{tmp_path}/c", errors, errors, manifest={"experts": ["a"]})
    assert T.read_or_empty(spark, f"{tmp_path}/none", "x int").count() == 0
    assert T.latest(spark, f"{tmp_path}/none*") is None and T.latest(spark, f"{tmp_path}/a*").endswith("/a")


def test_batches_and_small_helpers(spark, tmp_path):
    path = f"{tmp_path}/batches"
    for seq, v in ((0, 1.0), (1, 2.0)):
        T.append_batch(spark.createDataFrame([("k", seq, v)], "key string, seq int, v double"), path, ["key", "seq", "v", "absent"], ["key"], "seq")
    assert spark.read.parquet(path).count() == 2
    w = T.wide(spark.createDataFrame([("k", [1.0, 2.0])], "key string, y array<double>"), "y", "y_", 3).first()
    assert (w["y_0"], w["y_1"], w["y_2"]) == (1.0, 2.0, None)
    assert T.yaml({"a": 1, "b": {"c": ["x"]}}) == 'a: 1\nb:\n  c:\n    - "x"'
    assert T.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert T.last_json_line('{"a": 1}\n{"b": 2}\nend') == {"b": 2}
    best = spark.createDataFrame([("t1", 2.0), ("t2", 1.0), ("t3", None)], "trial string, best_metric double")
    assert T.best_trial(best).first().trial == "t2"
    assert T.markdown(best.limit(1)).splitlines()[0] == "| trial | best_metric |"


def test_arrivals_resume(spark, tmp_path):
    kind, source, out, mark = "key string, x double", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        evaluate_arrivals(spark.readStream.schema(kind).parquet(source), lambda b: b.withColumn("y", F.col("x") * 2), ["key"], out, mark)

    with pytest.raises(FileNotFoundError):
        results(spark, out, ["key"])
    os.makedirs(f"{out}/batch_seq=0/_temporary")  # a job lost while it wrote
    assert finished(spark, out) is None
    arrive([("a", 1.0), ("b", 2.0)])
    arrive([("b", 9.0), ("c", 3.0)])
    assert sorted((r.key, r.y) for r in results(spark, out, ["key"]).collect()) == [("a", 2.0), ("b", 4.0), ("c", 6.0)]
