"""Folders that steps leave behind, read again."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import codebook, images, registry
from strandline.plans import adapters
from strandline.sources import bundles as B
from strandline.sources import tables as T


@pytest.fixture(scope="module")
def made(spark):
    days = spark.range(60).select(F.lit("hour").alias("subset"), F.lit(3).cast("long").alias("item_id"), F.lit(8).alias("cluster"), F.timestamp_seconds(F.col("id") * 86400 + 946684800).alias("date_time"), *[(F.col("id") % 7).cast("double").alias(c) for c in adapters.CHANNELS])
    config = registry.RegistryConfig(**{**adapters.CONFIG.__dict__, "cutoff": "2000-02-10 00:00:00", "history_len": 8, "pred_len": 4})
    return config, registry.build_registry(days, codebook.official_codebook(spark), config, adapters.PERIODS, values=("history", "target"))


def test_registry_and_subset(spark, tmp_path, made):
    config, rows = made
    full, part = f"{tmp_path}/full", f"{tmp_path}/part"
    path = B.registry_folder(rows.drop("history", "target"), full, config)
    m = T.read_manifest(spark, f"{full}/manifest.json")
    assert m["counts"]["rows"] == rows.count() == spark.read.parquet(path).count() and m["base_registry_id"] == registry.base_registry_id(config)
    assert "history_len: 8" in T.read_text(spark, f"{full}/config.yaml")
    few = spark.read.parquet(path).limit(5)
    B.registry_subset(few, full, part, sampled=5)
    s = T.read_manifest(spark, f"{part}/manifest.json")
    assert s["counts"]["rows"] == 5 and s["sampled"] == 5 and s["sample_set_id"] == m["sample_set_id"]
    assert T.read_text(spark, f"{part}/config.yaml") == T.read_text(spark, f"{full}/config.yaml")
    with pytest.raises(FileExistsError):
        B.registry_subset(few, full, part)
    B.registry_report(spark.read.parquet(path), f"{tmp_path}/report")
    assert "## split_subset_cell" in T.read_text(spark, f"{tmp_path}/report/report.md")
    assert json.loads(T.read_text(spark, f"{tmp_path}/report/summary.json"))["items"] == 1


def test_proxy(spark, tmp_path):
    p = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 2.0)], "physical_window_id string, sample_set_id string, mean double")
    assert B.proxy_folder(p, f"{tmp_path}/p")["format"] == "parquet"
    assert B.read_proxy(spark, f"{tmp_path}/p", ["physical_window_id"]).columns == ["physical_window_id"]
    assert B.proxy_folder(p, f"{tmp_path}/c", "csv")["output_file"] == "proxy.csv" and B.read_proxy(spark, f"{tmp_path}/c").count() == 2
    assert B.read_proxy(spark, f"{tmp_path}/none") is None
    with pytest.raises(ValueError):
        B.proxy_folder(p.withColumn("sample_set_id", F.col("physical_window_id")), f"{tmp_path}/x")
    with pytest.raises(Exception, match="repeats the key"):
        B.proxy_folder(p.union(p), f"{tmp_path}/y")
    assert B.proxy_folder(p.withColumn("odd", F.expr("interval 1 month")), f"{tmp_path}/z")["format"] in ("csv", "parquet")


def test_views_and_embeddings(spark, tmp_path, made):
    _, rows = made
    few = rows.limit(3)
    B.views_folder(images.imageize(few), f"{tmp_path}/v", pictures=1, note="n")
    m = T.read_manifest(spark, f"{tmp_path}/v/manifest.json")
    assert m == {"shape": [3, 64, 192], "windows": 3, "note": "n"}
    both = images.aligned(spark.read.parquet(f"{tmp_path}/v/views"), spark.read.csv(f"{tmp_path}/v/index.csv", header=True))
    assert both.count() == 3 and both.select(F.size("view")).first()[0] == 3 * 64 * 192
    picture = next((tmp_path / "v" / "pictures").glob("*_0.png")).read_bytes()
    assert struct.unpack(">II", picture[16:24]) == (192, 64)
    B.embeddings_folder(images.embed(few, 4), f"{tmp_path}/e", spark.createDataFrame([("views", 1.0)], "component string, ms double"))
    z = spark.read.parquet(f"{tmp_path}/e/embeddings")
    assert z.columns == ["physical_window_id", "z_0", "z_1", "z_2", "z_3"] and T.read_manifest(spark, f"{tmp_path}/e/manifest.json")["embedding_dim"] == 4
    pixels = np.linspace(0, 1, 12).reshape(3, 4)
    data = B.png(pixels)
    at = data.index(b"IDAT")
    n = struct.unpack(">I", data[at - 4 : at])[0]
    raw = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), np.uint8).reshape(3, 5)
    assert (raw[:, 0] == 0).all() and (raw[:, 1:] == np.round(pixels * 255)).all()


def test_configurations():
    assert B.search_space({"config": {"search_space": {"lr": 1}}}) == {"lr": 1}
    assert B.search_space({}, {"config": {"search_space": {"lr": 2}}}) == {"lr": 2}
    with pytest.raises(FileNotFoundError):
        B.search_space({}, {})
    config = {"data": {"datasets": {"H": {"ids": []}, "M": {"ids": []}}}}
    assert B.patched_datasets(config, {"H": [1, 2], "M": []}) == {"data": {"datasets": {"H": {"ids": [1, 2]}}}}
    assert config["data"]["datasets"]["M"] == {"ids": []}
    with pytest.raises(ValueError):
        B.patched_datasets(config, {"H": [], "M": []})
