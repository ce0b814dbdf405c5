"""Pictures stay where they are made: queries that say something of them carry no arrays of pixels."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import images
from strandline.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def mixed(spark):
    rnd = np.random.default_rng(5)
    rows = [(f"w{i}", p, rnd.uniform(-9, 99, n).tolist()) for i, (n, p) in enumerate([(24, 4), (24, 13), (31, 4), (192, 7), (24, 4), (100, 90)] * 30)]
    rows += [("none", 4, [None, float("nan"), float("inf"), 1.0]), ("flat", 13, [2.0] * 24), ("one", 1, [5.0])]
    return spark.createDataFrame(rows, "physical_window_id string, period int, history array<double>").coalesce(1)


def test_extents_are_those_of_the_views(spark):
    seen = {r[0]: tuple(r[1:]) for r in images.extents(mixed(spark)).drop("period").collect()}
    made = images.imageize(mixed(spark)).select("physical_window_id", F.size("view"), F.array_min("view"), F.array_max("view"))
    assert seen == {r[0]: tuple(r[1:]) for r in made.collect()} and len(seen) == 183


def test_views_of_mixed_windows_keep_their_place(spark):
    for r in images.imageize(mixed(spark)).join(mixed(spark), ["physical_window_id"]).drop("period").collect()[::7]:
        x = np.array([[np.nan if v is None else v for v in r.history]])
        p = mixed(spark).filter(F.col("physical_window_id") == r.physical_window_id).first().period
        z = images.normalize(x)[0]
        line = images.unit(images.resize(z, images.WIDTH, 1, corners=True)) * (images.HEIGHT - 1)
        want = np.maximum(0.0, 1 - np.abs(np.arange(images.HEIGHT)[:, None] - line))
        got = np.array(r["view"]).reshape(3, images.HEIGHT, images.WIDTH)
        assert got[0] == pytest.approx(want, abs=1e-6)
        assert got[1] == pytest.approx(images.fold_view(z, p)[0][0], abs=1e-6)
        assert (got[2] == got[2][0]).all() and r.num_cycles == -(-x.shape[1] // p)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not there")
def test_no_pixels_leave_the_workers(spark):
    plan = catalog.view_images(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "view#" not in plan


def test_equal_histories_are_encoded_once(spark, monkeypatch):
    kept, encoded, encode = {}, [], images.encode
    monkeypatch.setattr(images, "_map", lambda windows, kinds, made, *_: kept.update(made=made, windows=windows) or windows)
    monkeypatch.setattr(images, "encode", lambda v, w: encoded.append(len(v)) or encode(v, w))
    images.embed(mixed(spark), 4)
    x = np.random.default_rng(3).uniform(0, 9, (70, 24))[np.arange(500) % 70]
    x[7, 3] = x[400, 3] = np.nan
    (z,) = kept["made"](x, 13)
    assert sum(encoded) == 72
    assert z.shape == (500, 4) and z == pytest.approx(encode(images.views(x, 13)[0], images.encoder_weights(4)), abs=2e-6)
    assert (z[140:210] == z[:70])[[i for i in range(70) if i not in (7, 50)]].all()
    assert "RebalancePartitions" in kept["windows"]._jdf.queryExecution().optimizedPlan().toString()


def test_embeddings_of_mixed_windows_keep_their_place(spark):
    weights = images.encoder_weights(4)
    made = {r.physical_window_id: r.z for r in images.embed(mixed(spark).repartition(3), 4).collect()}
    rows = mixed(spark).collect()
    assert len(made) == len(rows)
    for r in rows[::9] + rows[-3:]:
        x = np.array([[np.nan if v is None else v for v in r.history]])
        assert made[r.physical_window_id] == pytest.approx(images.encode(images.views(x, r.period)[0], weights)[0], abs=2e-6)
