"""Views and embeddings of the catalog come for every window."""

import os

import numpy as np
import pytest

from strandline.operators import images
from strandline.plans import adapters, catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not there")
def test_views_of_all_windows(spark):
    windows = {r.physical_window_id: r for r in adapters.windows(spark, FOLDER, target=False).collect()}
    seen = catalog.view_images(spark, FOLDER).collect()
    made = catalog.view_embeddings(spark, FOLDER).collect()
    assert sorted(r.physical_window_id for r in seen) == sorted(r.physical_window_id for r in made) == sorted(windows)
    assert len(windows) > 100 and len({tuple(r.z) for r in made}) > 100
    weights = images.encoder_weights(32)
    seen = {r.physical_window_id: r for r in seen}
    for r in made[::50]:
        w = windows[r.physical_window_id]
        v, _ = images.views(np.array([w.history], float), w.period)
        assert (seen[w.physical_window_id]["values"], seen[w.physical_window_id].low, seen[w.physical_window_id].high) == (v.size, pytest.approx(v.min(), abs=1e-4), pytest.approx(v.max(), abs=1e-4))
        assert r.z == pytest.approx(images.encode(v, weights)[0], abs=5e-6)
    few = adapters.windows(spark, FOLDER, target=False).limit(3)
    for r in images.embed(few, 8, encoder="projection").collect():
        w = windows[r.physical_window_id]
        small = images.views(np.array([w.history], float), w.period)[0].reshape(3, 8, 8, 24, 8).mean((2, 4)).ravel()
        assert r.z == pytest.approx(np.tanh(small @ images.projection(8)), abs=2e-4)
    with pytest.raises(ValueError):
        images.embed(few, encoder="other")
