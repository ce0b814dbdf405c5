"""Timings of the window kernels on the machine at hand, by batch size."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strandline.operators.images import encode, encoder_weights, views
from strandline.operators.proxy import batched


def kernels(history: int, period: int, dims: int = 32) -> dict[str, Callable[[np.ndarray], object]]:
    """The kernels that work on a batch of histories."""
    weights = encoder_weights(dims)
    return {
        "proxy": lambda x: batched(x, np.full(len(x), period)),
        "views": lambda x: views(x, period)[0],
        "encoder": lambda x: encode(views(x, period)[0], weights),
    }


def sweep(spark: SparkSession, history: int = 192, period: int = 24, batches: Sequence[int] = (1, 128, 512), repeat: int = 3, seed: int = 0, components: Sequence[str] = ("proxy", "views")) -> DataFrame:
    """(component, batch, total_ms, ms_per_window) of the least of ``repeat`` timed runs after a warm-up one, over seeded random histories."""
    known = kernels(history, period)
    rnd, rows = np.random.default_rng(seed), []
    for n in batches:
        if n <= 0:
            raise ValueError("a batch must have windows")
        x = rnd.standard_normal((n, history)).cumsum(1)
        for name in components:
            known[name](x)
            took = []
            for _ in range(repeat):
                began = time.perf_counter()
                known[name](x)
                took.append(time.perf_counter() - began)
            rows.append((name, n, min(took) * 1e3, min(took) * 1e3 / n))
    return spark.createDataFrame(rows, "component string, batch int, total_ms double, ms_per_window double")
