"""What the Jaccard join holds in a task's memory."""

import tracemalloc

import numpy as np

from cityloom.llm.jaccard import pair_bounds


def test_pair_bounds_hold_little():
    """Points of many groups are looked up in strips of bytes, not of pairs: before, some 400 MB for these."""
    rng = np.random.default_rng(0)
    x, y = (rng.integers(0, 5, (128, 8192)).astype(np.uint8) for _ in "xy")
    i, j = np.repeat(np.arange(128), 128), np.tile(np.arange(128), 128)
    tracemalloc.start()
    got, most = pair_bounds(x, i, y, j), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64e6
    assert got[:300].tolist() == [int(np.minimum(x[a], y[b]).sum()) for a, b in zip(i[:300], j[:300], strict=True)]


def test_batches_are_put_back(spark):
    from cityloom.llm.common import batches_of

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with batches_of(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == before
