"""The window passes hold the arrays of a bounded part of a batch at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from nearwell.llm import passages, repeats


@pytest.mark.parametrize("run", [passages._windows(46), repeats._keys])
def test_windows_of_a_large_batch_take_bounded_memory(run):
    words = np.random.default_rng(1).integers(10 ** 5, 10 ** 6, (60, 10_000))
    batch = pa.record_batch({"doc_id": np.arange(60), "text": [" ".join(map(str, row)) for row in words]})
    for _ in run(iter([batch.slice(0, 1)])):
        pass
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak >> 20
