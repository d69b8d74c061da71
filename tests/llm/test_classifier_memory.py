import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import cotrain


class Taken(Exception):
    pass


class Labelled:
    """Stands for the labelled rows and hands out the scan that finds their features."""

    def agg(self, *_):
        return self

    def first(self):
        return 1, 1

    def mapInArrow(self, run, _):
        raise Taken(run)


def test_scan_of_labelled_rows_takes_little_memory(spark):
    """On an executor two such scans run beside a full heap; slices of 4 MB of text took 150 MB each."""
    with pytest.raises(Taken) as found:
        cotrain.candidates(Labelled())
    words = np.random.default_rng(1).integers(0, 60_000, (2000, 700)).astype(str)
    text = [" ".join(w) for w in words]
    n = len(text)
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(text), pa.array(["en"] * n), pa.array(["web"] * n), pa.array([len(t) for t in text]), pa.array([k % 2 for k in range(n)], pa.int32())], names=["id", "text", "lang", "source", "length", "label"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in found.value.args[0](iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 80 << 20, peak
