"""Workers of the gaze queries return what a batch took."""

import numpy as np
import pyarrow as pa

from dwellrank.operators import tokens


def test_runs_give_back_after_every_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(tokens, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["e"]), pa.array([0], pa.int32()), pa.array([2], pa.int32()), pa.array([1], pa.int64()), pa.array([[0.5, 0.5]])], ["example_id", "part", "length", "n", "gaze"])
    (out,) = tokens._summed_in_portions(iter([batch, batch]))
    assert len(calls) == 2
    assert out.to_pylist()[0]["n"] == 2 and np.allclose(out.to_pylist()[0]["gaze"], [1, 1])
