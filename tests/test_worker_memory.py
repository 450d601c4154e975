"""What a Python worker holds beside its batch does not grow with the batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from dwellrank.operators import attention


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_chunk_scores_hold_one_portion():
    draw = random.Random(3)
    rows = [[" ".join(f"w{draw.randrange(200000)}" for _ in range(80)) for _ in range(20)] for _ in range(200)]
    questions = pa.array([f"w{k} w{k + 1}" for k in range(len(rows))])

    def run(n):
        return sum(len(part) for part in attention.portioned_cosines(questions.slice(0, n), pa.array(rows[:n]), 128))

    assert run(200) == 200
    small, large = (peak_mb(lambda n=n: run(n)) for n in (50, 200))  # 80 and 320 thousand words, nearly all of them different
    assert large < 60 and large < 1.5 * small


def test_one_long_text_is_scored_in_portions():
    rows = attention.hash_rows([str(k) for k in range(500)], 128)
    chunks = [np.arange(80) + k % 400 for k in range(3000)]
    expected = np.concatenate([attention._mean_cosines(rows, [c], np.arange(5)) for c in chunks])
    found = []
    assert peak_mb(lambda: found.append(attention._mean_cosines(rows, chunks, np.arange(5)))) < 60
    assert np.allclose(found[0], expected, rtol=1e-12)
