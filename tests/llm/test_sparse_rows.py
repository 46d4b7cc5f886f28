"""The driver's sparse matrices: the same order as a stable sort, in little memory."""

import tracemalloc

import numpy as np
import pytest

from tileframe.llm import toxicity
from tileframe.llm.toxicity import Rows


@pytest.mark.parametrize("weighted", [False, True])
def test_order_of_entries(weighted, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 100)
    r = np.random.default_rng(3)
    lengths = r.integers(1, 9, 500)
    columns = r.integers(0, 90, lengths.sum()).astype("int32")
    weights = r.random(len(columns)) if weighted else None
    rows = Rows(lengths, columns, weights, 90)
    order = np.argsort(columns, kind="stable")
    used, at = np.unique(columns[order], return_index=True)
    assert np.array_equal(rows.used, used) and np.array_equal(rows.back_starts, np.append(at, len(columns)))
    assert np.array_equal(rows.back_rows, np.repeat(np.arange(500), lengths)[order])
    dense = np.zeros((500, 90))
    np.add.at(dense, (np.repeat(np.arange(500), lengths), columns), weights if weighted else np.repeat(1 / lengths, lengths))
    x, g = r.random((90, 3)), r.random((500, 3))
    assert np.allclose(rows.times(x), dense @ x, atol=1e-5) and np.allclose(rows.back(g), (dense.T @ g)[used], atol=1e-5)


def test_memory_of_many_entries():
    n = 2_000_000
    lengths = np.full(n // 20, 20)
    columns = np.random.default_rng(1).integers(0, 1 << 17, n).astype("int32")
    tracemalloc.start()
    rows = Rows(lengths, columns, None, 1 << 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows.back_rows) == n and peak < 20 * n
