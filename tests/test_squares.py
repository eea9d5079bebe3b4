import numpy as np
import pytest

from cellweave.operators import squares


@pytest.mark.parametrize("exact_cells, block", [(10, 2_000_000), (0, 2_000_000), (0, 50)])
@pytest.mark.parametrize("grid", [0, 1, 8])
def test_sums_match_all_pairs(monkeypatch, exact_cells, block, grid):
    monkeypatch.setattr(squares, "EXACT_CELLS", exact_cells)
    monkeypatch.setattr(squares, "BLOCK", block)
    rng = np.random.default_rng(grid)
    for half in (3.0, 10.0, 25.0):
        p, c, n_items = 400, 90, 5
        px, py, cx, cy = (rng.uniform(0, 60, k) for k in (p, p, c, c))
        if grid:
            px, py, cx, cy = (np.round(v * grid) / grid for v in (px, py, cx, cy))
        held = rng.integers(0, 5, p)
        first = np.concatenate([[0], np.cumsum(held)])
        code, n = rng.integers(0, n_items, first[-1]), rng.integers(1, 9, first[-1]).astype(float)
        weights = np.zeros((p, n_items))
        np.add.at(weights, (np.repeat(np.arange(p), held), code), n)
        inside = (abs(px - cx[:, None]) <= half) & (abs(py - cy[:, None]) <= half)
        assert (squares.sums(px, py, first, code, n, n_items, cx, cy, half) == inside @ weights).all()


def test_work_does_not_grow_with_pairs(monkeypatch):
    """Points read one by one grow with the root of the density."""
    read = []
    runs = squares._runs
    monkeypatch.setattr(squares, "_runs", lambda start, size: read.append(int(size.sum())) or runs(start, size))
    rng = np.random.default_rng(1)
    for n in (2_000, 8_000):
        px, py = rng.uniform(0, 100, n), rng.uniform(0, 100, n)
        read.append(0)
        squares.sums(px, py, np.arange(n + 1), np.zeros(n, int), np.ones(n), 1, px[:500], py[:500], 25.0)
        read.append(-1)
    cut = read.index(-1)
    assert sum(read[cut + 1:-1]) < 2.6 * sum(read[:cut])
