"""Spark holds small blocks of rows; a task joins some of the same part to count or move them, and hands them on as they were."""

import numpy as np
import pytest
from pyspark.sql import Row

from kerbside.plans import boosting

SIZES = [9, 4, 30]


@pytest.fixture
def blocks():
    pick = np.random.default_rng(7)
    return [(part, np.array([pick.integers(0, size, n) for size in SIZES]).astype(np.uint8), pick.normal(size=(2, n)))
            for part, n in [(0, 100), (1, 90), (0, 100), (0, 70), (1, 100), (0, 100), (0, 3)]]


def test_blocks_are_held_as_they_are_stored(blocks):
    rows = [Row(part=part, n=bins.shape[1], bins=bins.tobytes(), goal=goals.tobytes()) for part, bins, goals in blocks]
    held = list(boosting._blocks(iter(rows), [np.uint8, np.uint8]))
    assert [(part, bins.shape, goals.shape) for part, bins, goals in held] == [(part, bins.shape, goals.shape) for part, bins, goals in blocks]
    assert all(np.array_equal(a[1], b[1]) and np.array_equal(a[2], b[2]) for a, b in zip(held, blocks))


def test_joined_blocks_are_counted_and_moved(blocks, monkeypatch):
    monkeypatch.setattr(boosting, "JOINED_ROWS", 200)
    assert sorted((part, whole.shape[1]) for part, whole, _, _ in boosting._joined(iter(blocks))) == [(0, 173), (0, 200), (1, 190)]
    tree = boosting.Levels(1)
    tree.feature[0][0], tree.cut[0][0], tree.leaf[:] = 2, 12, [5, 7]
    asked = boosting.Asked(0, 1, [0, 1, 2], SIZES, tree, 1, [0, 1], False)
    found = next(boosting._count([asked])(iter(blocks))).reshape(asked.shape)
    bins, goals = (np.concatenate([b[i] for b in blocks if b[0] == 0], axis=1) for i in (1, 2))
    for node, there in enumerate((bins[2] <= 12, bins[2] > 12)):
        for kind, weight in enumerate((goals[1][there], None)):
            assert np.allclose(found[kind, node], np.concatenate([np.bincount(bins[r][there], weight, SIZES[r]) for r in range(3)]), rtol=0, atol=1e-12)
    before = {part: sorted(b[2].tobytes() for b in blocks if b[0] == part) for part in (0, 1)}
    moved = list(boosting._moved([(0, 1, tree, False, 0.5)])(iter(blocks)))
    for part, own, goals in moved:
        back = goals.copy()
        if part == 0:
            back[1] += np.where(own[2] <= 12, 5, 7)
        assert any(np.allclose(np.frombuffer(b).reshape(2, -1), back, rtol=0, atol=1e-12) for b in before[part] if len(b) == back.nbytes)
    assert sorted(b.shape[1] for _, b, _ in moved) == sorted(b.shape[1] for _, b, _ in blocks)
