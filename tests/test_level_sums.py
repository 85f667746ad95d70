"""Histograms that follow from others, and rows that are not drawn again."""

import numpy as np
import pytest

from quietstar.catalog import common, models
from quietstar.operators import boosting


def test_level_sums_equal_histograms_with_fewer_cells(monkeypatch):
    draw = np.random.default_rng(8)
    bins, n, depth = 8, 900, 4
    block = {
        "bins": draw.integers(0, bins, (3, n)).astype(np.uint8), "label": draw.integers(0, 2, n).astype(float), "rows": draw.integers(1, 12, n),
        "mask": draw.integers(0, 2, n), "margin": draw.normal(size=(1, n)), "own": draw.integers(0, 1 << 62, n).astype(np.uint64),
    }
    gradients = boosting._gradients([(0, 1.7)], 0.8, (42, 3), block)
    added, real = [], boosting._node_sums
    monkeypatch.setattr(boosting, "_node_sums", lambda node, *rest: added.append(len(node)) or real(node, *rest))
    sums = boosting._level_sums(bins, gradients[0], block)

    def both(tree, level):
        got = sums(tree, level)
        assert np.array_equal(got, boosting._histograms(tree, level, bins, gradients, block))
        return got

    booster = boosting.GBTClassifier(featuresCol=["a", "b", "c"], maxDepth=depth)
    tree = booster._grow(both, 0, 1, [0])
    assert (tree.feature >= 0).sum() > 4 and max(added[1:]) <= added[0] / 2


def test_drawn_rows_hash_only_cells_that_have_the_row(monkeypatch):
    hashed, real = [], boosting._uniform
    monkeypatch.setattr(boosting, "_uniform", lambda own, *salts: hashed.append(len(own)) or real(own, *salts))
    rows = np.array([1] * 90 + [3] * 10)
    own = np.arange(100).astype(np.uint64)
    drawn = boosting.drawn_rows(own, rows, 0.8, 1, 2)
    assert hashed[:3] == [100, 10, 10]
    want = sum((rows > i) & (real(own, 1, 2, i) < 0.8) for i in range(3))
    assert np.array_equal(drawn, want)


def test_metrics_store_the_labelled_rows_once(spark, sf_dir, monkeypatch):
    class Stored(Exception):
        pass

    def stop(s, df, name):
        raise Stored(name, df.columns)

    monkeypatch.setattr(common, "read_back", stop)
    with pytest.raises(Stored) as found:
        models.QUERIES["ml_metrics"](spark, sf_dir)
    assert found.value.args[0] == "labelled" and "review_text" not in found.value.args[1]
