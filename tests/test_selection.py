"""Trees of Gaussian boxes: members against the definition, recall against all densities."""

import numpy as np
import pytest

from cadenza.operators import selection

MODEL = "cb int, density int, mean array<double>, var array<double>"


def frames_of(spark, x, cb):
    return spark.createDataFrame([(n, int(c), v.tolist()) for n, (v, c) in enumerate(zip(x, cb, strict=True))], "id int, cb int, vec array<double>")


def test_members_and_selection(spark, monkeypatch):
    rng = np.random.default_rng(0)
    mean, var = rng.normal(size=(2, 40, 2)) * 6, rng.random((2, 40, 2)) + 0.3
    model = spark.createDataFrame([(c, d, mean[c, d].tolist(), var[c, d].tolist()) for c in range(2) for d in range(40)], MODEL)
    trees = selection.box_trees(model, "cb", 0.2, 4)
    nodes = {(r["cb"], r["node"]): r for r in trees.collect()}
    assert {n for c, n in nodes if c == 0} == set(range(15))
    low, high = selection.boxes(mean[0], var[0], 0.2)
    peak = np.exp(-0.5 * (high - mean[0]) ** 2 / var[0])
    assert np.allclose(peak, 0.2)
    # Every node lists the boxes that reach into its cell, and its plane halves their edges.
    cells = {0: (low.min(axis=0), high.max(axis=0))}
    for n in range(15):
        lower, upper = cells[n]
        r = nodes[0, n]
        assert r["densities"] == [d for d in range(40) if (low[d] <= upper).all() and (high[d] >= lower).all()]
        if r["dim"] is None:
            assert n >= 7
            continue
        edges = np.sort(np.concatenate([low[r["densities"]], high[r["densities"]]])[:, r["dim"]])
        assert edges[len(edges) // 2] == r["plane"]
        inner, outer = upper.copy(), lower.copy()
        inner[r["dim"]] = outer[r["dim"]] = r["plane"]
        cells[2 * n + 1], cells[2 * n + 2] = (lower, inner), (outer, upper)
    cb = rng.integers(0, 3, size=600)  # codebook 2 has no densities
    x = np.array([mean[min(c, 1), rng.integers(40)] + rng.normal(size=2) * 0.7 for c in cb])
    for block in (16384, 50):
        got = selection.selected_densities(frames_of(spark, x, cb), model, trees, "cb", ["id"], 2, block=block).collect()
        first = {r["id"]: r for r in got if r["rank"] == 1}
        assert set(first) == set(np.flatnonzero(cb < 2).tolist())
        hits = 0
        for n in first:
            ll = -0.5 * (np.log(2 * np.pi * var[cb[n]]) + (x[n] - mean[cb[n]]) ** 2 / var[cb[n]]).sum(axis=1)
            hits += int(ll.argmax()) == first[n]["density"]
            assert first[n]["score"] == pytest.approx(ll[first[n]["density"]])
        assert hits > 0.95 * len(first)
        assert np.mean([r["scored"] for r in first.values()]) < 20
        assert all(r["score"] <= first[r["id"]]["score"] for r in got if r["rank"] == 2)


def test_thresholds_and_degenerate_models(spark):
    same = spark.createDataFrame([(0, d, [1.0, 1.0], [0.0, 0.0]) for d in range(3)], MODEL)
    trees = selection.box_trees(same, "cb", 0.5, 3)
    assert all(r["densities"] == [0, 1, 2] for r in trees.collect())
    best = selection.selected_densities(frames_of(spark, np.array([[1.0, 1.0]]), [0]), same, trees, "cb", ["id"]).collect()
    assert [(r["density"], r["scored"]) for r in best] == [(0, 3)]
    for bad in (0.0, 1.5, -1.0):
        with pytest.raises(ValueError):
            selection.box_trees(same, "cb", bad)
    low, high = selection.boxes(np.zeros((1, 2)), np.ones((1, 2)), -5.0, absolute=True)
    at_edge = -0.5 * (2 * np.log(2 * np.pi) + high[0, 0] ** 2)
    assert at_edge == pytest.approx(-5.0) and np.allclose(low, -high)


def test_partitions_grow_with_the_frames(spark):
    x, cb = np.arange(3000.0).reshape(1500, 2) % 7, [0] * 1500
    model = spark.createDataFrame([(0, 0, [1.0, 1.0], [1.0, 1.0])], "cb int, density int, mean array<double>, var array<double>")
    got = selection.selected_densities(frames_of(spark, x, cb), model, selection.box_trees(model, "cb"), "cb", ["id"], block=1)
    assert got.rdd.getNumPartitions() >= 1500 // selection.BLOCKS > int(spark.conf.get("spark.sql.shuffle.partitions")) and got.count() == 1500
