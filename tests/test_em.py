"""EM passes of a mixture against a plain version on the given vectors."""

import numpy as np
import pytest

from cadenza.operators import gaussians
from cadenza.plans import models

SF = "/root/testdata/sf0.001"


def test_em_passes_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "embedding").collect()
    x, label = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["label"] for r in rows])
    names = np.unique(label)
    mean = np.stack([x[label == k].mean(axis=0) for k in names])
    var = np.maximum(np.stack([x[label == k].var(axis=0) for k in names]), 1e-4)
    want = []
    for _ in range(3):
        ll = np.stack([-0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1) for m, v in zip(mean, var, strict=True)], axis=1)
        best = ll.max(axis=1, keepdims=True)
        want.append(float((np.log(np.exp(ll - best).mean(axis=1)) + best[:, 0]).sum()))
        share = np.where(ll < best - 22.0, 0.0, np.exp(ll - best))
        gamma = share / share.sum(axis=1, keepdims=True)
        occ = gamma.sum(axis=0)
        mean = gamma.T @ x / occ[:, None]
        var = np.maximum(gamma.T @ (x * x) / occ[:, None] - mean**2, 1e-4)
    got = sorted(models.em_passes(spark, SF).collect(), key=lambda r: r["pass"])
    assert [r["total_ll"] for r in got] == pytest.approx(want, abs=2e-3)
    assert [r["frames"] for r in got] == [len(x)] * 3
    assert got[1]["delta"] == pytest.approx((want[1] - want[0]) / len(x), abs=2e-3) and got[0]["delta"] is None


def test_kmeans_stops_and_reports_empty_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(40, 2)) + c for c in ((0, 0), (5, 0), (0, 6))])
    start = x[[0, 1, 50]]
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    seeds = lambda c: spark.createDataFrame([(k, d, float(v)) for k, row in enumerate(c) for d, v in enumerate(row)], "k int, dim int, c double")
    centres, errors = start.copy(), []
    while True:
        far = ((x[:, None] - centres) ** 2).sum(axis=2)
        errors.append(far.min(axis=1).sum())
        if len(errors) > 1 and (errors[-2] - errors[-1]) / errors[-2] <= 1e-3:
            break
        centres = np.stack([x[far.argmin(axis=1) == k].mean(axis=0) for k in range(3)])
    got, telemetry = gaussians.kmeans_converged(frame, seeds(start))
    assert [t["error"] for t in telemetry] == pytest.approx(errors) and telemetry[0]["fell"] is None
    assert {(r["k"], r["dim"]): r["c"] for r in got.collect()} == pytest.approx({(k, d): centres[k, d] for k in range(3) for d in range(2)})
    assert len(gaussians.kmeans_converged(frame, seeds(start), 0.0, 1)[1]) == 2
    with pytest.raises(ValueError, match="empty clusters: \\[1\\]"):
        gaussians.kmeans_converged(frame, seeds([[0.0, 0.0], [500.0, 500.0]]))


def test_kmeans_reads_equal_vectors_once(spark, monkeypatch):
    frame = spark.createDataFrame([([float(n % 4), 0.0],) for n in range(200)], "v array<double>")
    start = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 3.0), (1, 1, 0.0)], "k int, dim int, c double")
    seen, nearest = [], gaussians.nearest
    monkeypatch.setattr(gaussians, "nearest", lambda vectors, centres: seen.append(vectors.count()) or nearest(vectors, centres))
    got, telemetry = gaussians.kmeans_converged(frame, start)
    assert set(seen) == {4} and telemetry[-1]["error"] == 50.0
    assert {(r["k"], r["dim"]): r["c"] for r in got.collect()} == {(0, 0): 0.5, (0, 1): 0.0, (1, 0): 2.5, (1, 1): 0.0}
