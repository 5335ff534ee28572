"""Class-based adaptation: planted transforms, normal equations, inverses, tied starts and class files."""

import numpy as np
import pytest

from cadenza.operators import adaptation

ACC = "class int, stream int, mean array<double>, var array<double>, n double, sums array<double>"


def accumulators(spark, rng, planted, each=20, dim=3):
    rows = []
    for (c, s), (a, b) in planted.items():
        for _ in range(each):
            mean, n = rng.normal(size=dim) * 3, float(rng.integers(1, 50))
            rows.append((c, s, mean.tolist(), (rng.random(dim) + 0.2).tolist(), n, (n * (a @ mean + b)).tolist()))
    return rows


def test_planted_transforms_are_found(spark):
    rng = np.random.default_rng(0)
    planted = {(c, s): (np.eye(3) + rng.normal(size=(3, 3)) * 0.3, rng.normal(size=3)) for c in (0, 1) for s in (0, 1)}
    rows = accumulators(spark, rng, planted) + [(7, 0, [1.0, 2.0, 3.0], [1.0, 1.0, 1.0], 0.0, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, ACC).repartition(3)
    found = adaptation.transforms(frame)
    got = {(r["class"], r["stream"]): (np.array(r["a"]), np.array(r["b"])) for r in found.collect()}
    for k, (a, b) in planted.items():
        assert np.allclose(got[k][0], a) and np.allclose(got[k][1], b)
    assert np.allclose(got[7, 0][0], np.eye(3)) and not got[7, 0][1].any()
    model = frame.selectExpr("class", "stream", "mean", "mean AS start")
    moved = adaptation.adapted(model, found)
    for r in moved.collect():
        a, b = planted.get((r["class"], r["stream"]), (np.eye(3), np.zeros(3)))
        assert np.allclose(r["mean"], a @ np.array(r["start"]) + b)
    assert all(np.allclose(r["mean"], r["start"]) for r in adaptation.adapted(moved, adaptation.inverse(found)).collect())
    alone = spark.createDataFrame([(9, 0, [1.0, 1.0])], "class long, stream int, mean array<double>")
    assert adaptation.adapted(alone, found).first()["mean"] == [1.0, 1.0]


def test_normal_equations_of_noisy_data(spark):
    rng = np.random.default_rng(1)
    rows = [(0, 0, rng.normal(size=2).tolist(), (rng.random(2) + 0.1).tolist(), float(rng.integers(0, 9)), rng.normal(size=2).tolist()) for _ in range(40)]
    frame = spark.createDataFrame(rows, ACC)
    mean, var, n, sums = (np.array([r[k] for r in rows], dtype=float) for k in (2, 3, 4, 5))
    seen = n > 0
    for kind in ("affine", "scale", "shift"):
        r = adaptation.transforms(frame, kind).first()
        for d in range(2):
            w = np.sqrt(n[seen] / var[seen, d])
            y = sums[seen, d] / n[seen]
            e = {"affine": np.column_stack([mean[seen], np.ones(seen.sum())]), "scale": mean[seen], "shift": np.ones((seen.sum(), 1))}[kind]
            want = np.linalg.lstsq(e * w[:, None], (y - (mean[seen, d] if kind == "shift" else 0)) * w, rcond=None)[0]
            got = {"affine": [*r["a"][d], r["b"][d]], "scale": r["a"][d], "shift": [r["b"][d]]}[kind]
            assert np.allclose(got, want)
    with pytest.raises(ValueError):
        adaptation.transforms(frame, "other")
    singular = spark.createDataFrame([(0, 0, [[1.0, 1.0], [1.0, 1.0]], [0.0, 0.0])], "class long, stream int, a array<array<double>>, b array<double>")
    with pytest.raises(Exception, match="Singular"):
        adaptation.inverse(singular).collect()


def test_classes_split_where_means_differ(spark):
    rows = [(n, 1.0, [float(n // 4 * 10), float(n % 2), 5.0]) for n in range(8)] + [(8, 0.0, [11.0, 0.2, 5.0])]
    model = spark.createDataFrame(rows, "cb int, n double, mean array<double>")
    got = {r["cb"]: r["class"] for r in adaptation.regression_classes(model, ["cb"], 2).collect()}
    assert got == {n: 2 * (n // 4) + n % 2 for n in range(8)} | {8: 2}
    assert {r["class"] for r in adaptation.regression_classes(model, ["cb"], 4).filter("n > 0").collect()} == {c * 4 for c in range(4)}  # equal means stay together


def test_tied_starts_and_class_files(spark):
    values = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0), (2, 0, 100.0)], "state int, place int, value double")
    mapping = spark.createDataFrame([(0, 10), (1, 10), (0, 10), (1, 11), (9, 12)], "src int, dst int")
    got = {(r["state"], r["place"]): r["value"] for r in adaptation.averaged_sources(values, mapping, "state").collect()}
    assert got == {(10, 0): 3.0, (10, 1): 5.0, (11, 0): 5.0, (11, 1): 7.0}
    classes = spark.createDataFrame([(5, 1), (2, None), (9, 0)], "cb int, class int")
    lines = adaptation.class_lines(classes, "cb", "class")
    assert [tuple(r) for r in lines.orderBy("line_no").collect()] == [(0, "-1"), (1, "1"), (2, "0")]
    assert [tuple(r) for r in adaptation.read_classes(lines, 2).orderBy("cb").collect()] == [(0, -1), (1, 1), (2, 0)]
    for bad in ("2", "x", "", "-2", "1.0"):
        with pytest.raises(Exception, match="no class"):
            adaptation.read_classes(spark.createDataFrame([(0, bad)], "line_no int, line string"), 2).collect()
