"""Lattice posteriors against the enumeration of paths, and updates against the formulas of one dimension."""

import math

import numpy as np
import pytest

from cadenza.operators import discriminative

ARCS = "utt string, arc int, src int, dst int, acoustic double, language double"


def paths(arcs, node, ends):
    if node in ends:
        yield []
    for a in arcs:
        if a[2] == node:
            for rest in paths(arcs, a[3], ends):
                yield [a, *rest]


def test_posteriors_against_all_paths(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(6):
        for n in range(12):
            a, b = sorted(rng.choice(7, size=2, replace=False).tolist())
            # Node numbers say nothing about the order.
            rows.append((f"u{u}", n, (a * 5 + u) % 7 + 10, (b * 5 + u) % 7 + 10, float(rng.normal()) * 10, float(rng.normal())))
    rows += [("two", 0, 1, 2, -1.0, 0.0), ("two", 1, 1, 2, -2.0, 0.0), ("two", 2, 1, 2, None, 0.0), ("none", 0, 1, 2, None, 0.0)]
    found = {(r["utt"], r["arc"]): r for r in discriminative.arc_posteriors(spark.createDataFrame(rows, ARCS), "utt", 10.0).collect()}
    assert len(found) == len(rows)
    for utt in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == utt and r[4] is not None]
        starts = {r[2] for r in own} - {r[3] for r in own}
        ends = {r[3] for r in own} - {r[2] for r in own}
        ways = [(math.exp(sum(a[4] / 10 + a[5] for a in p)), p) for s in starts for p in paths(own, s, ends)]
        total = sum(w for w, _ in ways)
        for a in own:
            assert math.exp(found[utt, a[1]]["log_posterior"]) == pytest.approx(sum(w for w, p in ways if a in p) / total)
            assert found[utt, a[1]]["log_total"] == pytest.approx(math.log(total))
    assert found["two", 2]["log_posterior"] is None and found["none", 0]["log_total"] is None
    loop = spark.createDataFrame([("u", 0, 1, 2, 0.0, 0.0), ("u", 1, 2, 1, 0.0, 0.0)], ARCS)
    with pytest.raises(Exception, match="cycle"):
        discriminative.arc_posteriors(loop, "utt").collect()


def test_occupancies_and_sums(spark):
    posteriors = spark.createDataFrame([("u", 0, math.log(0.25), 0.0), ("u", 1, math.log(0.75), 0.0), ("u", 2, None, 0.0)], "utt string, arc int, log_posterior double, log_total double")
    spans = spark.createDataFrame([("u", 0, "a", 0, 1), ("u", 1, "a", 1, 2), ("u", 1, "b", 2, 2), ("u", 2, "a", 0, 9)], "utt string, arc int, label string, start_frame int, end_frame int")
    gammas = discriminative.occupancies(posteriors, spans, "utt")
    got = {(r["frame"], r["label"]): r["gamma"] for r in gammas.collect()}
    assert got == pytest.approx({(0, "a"): 0.25, (1, "a"): 1.0, (2, "a"): 0.75, (2, "b"): 0.75})
    frames = spark.createDataFrame([("u", n, [float(n), 2.0]) for n in range(4)], "utt string, frame int, vec array<double>")
    sums = {(r["label"], r["dim"]): (r["n"], r["s"], r["q"]) for r in discriminative.label_sums(gammas, frames, "utt").collect()}
    assert sums["a", 0] == pytest.approx((2.0, 2.5, 4.0)) and sums["b", 1] == pytest.approx((0.75, 1.5, 3.0))


def test_updates_keep_variances_positive(spark):
    rng = np.random.default_rng(1)
    model, num, den = [], [], []
    for k in range(8):
        for d in range(2):
            model.append((f"l{k}", d, float(rng.normal()), float(rng.random() + 0.2)))
            x, y = rng.normal(size=9), rng.normal(size=12) * 1.5
            w, v = rng.random(9), rng.random(12)
            if d:
                w, v = num[-1][5], den[-1][5]
            num.append((f"l{k}", d, float(w.sum()), float(w @ x), float(w @ (x * x)), w))
            den.append((f"l{k}", d, float(v.sum()), float(v @ y), float(v @ (y * y)), v))
    schema = "label string, dim int, n double, s double, q double"
    frames = [spark.createDataFrame([r[:5] for r in t], schema) for t in (num, den)]
    gauss = spark.createDataFrame([*model, ("alone", 0, 1.0, 2.0)], "label string, dim int, mean double, var double")
    got = {(r["label"], r["dim"]): r for r in discriminative.updated(gauss, *frames, damp=0.1).collect()}
    assert (got["alone", 0]["mean"], got["alone", 0]["var"]) == (1.0, 2.0)
    for k in range(8):
        rows = [(m, a, b) for m, a, b in zip(model, num, den, strict=True) if m[0] == f"l{k}"]
        needed = 0.0
        for (_, _, mean, var), a, b in rows:
            n, s, q = a[2] - b[2], a[3] - b[3], a[4] - b[4]
            roots = np.roots([var, (var + mean * mean) * n + q - 2 * mean * s, q * n - s * s])
            real = [r.real for r in roots if abs(r.imag) < 1e-9]
            needed = max([needed, 0.1 * b[2], *(2 * r for r in real)])
        for (label, dim, mean, var), a, b in rows:
            n, s, q = a[2] - b[2], a[3] - b[3], a[4] - b[4]
            r = got[label, dim]
            assert r["damping"] == pytest.approx(needed)
            new = (s + needed * mean) / (n + needed)
            assert r["mean"] == pytest.approx(new)
            assert r["var"] == pytest.approx(max(1e-4, (q + needed * (var + mean * mean)) / (n + needed) - new * new))
            assert r["var"] > 1e-4


def test_lattices_together_are_as_alone():
    src, dst = np.array([0, 0, 1, 1, 2]), np.array([1, 2, 2, 3, 3])
    score = np.random.default_rng(5).normal(size=(4, 5))
    total, log = discriminative.posteriors_of(src, dst, score)
    assert log.shape == (4, 5)
    for n in range(4):
        one, alone = discriminative.posteriors_of(src, dst, score[n : n + 1])
        assert one[0] == total[n] and alone[0].tolist() == log[n].tolist()
        paths = [[0, 2, 4], [0, 3], [1, 4]]
        assert np.isclose(total[n], np.logaddexp.reduce([score[n, p].sum() for p in paths]))


def test_statistics_are_summed_where_posteriors_are_made(spark):
    from cadenza.operators.lineage import gathered
    from cadenza.plans import discriminative as plans
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    arcs, frames, rows = [], [], []
    for u in range(40):
        own, n = [], int(rng.integers(1, 6))
        for node in range(n):
            for size in (1, 2, 1):
                if node + size <= n:
                    acoustic = None if rng.random() < 0.15 else float(rng.normal()) * 9
                    own.append((f"u{u}", len(own), node, node + size, acoustic, float(rng.normal()), int(rng.integers(0, 3)), node, node + size - 1 + int(rng.integers(0, 2)), bool(rng.random() < 0.5)))
        vecs = [[None if rng.random() < 0.1 else float(rng.normal()) + 100, float(rng.normal())] for _ in range(n)]
        arcs += own
        frames += [(f"u{u}", k, k % 2, v) for k, v in enumerate(vecs)]
        rows.append(([tuple(a[2:]) for a in own], [(k % 2, v) for k, v in enumerate(vecs)]))
    rows += [([], []), (None, None), ([], [(0, [1.0, None])])]
    frames.append(("x", 0, 0, [1.0, None]))
    span = "label long, start_frame long, end_frame long, numerator boolean"
    lattices = spark.createDataFrame(rows, f"arcs array<struct<src: long, dst: long, acoustic: double, language: double, {span.replace(' ', ': ').replace(',:', ',')}>>, frames array<struct<label: long, vec: array<double>>>")
    found = discriminative.lattice_statistics(lattices, 3.0).cache()
    flat, vecs = spark.createDataFrame(arcs, f"{ARCS}, {span}"), spark.createDataFrame(frames, "utt string, frame int, label int, vec array<double>")
    posteriors = discriminative.arc_posteriors(flat, "utt", 3.0)
    as_dict = lambda df: {(r[0], r[1]): pytest.approx(tuple(r)[2:], rel=1e-9) for r in df.collect()}
    for side, some in (("num", flat.filter("numerator")), ("den", flat)):
        want = discriminative.label_sums(discriminative.occupancies(posteriors, some, "utt"), vecs.drop("label"), "utt")
        got = {(r[0], r[1]): tuple(r)[2:] for r in discriminative.side_sums(found, side).collect()}
        assert got == as_dict(want) and len(got) == 6
    want = vecs.select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    assert {(r[0], r[1]): tuple(r)[2:] for r in discriminative.frame_moments(found).collect()} == as_dict(want)
    # The lines are shuffled once, and nothing of an arc or a frame is.
    kept, cut = [], plans.cut
    plans.cut = lambda df: kept.append(df) or cut(df)
    try:
        plans.discriminative_update(spark, "/root/testdata/sf0.001")
    finally:
        plans.cut = cut
    assert len(kept) == 1 and kept[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert gathered(vecs, "utt").rdd.getNumPartitions() >= 4
