"""Codeword normalisation against plain loops, and with a planted tilt."""

import math

import numpy as np
import pytest

from cadenza.operators import normalisation
from cadenza.plans.normalisation import CODEBOOK


def plain(z, prob, mean, var):
    """The passes by loops over frames and codewords, with the transform by its definition."""
    n, codes, dim = len(z), len(mean), len(z[0])
    volume = [prob[k] / math.prod(math.sqrt(v) for v in var[k]) for k in range(codes)]

    def even(x):
        return [x[0] + (-1) ** k * x[32] + 2 * sum(x[j] * math.cos(math.pi * j * k / 32) for j in range(1, 32)) for k in range(33)]

    def correct(noise, tilt):
        out = []
        for k in range(codes):
            sign = -1 if k == 0 else 1
            aux = [sign * (noise[j] - tilt[j] - mean[k][j]) if j < dim else 0.0 for j in range(33)]
            out.append([v / 64 for v in even([math.log(math.exp(a) + 1) for a in even(aux)])[:dim]])
        return out

    def dist(x, y, v):
        return sum((a - b) ** 2 / c for a, b, c in zip(x, y, v, strict=True))

    tilt = [sum(f[j] for f in z) / n - sum(prob[k] * mean[k][j] for k in range(codes)) for j in range(dim)]
    low, high = min(f[0] for f in z), max(f[0] for f in z)
    quiet = [f for f in z if f[0] < low + (high - low) / 20]
    noise = [sum(f[j] for f in quiet) / len(quiet) for j in range(dim)]
    before, done = -10.0, 0
    while True:
        corr = correct(noise, tilt)
        new_n, new_t, den_n, den_t, ll = [0.0] * dim, [0.0] * dim, 0.0, 0.0, 0.0
        for f in z:
            q = [[f[j] - corr[0][j] for j in range(dim)]] + [[f[j] - mean[k][j] - corr[k][j] for j in range(dim)] for k in range(1, codes)]
            p = [math.exp(-dist(q[k], noise if k == 0 else tilt, var[k]) / 2) * volume[k] for k in range(codes)]
            total = sum(p)
            ll += math.log(total)
            den_n, den_t = den_n + p[0] / total, den_t + 1 - p[0] / total
            for j in range(dim):
                new_n[j] += q[0][j] * p[0] / total
                new_t[j] += sum(q[k][j] * p[k] for k in range(1, codes)) / total
        noise, tilt, ll = [v / den_n for v in new_n], [v / den_t for v in new_t], ll / n
        if not (ll > before and done < 7):
            break
        before, done = ll, done + 1
    corr, x = correct(noise, tilt), []
    for f in z:
        own = [[f[j] - tilt[j] - corr[k][j] for j in range(dim)] for k in range(codes)]
        p = [math.exp(-dist(own[k], mean[k], var[k]) / 2) * volume[k] for k in range(codes)]
        x.append([sum(own[k][j] * p[k] for k in range(1, codes)) / sum(p) for j in range(dim)])
    return noise, tilt, ll, x


def drawn(rng, n, tilt):
    k = rng.choice(4, size=n, p=CODEBOOK["prob"])
    x = CODEBOOK["mean"][k] + rng.normal(size=(n, 3)) * np.sqrt(CODEBOOK["var"][k])
    return k, x, x + np.where(k[:, None] == 0, 0.0, tilt)


def test_estimates_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    cases = {f"u{n}": drawn(rng, 40, rng.normal(size=3))[2] for n in range(3)}
    frame = spark.createDataFrame([(k, z.tolist()) for k, z in cases.items()] + [("none", []), ("null", None)], "utt string, frames array<array<double>>")
    got = {}
    for r in normalisation.codeword_normalised(frame, "utt", CODEBOOK).collect():
        got.setdefault(r["utt"], {})[r["frame"]] = r
    assert set(got) == set(cases)
    for k, z in cases.items():
        noise, tilt, ll, x = plain(z.tolist(), CODEBOOK["prob"], CODEBOOK["mean"], CODEBOOK["var"])
        assert np.allclose(got[k][0]["noise"], noise) and np.allclose(got[k][0]["tilt"], tilt) and got[k][0]["likelihood"] == pytest.approx(ll)
        assert np.allclose([got[k][n]["vec"] for n in range(len(z))], x)


def test_a_planted_tilt_is_recovered():
    rng = np.random.default_rng(1)
    tilt = np.array([0.8, -0.6, 0.5])
    book = CODEBOOK | {"mean": CODEBOOK["mean"] + np.array([[-20.0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]])}
    k = rng.choice(4, size=3000, p=book["prob"])
    x = book["mean"][k] + rng.normal(size=(3000, 3)) * np.sqrt(book["var"][k])
    z = x + np.where(k[:, None] == 0, 0.0, tilt)
    _, found, _, _ = normalisation.estimated(z, book["prob"], book["mean"], book["var"], 50)
    assert np.abs(found - tilt).max() < 0.15
    clean = normalisation.cleaned(z, book["mean"][0], found, book["prob"], book["mean"], book["var"])
    speech = k > 0
    assert np.abs(clean[speech] - x[speech]).mean() < 0.15 < np.abs(z[speech] - x[speech]).mean()


def test_codebook_files(spark, tmp_path):
    rows = [(k, float(CODEBOOK["prob"][k]), CODEBOOK["mean"][k].tolist(), CODEBOOK["var"][k].tolist()) for k in range(4)]
    model = spark.createDataFrame(rows, "code int, prob double, mean array<double>, var array<double>")
    lines = [r["line"] for r in normalisation.codebook_lines(model).orderBy("line_no").collect()]
    assert lines[0] == "4 3" and lines[1].startswith("0.100000 -4.00000 0.00000")
    (tmp_path / "book").write_text("\n".join(lines))
    back = normalisation.read_codebook(spark, str(tmp_path / "book"))
    assert all(np.allclose(back[c], CODEBOOK[c]) for c in CODEBOOK)
    (tmp_path / "bad").write_text("4 3 0.1")
    with pytest.raises(ValueError):
        normalisation.read_codebook(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        normalisation.codeword_normalised(model, "code", {c: v[:1] for c, v in CODEBOOK.items()})


def test_frames_are_handed_over_flat(spark, capsys):
    """A Python object a frame takes several times the memory of its numbers."""
    frames = spark.createDataFrame([(1, [[1.0, 0.5], [4.0, 0.0]]), (2, None)], "utt int, frames array<array<double>>")
    book = {"prob": [0.5, 0.5], "mean": [[0.0, 0.0], [3.0, 0.0]], "var": [[1.0, 1.0], [1.0, 1.0]]}
    out = normalisation.codeword_normalised(frames, "utt", book)
    assert out.count() == 2
    out.explain()
    assert "flatten(frames" in capsys.readouterr().out
