"""Training and alignment from transcripts against the enumeration of all paths."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import training

LEXICON = {"ab": [["A", "B"], ["A"]], "b": [["B"]], "c": [["C"], ["B", "C"]]}


def model(seed=0):
    rng = np.random.default_rng(seed)
    move = np.zeros((2, 2, 3))
    move[0] = [[0.5, 0.3, 0.2], [0.0, 0.6, 0.4]]  # the second state may be skipped
    move[1] = [[0.7, 0.3, 0.0], [0.0, 0.5, 0.5]]
    weight = rng.random((6, 2)) + 0.2
    return {
        "states": {"SIL": [0, 1], "A": [2, 3], "B": [3, 4], "C": [5, 0]},  # tied across phones
        "tmat": {"SIL": 0, "A": 1, "B": 0, "C": 0},
        "move": move, "weight": weight / weight.sum(axis=1, keepdims=True),
        "mean": rng.normal(size=(6, 2, 2)), "var": rng.random((6, 2, 2)) + 0.4,
    }


def pronunciations(words, between):
    """All strings of phones (word, phone) of an utterance, with the chance of the ways taken."""
    out = [([(-1, "SIL")], 1.0)]
    for at, word in enumerate(words):
        grown = []
        last = at == len(words) - 1
        for said, chance in out:
            for variant in LEXICON[word]:
                # A silence between words is one more way on from where it starts, but offers the same ways on itself.
                ways = len(LEXICON[word]) + (between and at > 0 and said[-1][0] >= 0)
                own = said + [(at, p) for p in variant]
                grown.append((own, chance / ways))
                if between and at > 0 and said[-1][0] >= 0:
                    grown.append((said + [(-1, "SIL")] + [(at, p) for p in variant], chance / ways / len(LEXICON[word])))
        out = grown
        if last:
            out = [(said, chance / 2) for said, chance in out] + [(said + [(-1, "SIL")], chance / 2) for said, chance in out]
    return out


def every_path(words, x, m, between=False):
    """(weight, states as (place, phone, state), moves) of all paths over the frames x."""
    def log_density(senone, v):
        each = [math.log(m["weight"][senone, d]) - 0.5 * sum(math.log(2 * math.pi * s) + (a - b) ** 2 / s for a, b, s in zip(v, m["mean"][senone, d], m["var"][senone, d], strict=True)) for d in range(2)]
        return math.log(sum(map(math.exp, each)))

    paths = []
    for said, chance in pronunciations(words, between):
        def go(t, place, state, weight, seen, moves, said=said):
            phone = said[place][1]
            weight = weight * math.exp(log_density(m["states"][phone][state], x[t]))
            seen = [*seen, (place, phone, state)]
            tmat = m["tmat"][phone]
            move = m["move"][tmat]
            leave = move[state, 2]
            if t == len(x) - 1:
                if place == len(said) - 1 and leave > 0:
                    paths.append((weight * leave, seen, [*moves, (tmat, state, 2)], said))
                return
            for to in range(2):
                if move[state, to] > 0:
                    go(t + 1, place, to, weight * move[state, to], seen, [*moves, (tmat, state, to)])
            if leave > 0 and place + 1 < len(said):
                go(t + 1, place + 1, 0, weight * leave, seen, [*moves, (tmat, state, 2)])

        go(0, 0, 0, chance, [], [])
    return paths


def said_rows(spark, cases):
    transcripts = spark.createDataFrame([(k, w) for k, (w, _) in cases.items()], "utt string, words array<string>")
    lexicon = spark.createDataFrame([(w, n, p) for w, v in LEXICON.items() for n, p in enumerate(v)] + [("b", 7, ["B"])], "word string, variant int, phones array<string>")
    frames = spark.createDataFrame([(k, n, [float(a) for a in v]) for k, (_, x) in cases.items() for n, v in enumerate(x)], "utt string, frame int, vec array<double>")
    return training.utterances(transcripts, lexicon, frames, "utt")


@pytest.mark.parametrize("between", [False, True])
def test_statistics_against_enumeration(spark, between):
    rng = np.random.default_rng(4)
    m = model()
    cases = {"u1": (["ab", "c"], rng.normal(size=(6, 2))), "u2": (["b"], rng.normal(size=(5, 2))), "u3": (["c", "b"], rng.normal(size=(6, 2)))}
    bad = {"short": (["ab", "c", "b", "c"], rng.normal(size=(2, 2))), "unknown": (["zz"], rng.normal(size=(5, 2))), "silent": (["b"], []), "wordless": ([], rng.normal(size=(3, 2)))}
    rows = training.expectation(said_rows(spark, cases | bad), m, between=between).collect()
    n, s, q, moves, ll = np.zeros((6, 2)), np.zeros((6, 2, 2)), np.zeros((6, 2, 2)), np.zeros((2, 2, 3)), 0.0
    for words, x in cases.values():
        paths = every_path(words, x, m, between)
        total = sum(w for w, *_ in paths)
        ll += math.log(total)
        for weight, seen, steps, _ in paths:
            for t, (_, phone, state) in enumerate(seen):
                senone = m["states"][phone][state]
                each = m["weight"][senone] * np.exp(-0.5 * (np.log(2 * np.pi * m["var"][senone]) + (x[t] - m["mean"][senone]) ** 2 / m["var"][senone]).sum(axis=1))
                part = weight / total * each / each.sum()
                n[senone] += part
                s[senone] += part[:, None] * x[t]
                q[senone] += part[:, None] * x[t] ** 2
            for step in steps:
                moves[step] += weight / total
    got_n, got_s, got_q, got_moves, totals = np.zeros_like(n), np.zeros_like(s), np.zeros_like(q), np.zeros_like(moves), np.zeros(5)
    for r in rows:
        if r["kind"] == "density":
            got_n[r["a"], r["b"]], got_s[r["a"], r["b"]], got_q[r["a"], r["b"]] = r["n"], r["sums"], r["squares"]
        elif r["kind"] == "move":
            got_moves[r["a"], r["b"], r["c"]] = r["n"]
        else:
            totals[r["a"]] = r["n"]
    assert np.allclose(got_n, n) and np.allclose(got_s, s) and np.allclose(got_q, q) and np.allclose(got_moves, moves)
    assert totals[0] == pytest.approx(ll) and totals[1:].tolist() == [17, 3, 1, 4]


def test_retry_and_skip(spark):
    # The first frames favour a path that cannot end: a narrow beam loses the others, the wide one keeps them.
    m = model() | {"move": np.array([[[0.5, 0.3, 0.2], [0.0, 0.6, 0.4]], [[0.7, 0.3, 0.0], [0.0, 0.5, 0.5]]])}
    rng = np.random.default_rng(1)
    cases = {f"u{n}": (["ab", "c"], rng.normal(size=(7, 2)) * 3) for n in range(30)}
    said = said_rows(spark, cases)
    of = lambda **how: {r["a"]: r["n"] for r in training.expectation(said, m, **how).filter("kind = 'total'").collect()}
    wide, narrow = of(beam=0.0), of(beam=0.9, wide=0.0)
    assert wide[2] == narrow[2] == 30 and 3 not in wide and 0 < narrow[3] <= 30
    lost = of(beam=0.9, wide=0.9)
    assert lost[4] == lost[3] > 0 and lost.get(2, 0) + lost[4] == 30
    # What a failed utterance did leaves no trace: the rest alone gives the same sums.
    assert wide[0] >= narrow[0] - 1e-9


def test_training_and_alignment(spark):
    m, rng = model(), np.random.default_rng(8)
    cases = {f"u{n}": (w, rng.normal(size=(6, 2))) for n, w in enumerate(itertools.product(LEXICON, repeat=2))}
    cases["u99"] = (["zz"], rng.normal(size=(6, 2)))
    said = said_rows(spark, {k: (list(w), x) for k, (w, x) in cases.items()})
    found = {}
    for r in training.align(said, "utt", m, between=True).orderBy("utt", "seq").collect():
        found.setdefault(r["utt"], []).append(r)
    assert found["u99"][0]["seq"] is None
    for k, (words, x) in cases.items():
        if k == "u99":
            continue
        paths = every_path(words, x, m, True)
        weight = max(p[0] for p in paths)
        assert found[k][0]["score"] == pytest.approx(math.log(weight))
        got = [(r["word"] if r["word"] is not None else -1, r["phone"], r["start_frame"], r["end_frame"]) for r in found[k]]
        want = []  # several paths may share the best weight
        for _, seen, _, said_ in (p for p in paths if p[0] > weight * (1 - 1e-9)):
            segments = []
            for place, group in itertools.groupby(enumerate(seen), key=lambda z: z[1][0]):
                at = [t for t, _ in group]
                segments.append((*said_[place], at[0], at[-1]))
            want.append(segments)
        assert got in want
    new, telemetry = training.train(said, m, 4, beam=0.0)
    gains = [t["total_ll"] for t in telemetry]
    assert all(b >= a - 1e-9 for a, b in zip(gains, gains[1:], strict=False)) and telemetry[0]["skipped"] == 1
    assert np.allclose(new["move"].sum(axis=2), 1) and np.allclose(new["weight"].sum(axis=1), 1)
    stopped = training.train(said, m, 5, threshold=1e9)[1]
    assert len(stopped) == 2
    assert said.filter(F.col("words").isNull()).count() == 1


def test_utterances_together_are_as_alone():
    """Forward-backward and best paths of many utterances of one graph, one of them without a path, against one at a time."""
    from cadenza.plans.training import _model

    m = _model()
    graph = training.Graph([[["f"], ["f", "x"]], [["3"]]], m)
    score = np.random.default_rng(3).normal(size=(5, 6, len(graph.senone))) * 3
    score[2] = -np.inf
    score[2, :, 0] = 0.0  # never leaves the first silence
    alive, ll, gamma, uses, last = training.forward_backward(graph, score, 1e-80)
    found, total, path = training.best_path(graph, score)
    assert alive.tolist() == found.tolist() == [True, True, False, True, True]
    for u in np.flatnonzero(alive):
        one = training.forward_backward(graph, score[u : u + 1], 1e-80)
        for a, b in zip((ll, gamma, uses, last), one[1:], strict=True):
            assert np.allclose(a[u], b[0], atol=1e-12)
        assert np.allclose(gamma[u].sum(axis=1), 1)
        _, alone, way = training.best_path(graph, score[u : u + 1])
        assert total[u] == alone[0] and path[u].tolist() == way[0].tolist()
