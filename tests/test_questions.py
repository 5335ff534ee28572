"""Question generation, leaf classes, compound questions and pruning against exhaustive search."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import questions


def gaussians(rng, phones):
    return {p: (float(rng.integers(5, 50)), rng.normal(size=3) * 2, rng.random(3) + 0.3) for p in phones}


def mass(stats, phones):
    n = sum(stats[p][0] for p in phones)
    mean = sum(stats[p][0] * stats[p][1] for p in phones) / n
    var = sum(stats[p][0] * (stats[p][2] + stats[p][1] ** 2) for p in phones) / n - mean**2
    return 0.5 * n * float(np.log(np.maximum(var, 1e-4)).sum())


def stats_frame(spark, states):
    rows = [(s, p, n, m.tolist(), v.tolist()) for s, stats in states.items() for p, (n, m, v) in stats.items()]
    return spark.createDataFrame(rows + [("s1", "unseen", 0.0, [0.0] * 3, [0.0] * 3)], "state string, phone string, n double, mean array<double>, var array<double>")


def plain_tree(stats, phones, node="r"):
    if len(phones) < 2:
        return [(node, sorted(phones), None)]
    best = max((mass(stats, phones) - mass(stats, left) - mass(stats, set(phones) - set(left)), left) for k in range(1, len(phones)) for left in itertools.combinations(sorted(phones)[:-1], k))
    right = [p for p in phones if p not in best[1]]
    return [(node, sorted(phones), best[0])] + plain_tree(stats, list(best[1]), node + "0") + plain_tree(stats, right, node + "1")


def test_trees_of_six_phones(spark):
    rng = np.random.default_rng(0)
    states = {s: gaussians(rng, "ABCDEF") for s in ("s1", "s2")}
    trees = questions.phone_trees(stats_frame(spark, states), "state", "phone")
    got = {(r["state"], tuple(r["phones"])): r["gain"] for r in trees.collect()}
    want = {(s, tuple(phones)): gain for s, stats in states.items() for _, phones, gain in plain_tree(stats, list("ABCDEF"))}
    assert got.keys() == want.keys()
    assert all(got[k] is None if g is None else got[k] == pytest.approx(g) for k, g in want.items())
    sets = questions.question_sets(trees, "state").collect()
    names = {tuple(r["phones"]) for r in sets}
    depth = {(s, tuple(p)): len(n) - 1 for s, stats in states.items() for n, p, _ in plain_tree(stats, list("ABCDEF"))}
    assert names == {p for (s, p), d in depth.items() if d and (len(p) > 1 or d <= 3)}
    assert [r["question"] for r in sorted(sets, key=lambda r: (len(r["phones"]), r["phones"]))] == [f"QUESTION{n}" for n in range(len(sets))]


def test_phones_are_merged_down_to_the_clusters(spark):
    rng = np.random.default_rng(1)
    stats = gaussians(rng, "ABCDEFGH")
    groups = [[p] for p in "ABCDEFGH"]
    while len(groups) > 3:
        loss = [(mass(stats, a + b) - mass(stats, a) - mass(stats, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)]
        _, i, j = min(loss)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    sides = [(mass(stats, list("ABCDEFGH")) - mass(stats, g) - mass(stats, [p for h in groups if h is not g for p in h]), g) for g in groups]
    gain, side = max(sides, key=lambda x: x[0])
    rows = {r["node"]: r for r in questions.phone_trees(stats_frame(spark, {"s1": stats}), "state", "phone", clusters=3).collect()}
    assert rows["r"]["gain"] == pytest.approx(gain)
    assert sorted(side) in (rows["r0"]["phones"], rows["r1"]["phones"])
    assert sum(len(r["phones"]) == 1 for r in rows.values()) == 8


def entropy(counts):
    total = sum(counts.values())
    return -sum(n * math.log2(n / total) for n in counts.values() if n)


def test_two_classes_against_all_subsets(spark):
    rng = np.random.default_rng(2)
    rows = [(t, leaf, s, o, int(rng.integers(1, 30))) for t in "xy" for leaf in range(5) for s in (0, 1) for o in "abc" if rng.random() < 0.8] + [("one", 3, 0, "a", 4)]
    frame = spark.createDataFrame(rows, "tree string, leaf int, state int, outcome string, n int")
    got = {r["tree"]: r for r in questions.two_classes(frame, "tree", "leaf", "state", "outcome", "n", {1: 2.0}).collect()}
    assert set(got) == {"x", "y"}

    def pooled(tree, state, leaves):
        out = {}
        for t, leaf, s, o, n in rows:
            if t == tree and s == state and leaf in leaves:
                out[o] = out.get(o, 0) + n
        return entropy(out) if out else 0.0

    for tree in "xy":
        gains = {}
        for k in range(1, 5):
            for some in itertools.combinations(range(4), k):
                rest = set(range(5)) - set(some)
                gains[some] = sum(w * (pooled(tree, s, range(5)) - pooled(tree, s, some) - pooled(tree, s, rest)) for s, w in ((0, 1.0), (1, 2.0)))
        best = max(gains, key=gains.get)
        assert got[tree]["leaves"] == list(best) and got[tree]["gain"] == pytest.approx(gains[best])
    many = spark.createDataFrame([("t", n, 0, "a", 1) for n in range(17)], frame.schema)
    with pytest.raises(Exception, match="more than 16 leaves"):
        questions.two_classes(many, "tree", "leaf", "state", "outcome", "n").collect()


def holds(terms, answers):
    return any(all(answers[q] != s for q, s in t) for t in terms)


def test_simplified_questions_mean_the_same():
    rng = np.random.default_rng(3)
    names = list("ABCD")
    for _ in range(200):
        terms = [questions.Term((names[k], bool(rng.integers(2))) for k in rng.integers(0, 4, size=rng.integers(1, 5))) for _ in range(rng.integers(0, 6))]
        short = questions.simplified(terms)
        for bits in itertools.product((False, True), repeat=4):
            answers = dict(zip(names, bits, strict=True))
            assert holds(terms, answers) == holds(short, answers)
        assert not any(a < b for a in short for b in short)
        assert sum(map(len, short)) <= sum(map(len, terms))
    t = questions.Term
    assert questions.simplified([t({("A", False), ("B", False)}), t({("A", False), ("B", True)})]) == [t({("A", False)})]


def test_questions_as_text(spark):
    nodes = [{"node": 0, "question": "V", "yes": 1, "no": 2}, {"node": 2, "question": "N", "yes": 3, "no": 4}]
    leaves = questions.leaf_terms(nodes)
    either = questions.simplified([leaves[1], leaves[4]])
    assert questions.written(either) == "(!N) | (V)"
    assert questions.parsed(questions.written(either)) == either
    assert questions.parsed(" A !B ") == [questions.Term({("A", False), ("B", True)})]
    for bad in ("", "(A", "A | B", "A & B", "(A) (B)", "()", "!"):
        with pytest.raises(ValueError):
            questions.parsed(bad)
    rows = spark.createDataFrame([("a", "n"), ("b", "m"), ("c", None)], "left string, right string")
    ask = questions.answered(either, {"V": ("left", ["a"]), "N": ("right", ["n", "m"])})
    assert [r[0] for r in rows.select(ask).collect()] == [True, False, True]


def test_pruning_against_a_heap(spark):
    rng = np.random.default_rng(4)
    trees = {}
    for tree in "abc":
        splits, open_ = {}, [0]
        while open_:
            n = open_.pop()
            splits[n] = float(rng.random())
            open_ += [c for c in (2 * n + 1, 2 * n + 2) if rng.random() < 0.55 and c < 500]
        trees[tree] = splits
    rows = [(t, n, g) for t, s in trees.items() for n, g in s.items()]
    frame = spark.createDataFrame(rows, "tree string, node long, gain double")
    for leaves in (1, 3, 4, 7, 12, len(rows) + 3, 1000):
        left = {t: dict(s) for t, s in trees.items()}
        twig = lambda t, n: 2 * n + 1 not in left[t] and 2 * n + 2 not in left[t]  # noqa: E731, B023
        heap = [(g, t, n) for t, n, g in rows if twig(t, n)]
        heapq.heapify(heap)
        while heap and sum(map(len, left.values())) + 3 > leaves:
            _, t, n = heapq.heappop(heap)
            del left[t][n]
            parent = (n - 1) // 2
            if n and twig(t, parent):
                heapq.heappush(heap, (left[t][parent], t, parent))
        kept = {(r["tree"], r["node"]) for r in questions.pruned(frame, "tree", leaves).filter(~F.col("removed")).collect()}
        assert kept == {(t, n) for t, s in left.items() for n in s}
    found = spark.createDataFrame([(7, [0, 1]), (7, [0]), (7, []), (6, [0, 2, 6]), (13, [0, 2])], "node long, splits array<long>")
    assert [r[0] for r in found.select(questions.leaf_of(F.col("node"), F.col("splits"))).collect()] == [3, 1, 0, None, 6]
