"""Grapheme to phoneme against the enumeration of alignments, and on words that training did not see."""

import itertools
import math
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cadenza.operators import pronounce


def alignments(letters, phones):
    if not letters and not phones:
        yield []
    for a in (1, 2):
        for b in (0, 1, 2):
            if a <= len(letters) and b <= len(phones) and (a == 1 or b == 1) and not (a == 2 and b == 0):
                for rest in alignments(letters[a:], phones[b:]):
                    yield [("+".join(letters[:a]), "+".join(phones[:b]) or "_"), *rest]


def test_expectations_against_all_alignments(spark):
    rng = np.random.default_rng(0)
    words = [("abc", "xy"), ("a", "xyz"), ("aab", "xxy"), ("abca", "x"), ("", ""), ("ab", ""), ("ba", "xx")]
    frame = spark.createDataFrame([(list(a), list(b)) for a, b in words * 2], "letters array<string>, phones array<string>")
    sizes = {(1, 1): 0.5, (1, 0): 0.2, (2, 1): 0.2, (1, 2): 0.1}
    drawn = {}

    def given(x, y):
        return drawn.setdefault((x, y), float(rng.random()))

    for letters, phones in words:
        for way in alignments(letters, phones):
            for unit in way:
                given(*unit)
    size = lambda x, y: sizes[x.count("+") + 1, 0 if y == "_" else y.count("+") + 1]
    for chance, args in ((lambda x, y: 1.0, (None, None)), (size, (None, sizes)), (given, (drawn, None))):
        want, lost = {}, 0
        for letters, phones in words * 2:
            ways = [(math.prod(chance(*u) for u in way), way) for way in alignments(letters, phones)]
            total = sum(p for p, _ in ways)
            lost += not total > 0
            for p, way in ways:
                for unit in way:
                    want[unit] = want.get(unit, 0.0) + p / total
        got = {(r["letters"], r["phones"]): r["n"] for r in pronounce.expectation(frame, *args).collect()}
        assert got.pop((None, None), 0) == lost > 0
        assert got == pytest.approx(want)
    best = {r["k"]: r["units"] for r in pronounce.aligned(spark.createDataFrame([(n, list(a), list(b)) for n, (a, b) in enumerate(words)], "k int, letters array<string>, phones array<string>"), "k", drawn).collect()}
    for n, (letters, phones) in enumerate(words):
        ways = [(math.prod(given(*u) for u in way), way) for way in alignments(letters, phones) if way]
        assert (best[n] is None) == (not ways)
        if ways:
            assert [(u["letters"], u["phones"]) for u in best[n]] == max(ways)[1]


def test_joint_model_and_decoding(spark):
    rows = [(n, [tuple(u.split("}")) for u in line.split()]) for n, line in enumerate(["a}x b}y", "a}x b}y", "a}z b}_", "a+b}w", "b}y a}x"])]
    units = spark.createDataFrame([*rows, (9, None)], "k int, units array<struct<letters:string,phones:string>>")
    counts = pronounce.joint_counts(units, 2)
    got = {tuple(r["gram"]): r["n"] for r in counts.collect()}
    assert got["a}x",] == 3 and got["</s>",] == 5 and got["a}x", "b}y"] == 2 and got["<s>", "a}x"] == 2 and ("<s>",) not in got
    model = pronounce.joint_model(counts, 2)
    grams = {(g, u) for g in [("<s>",), ("a}x",), ("b}y",)] for u in ["a}x", "a}z", "a+b}w", "b}y", "b}_", "</s>"]}
    for history in {g for g, _ in grams}:
        assert sum(model.chance(history, u) for g, u in grams if g == history) == pytest.approx(1 - model.chance(history, "?"), abs=0.2)
        assert model.chance(history, "?") > 0

    def by_hand(letters):
        ways = []
        for way in alignments(letters, "xyzw"[:0] or ""):
            ways.append(way)
        cuts = [[letters[a:b] for a, b in itertools.pairwise([0, *c, len(letters)])] for r in range(len(letters)) for c in itertools.combinations(range(1, len(letters)), r)]
        best = None
        for cut in cuts:
            for choice in itertools.product(*[model.units.get("+".join(p), []) for p in cut]):
                h, score = ("<s>",), 0.0
                for u in (*choice, "</s>"):
                    score += math.log(model.chance(h, u))
                    h = (u,)
                if best is None or (-score, choice) < best:
                    best = (-score, choice)
        return None if best is None else [p for u in best[1] for p in u.split("}")[1].split("+") if p != "_"]

    words = ["ab", "ba", "a", "abab", "bb", "c", "ac", ""]
    frame = spark.createDataFrame([(w, list(w)) for w in words], "word string, letters array<string>")
    said = {r["word"]: r["phones"] for r in pronounce.pronounced(frame, "word", model, 50).collect()}
    for w in words:
        assert said[w] == (by_hand(w) if w else None), w


def test_unseen_words_are_pronounced(spark):
    rng = np.random.default_rng(5)
    syllables = ["tha", "cho", "ri", "mu", "the", "la", "chi", "no", "xe", "ba"]
    words = sorted({"".join(rng.choice(syllables, size=rng.integers(1, 4))) for _ in range(260)})
    say = lambda w: list(w.replace("th", "T").replace("ch", "C").replace("x", "ks"))
    seen, held = words[::4] + words[1::4] + words[2::4], words[3::4]
    make = lambda ws: spark.createDataFrame([(w, list(w), say(w)) for w in ws], "word string, letters array<string>, phones array<string>")
    chance = pronounce.train(make(seen), 5)
    assert sum(chance.values()) == pytest.approx(1.0) and chance["t+h", "T"] > chance.get(("t", "T"), 0.0)
    model = pronounce.joint_model(pronounce.joint_counts(pronounce.aligned(make(seen), "word", chance), 3), 3)
    got = {r["word"]: r["phones"] for r in pronounce.pronounced(make(held), "word", model).collect()}
    errors = sum(got[w] != say(w) for w in held)
    print(f"words with an error: {errors} of {len(held)}")
    assert errors <= 0.05 * len(held)


def test_many_words_at_once_give_what_each_gives(spark, monkeypatch):
    rng = np.random.default_rng(7)
    draw = lambda names, most: list(rng.choice(names, size=rng.integers(0, most)))
    rows = [(draw(["a", "b", "é", "ch"], 7), draw(["x", "yy", "z"], 7)) for _ in range(400)]
    chance = {}
    for letters, phones in rows:
        for i in range(len(letters)):
            for j in range(len(phones) + 1):
                for x, y, _, _ in pronounce._units(letters, phones, i, j, (2, 2)):
                    chance.setdefault((x, y), float(rng.choice([0.0, 0.25, 0.5, 0.75])))
    letters, phones = (pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1))
    given = lambda x, y: chance.get((x, y), 0.0)
    each = [pronounce.word_counts(letters[n : n + 1], phones[n : n + 1], given) for n in range(len(rows))]
    want = {}
    for _, counts in each:
        for u, c in counts.items():
            want[u] = want.get(u, 0.0) + c
    paths = [pronounce.best_alignments(letters[n : n + 1], phones[n : n + 1], chance)[0] for n in range(len(rows))]
    for arcs in (1, 5000, 1 << 21):
        monkeypatch.setattr(pronounce, "ARCS", arcs)
        likely, counts = pronounce.word_counts(letters, phones, given)
        assert likely == pytest.approx(np.concatenate([x[0] for x in each]), rel=1e-12) and counts == pytest.approx(want)
        assert pronounce.best_alignments(letters, phones, chance) == paths
    calls = []
    pronounce.word_counts(letters, phones, lambda x, y: calls.append((x, y)) or given(x, y))
    assert len(calls) == len(set(calls))  # a unit's chance is asked once for all words, not once a place


def test_words_of_any_length(spark, tmp_path):
    from cadenza.plans import pronounce as plans

    words = ["incomprehensibility", "thxchurchoverthrownness", "cat", "abcdefghijklm", "e" * 40 + "xthe", *("ba" * n + "the" for n in range(1, 40))]
    spark.createDataFrame([(n, w) for n, w in enumerate(words)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    entries = {r["word"]: r for r in plans._entries(spark, str(tmp_path)).collect()}
    assert set(entries) == set(words)
    got = {(r["letters"], r["phones"]): r["n"] for r in plans.unit_expectations(spark, str(tmp_path)).collect()}
    assert sum((x.count("+") + 1) * n for (x, _), n in got.items()) == pytest.approx(sum(map(len, words)), abs=0.1)
    sql = duckdb.sql(plans.SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert {(x, y) for x, y, n in sql if n} == {k for k, n in got.items() if n}
    assert {(x, y): n for x, y, n in sql if n} == pytest.approx({k: n for k, n in got.items() if n}, abs=2e-4)
    held = {w for w in words if zlib.crc32(w.encode()) % 5 == 0}
    assert any(len(w) > 12 for w in held) and {r["word"] for r in plans.pronunciations(spark, str(tmp_path)).collect()} == held


def test_a_very_long_word_is_worked_on_by_rows(monkeypatch):
    rng = np.random.default_rng(11)
    word, said = list(rng.choice(list("abcd"), size=900)), list(rng.choice(list("xyz"), size=700))
    letters, phones = (pa.array([w, w[:5]], pa.list_(pa.string())) for w in (word, said))
    for chance in (lambda x, y: 1.0, lambda x, y: 1e-3 * (1 + len(x) + len(y))):  # totals beyond what a double holds, on either side
        want = None
        for arcs in (1, 1 << 21, 1 << 24):  # all by rows, the long one by rows, none before its total fails
            monkeypatch.setattr(pronounce, "ARCS", arcs)
            likely, counts = pronounce.word_counts(letters, phones, chance)
            assert np.isfinite(likely).all() and abs(likely[0]) > 745
            assert sum((x.count("+") + 1) * n for (x, _), n in counts.items()) == pytest.approx(905)
            assert sum((0 if y == "_" else y.count("+") + 1) * n for (_, y), n in counts.items()) == pytest.approx(705)
            want = want or counts
            assert counts == pytest.approx(want, rel=1e-9)
    names = {(x, y): 0.5 ** (len(x) + len(y)) for x in ["a", "b", "c", "d", *(f"{p}+{q}" for p in "abcd" for q in "abcd")] for y in ["_", "x", "y", "z", *(f"{p}+{q}" for p in "xyz" for q in "xyz")]}
    paths = []
    for arcs in (1, 1 << 24):
        monkeypatch.setattr(pronounce, "ARCS", arcs)
        paths.append(pronounce.best_alignments(letters, phones, names))
    assert paths[0] == paths[1] and "".join(u["letters"].replace("+", "") for u in paths[0][0]) == "".join(word)
    model = pronounce.JointModel([((u,), 1) for u in ("a}x", "b}y", "a+b}z", "</s>")] + [(("<s>", "a}x"), 1)], 3)
    tracemalloc.start()
    assert len(model.decode(list("ab" * 3000), 10)) >= 3000
    assert tracemalloc.get_traced_memory()[1] < 50 << 20  # paths share what they have in common
    tracemalloc.stop()
