"""Measures, layouts, parameter files, text conversions and checks on small cases."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from cadenza.functions import measures, text
from cadenza.operators import corpus, gaussians, sequences, trees, validation
from cadenza.sources import parameters
from pyspark.sql import functions as F


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def array(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vector_arithmetic(spark):
    a, b = array(1, 2, 3), array(4, 0, -1)
    got = one(spark, measures.add(a, b), measures.subtract(a, b), measures.scale(a, 2.0), measures.dot(a, b), measures.mean(a), measures.largest(b), measures.smallest(b))
    assert got == ([5, 2, 2], [-3, 2, 4], [2, 4, 6], 1, 2, 0, 2)
    assert one(spark, measures.cross(array(1, 2), array(3, 4))) == ([[3, 4], [6, 8]],)
    assert one(spark, measures.largest(F.array().cast("array<double>")), measures.mean(F.array().cast("array<double>"))) == (None, None)


def test_divergences_and_losses(spark):
    p, q = np.array([0.5, 0.25, 0.25, 0]), np.array([0.25, 0.25, 0.25, 0.25])
    want = float(np.sum(p[:3] * np.log2(p[:3] / q[:3])))
    got = one(spark, measures.directed_divergence(array(*p), array(*q)), measures.cross_entropy(array(*p), array(*q)), measures.gaussian_entropy(array(1, 4)))
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(-float(np.sum(p * np.log(q))))
    assert got[2] == pytest.approx(-(0.5 * np.log(4) + 2 * (0.5 * np.log(2 * np.pi) + 0.5)) / np.log(2))
    same = measures.gaussian_merge_loss(F.lit(3.0), array(1, 2), array(1, 1), F.lit(5.0), array(1, 2), array(1, 1))
    far = measures.gaussian_merge_loss(F.lit(1.0), array(-1), array(1), F.lit(1.0), array(1), array(1))
    assert one(spark, same, far) == (pytest.approx(0), pytest.approx(np.log(2)))
    counts = measures.count_merge_loss(array(2, 0), array(0, 2))
    assert one(spark, counts, measures.count_merge_loss(array(1, 1), array(2, 2)))[0] == pytest.approx(4 * np.log(4) - 4 * np.log(2))


def test_warps_turn_back(spark):
    x = F.lit(5000.0)
    bent = measures.piecewise_warp(x, 1.1, 3000.0, 8000.0)
    got = one(spark, measures.inverse_piecewise_warp(bent, 1.1, 3000.0, 8000.0), measures.inverse_affine_warp(measures.affine_warp(x, 1.2, 9.0), 1.2, 9.0), measures.linear_warp(measures.inverse_linear_warp(x, 1.3), 1.3))
    assert got == tuple(pytest.approx(5000.0) for _ in range(3))
    assert one(spark, measures.piecewise_warp(F.lit(8000.0), 1.1, 3000.0, 8000.0))[0] == pytest.approx(8000.0)


def test_parameter_files(spark, tmp_path):
    rows = [("m", i, j, k, [float(10 * i + j + k + d) for d in range(2 + j)]) for i in range(3) for j in range(2) for k in range(2)]
    model = spark.createDataFrame(rows, "name string, cb int, stream int, density int, vec array<double>")
    content = parameters.gaussian_files(model, "name").first()["content"]
    (tmp_path / "means").write_bytes(bytes(content))
    back = {(r["cb"], r["stream"], r["density"]): r["vec"] for r in parameters.gaussians(spark, str(tmp_path), "means").collect()}
    assert back == {tuple(r[1:4]): r[4] for r in rows}
    x = np.arange(24, dtype=float).reshape(2, 3, 4)
    (tmp_path / "weights").write_bytes(parameters.encode_matrices(x))
    assert {(r["i"], r["j"]): r["vec"] for r in parameters.matrices(spark, str(tmp_path), "weights").collect()} == {(i, j): x[i, j].tolist() for i in range(2) for j in range(3)}
    (tmp_path / "lambda").write_bytes(parameters.encode_matrices(x.ravel()))
    assert parameters.values(spark, str(tmp_path), "lambda").first()["vec"] == x.ravel().tolist()
    swapped = b"s3\nversion 1.0\nendhdr\n" + np.array([0x11223344, 1, 1, 2, 2], ">u4").tobytes() + np.array([1.5, 2.5], ">f4").tobytes()
    assert parameters.decode_arrays(swapped, 3).tolist() == [[[1.5, 2.5]]]
    for bad in (b"xx", b"s3\nendhdr\n" + bytes(8), parameters.encode_matrices(x)[:-4]):
        with pytest.raises(ValueError):
            parameters.decode_arrays(bad, 3)
    lines = parameters.printed_gaussians(model.filter("cb = 0 AND stream = 0 AND density = 1"), 3).first()["line"]
    assert lines == "density    1 1.00e+00 2.00e+00 "
    assert one(spark, parameters.printed(array(1, 3), 2, normalise=True)) == ("2.5e-01 7.5e-01 ",)


def test_line_conversions(spark):
    cases = [
        (" u1 \t two\twords ", "tsv", "<s> two\twords </s> (u1)"), ("no tab", "tsv", None), ("# u\tx", "tsv", None),
        ("u2,one, two", "csv", "<s> one, two </s> (u2)"), ('u3,"say ""hi"", now"', "csv", '<s> say "hi", now </s> (u3)'), (",x", "csv", None), ("u,", "csv", None),
        ('u3,"a",b', "csv", "<s> a,b </s> (u3)"), ('u5,"x, y",z,w', "csv", "<s> x, y,z,w </s> (u5)"), ('"u,6","a"b"c",', "csv", '<s> ab"c", </s> (u,6)'), ('u7,,"open, to the end', "csv", "<s> ,open, to the end </s> (u7)"),
        ("<s> a </s> (u4)", "sphinx", "<s> a </s> (u4)"), ("a (u4)", "sphinx", None),
    ]
    rows = spark.createDataFrame(cases, "l string, k string, want string").select("want", text.to_sphinx(F.col("l"), F.col("k")).alias("got")).collect()
    assert [r["got"] for r in rows] == [c[2] for c in cases]
    norm = [("<s> Hello, WORLD! </s> (u 1)", "<s> hello world </s> (u 1)", True), ("# <s> A </s> (u)", "# <s> A </s> (u)", False), ("  Plain ", "Plain", False)]
    rows = spark.createDataFrame(norm, "l string, a string, b boolean").select(text.normalise_line(F.col("l")).alias("n")).collect()
    assert [(r["n"]["line"], r["n"]["changed"]) for r in rows] == [c[1:] for c in norm]
    lenient = [("<s> a b </s> (u1)", ("u1", "<s> a b </s>")), ("a (b) c ( u2 ) x", ("u2", "a (b) c")), ("(u3)", None), ("none", None), ("", None)]
    rows = spark.createDataFrame([(k,) for k, _ in lenient], "l string").select(text.decoder_utterance(F.col("l")).alias("u")).collect()
    assert [r["u"] and tuple(r["u"]) for r in rows] == [v for _, v in lenient]
    assert one(spark, text.prompt_text(F.lit("'Tis John's,  dogs' (x_1)!"))) == ("TIS JOHN'S DOGS X_1",)


def test_checks(spark):
    lexicon = spark.createDataFrame([("read", ["R", "X"]), ("read(2)", ["R", "Y"])], "word string, phones array<string>")
    phones = spark.createDataFrame([("R",), ("Y",)], "phone string")
    assert [tuple(r) for r in validation.unknown_phones(lexicon, phones).collect()] == [("X", 1)]
    texts = spark.createDataFrame([("u", " read(2) read(3) (4) read() "), ("v", None)], "utt string, text string")
    assert [tuple(r) for r in validation.unknown_variants(texts, lexicon, "utt", "text").collect()] == [("u", "read(3)")]
    frames = spark.createDataFrame([(1, [0.0] * 13), (2, [0.0] * 12), (3, None)], "n int, vec array<double>")
    assert sorted(r["n"] for r in validation.wrong_width(frames, "vec").collect()) == [2, 3]
    files = spark.createDataFrame([(16000, 1), (16000, 1), (8000, 1), (16000, 2)], "rate int, channels int")
    assert {(r["rate"], r["channels"]): (r["n"], r["problem"]) for r in validation.audio_properties(files).collect()} == {
        (16000, 1): (2, "several rates"), (8000, 1): (1, "several rates"), (16000, 2): (1, "not mono")}
    with pytest.raises(Exception, match="no codebook"):
        validation.senone_codebooks(spark.createDataFrame([(9,)], "senone int"), spark.createDataFrame([(1, 1)], "senone int, cb int")).collect()
    mapping = spark.createDataFrame([(1, "A", "x y"), (2, "B", "y"), (3, "C", "")], "pos int, source string, target string")
    assert {tuple(r) for r in corpus.reversed_map(mapping).collect()} == {("x", "A"), ("y", "B")}


def test_layout_of_edges(spark):
    frames = spark.createDataFrame([("u", n, [float(n * n + d) for d in range(13)]) for n in range(6)], "utt string, frame int, vec array<double>")
    got = {r["frame"]: r["feat"] for r in sequences.single_stream(frames, "utt", "vec").collect()}
    at = lambda n, d: float(min(max(n, 0), 5) ** 2 + d)
    for n in range(6):
        second = [(at(n + 3, d) - at(n - 1, d)) - (at(n + 1, d) - at(n - 3, d)) for d in range(13)]
        short = [at(n + 2, d) - at(n - 2, d) for d in range(13)]
        assert got[n] == [at(n, d) for d in range(1, 13)] + short[1:] + [at(n, 0), short[0], second[0]] + second[1:]


def test_full_covariance_density(spark):
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    model = spark.createDataFrame([("a", [1.0, 2.0], cov.tolist()), ("flat", [0.0, 0.0], [[1.0, 1.0], [1.0, 1.0]])], "label string, mean array<double>, cov array<array<double>>")
    got = {(r["id"], r["label"]): r["ll"] for r in gaussians.log_density_full(spark.createDataFrame([(1, [0.5, 0.0])], "id int, vec array<float>"), model, "label", "vec").collect()}
    d = np.array([-0.5, -2.0])
    assert got[1, "a"] == pytest.approx(-0.5 * (d @ np.linalg.inv(cov) @ d + np.log(np.linalg.det(cov)) + 2 * np.log(2 * np.pi)))
    assert got[1, "flat"] == -np.inf


def test_components_are_matched(spark):
    rng = np.random.default_rng(2)
    means = rng.normal(size=(5, 3))
    order = rng.permutation(5)
    schema = "s string, component int, dim int, mean double, var double"
    make = lambda rows: spark.createDataFrame([("s", i, d, float(rows[i][d]), 1.0) for i in range(len(rows)) for d in range(3)], schema)
    got = {(r["a"], r["b"]) for r in gaussians.matched_components(make(means), make(means[order] + 0.01), "s").collect()}
    assert got == {(int(order[n]), n) for n in range(5)}
    fewer = {(r["a"], r["b"]) for r in gaussians.matched_components(make(means), make(means[order[:2]]), "s").collect()}
    assert fewer == {(int(order[n]), n) for n in range(2)}


def test_assignment_against_all_permutations(spark):
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 5), (4, 4), (5, 6), (6, 6)] * 4:
        cost = rng.integers(0, 6, size=(n, m)).astype(float) if n % 2 else rng.random((n, m))
        got = gaussians.assignment(cost)
        assert len(set(got.tolist())) == n
        best = min(sum(cost[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert cost[np.arange(n), got].sum() == pytest.approx(best)
    many = rng.random((40, 40))
    assert many[np.arange(40), gaussians.assignment(many)].sum() < np.trace(many)
    schema = "s string, component int, dim int, mean double, var double"
    make = lambda order: spark.createDataFrame([("s", i, 0, float(x), 0.0) for i, x in enumerate(order)], schema)
    matched = gaussians.matched_components(make(range(20)), make(reversed(range(20))), "s")  # more than 16, no variance
    assert {(r["a"], r["b"]) for r in matched.collect()} == {(n, 19 - n) for n in range(20)}
    assert tuple(gaussians.matched_summary(matched, "s").first())[1:] == (0.0, 0.0, 0.0, 20)


def test_monte_carlo_divergence(spark):
    schema = "component int, weight double, mean array<double>, var array<double>"
    a = spark.createDataFrame([(0, 1.0, [0.0, 0.0], [1.0, 1.0])], schema)
    b = spark.createDataFrame([(0, 1.0, [1.0, 0.0], [1.0, 1.0])], schema)
    assert gaussians.monte_carlo_kl(a, b, 4000).first()["kl"] == pytest.approx(0.5, abs=0.08)
    two = spark.createDataFrame([(0, 0.25, [0.0, 0.0], [1.0, 1.0]), (1, 0.75, [3.0, 0.0], [1.0, 2.0])], schema)
    assert gaussians.monte_carlo_kl(two, two, 500).first()["kl"] == 0.0
    # A density of weight 0 takes no part; a variance of 0 counts as the floor in the logarithm.
    zero = spark.createDataFrame([(0, 1.0, [0.0, 0.0], [1.0, 1.0]), (1, 0.0, [9.0, 9.0], [0.0, 1.0])], schema)
    assert gaussians.monte_carlo_kl(zero, a, 2000).first()["kl"] == 0.0
    point = spark.createDataFrame([(0, 1.0, [2.0, 0.0], [0.0, 0.0])], schema)
    exact = -np.log(2 * np.pi * 1e-6) - (-np.log(2 * np.pi) - 2.0)
    assert gaussians.monte_carlo_kl(point, a, 100).first()["kl"] == pytest.approx(exact)


def test_compound_questions(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "l string, r string")
    ask = trees.compound([[("l", ["a"], False), ("r", ["x"], False)], [("l", ["b"], False), ("r", ["x"], True)], [("r", ["z"], False)]])
    assert [r["q"] for r in rows.select(ask.alias("q")).collect()] == [True, True, False]
    assert [r["q"] for r in rows.select(trees.compound([]).alias("q"), trees.compound([[]]).alias("w")).collect()] == [False] * 3


def test_contexts_within_a_row(spark, capsys):
    from cadenza.operators import sequences
    from cadenza.plans import texts

    rows = spark.createDataFrame([([["a", "b"], ["SIL"], ["c"], [], ["d", "e", "f"]],), ([],), (None,)], "w array<array<string>>")
    got = [[tuple(c) for c in r["c"]] for r in rows.select(sequences.contexts_of(F.col("w")).alias("c")).collect() if r["c"]]
    assert got == [[("SIL", "a", "b", "b"), ("a", "b", "SIL", "e"), ("SIL", "c", "d", "s"), ("c", "d", "e", "b"), ("d", "e", "f", "i"), ("e", "f", "SIL", "e")]]
    texts.word_position_contexts(spark, "/root/testdata/sf0.001").explain()
    assert "Window" not in capsys.readouterr().out


def test_contexts_are_counted_without_a_row_a_letter(spark, monkeypatch):
    from cadenza.operators import sequences
    from cadenza.plans import texts

    rng = np.random.default_rng(4)
    lines = ["", " \n\t", None, "a", " a", "ab\x0bc \x0cd", "é\u3000x \x1fy 𝒳𝒳 \x85z", "aa  aa\raa"] + ["".join(rng.choice(list("abé𝒳 \n"), size=n)) for n in rng.integers(0, 60, size=200)]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string").repartition(3)
    letters = F.transform(text.words(F.col("line")), lambda w: F.filter(F.split(w, ""), lambda c: c != ""))
    want = {tuple(r["c"]): r["n"] for r in rows.select(F.explode(sequences.contexts_of(letters)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    for portion in (1 << 20, 50, 1):
        monkeypatch.setattr(sequences, "PORTION", portion)
        got = sequences.context_counts(rows, "line").collect()
        assert {tuple(r)[:4]: r["n"] for r in got} == want and len(got) == len(want)
    column = pa.array([x for x in lines if x is not None], pa.string())
    dense = sequences._context_counts(column)
    monkeypatch.setattr(sequences, "COUNTERS", 1)  # the same by sorting
    assert all(np.array_equal(x, y) for x, y in zip(dense, sequences._context_counts(column), strict=True))
    assert dense[4].sum() == sum(want.values()) and len(dense[4]) == len(want)
    plan = texts.word_position_contexts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Generate" not in plan  # no row for each letter


def test_ngrams_read_each_text_once(spark):
    lines = ["a b c a b", "a  b", "c", "", " ", None, "a b c", "é x y\nz"] * 3
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(line):
        read.add(1)
        return line

    texts = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    for orders in ((1, 2, 3), (2,), (4, 1), (3, 2)):
        want = {}
        for line in lines:
            w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", line or "") if x]
            for o in orders:
                for i in range(len(w) - o + 1):
                    gram = (" ".join(w[i : i + o]), o)
                    want[gram] = want.get(gram, 0) + 1
        before = read.value
        got = corpus.ngrams(texts.withColumn("text", seen("line")), "id", "text", *orders).collect()
        assert {(r["gram"], r["gram_order"]): r["n"] for r in got} == want and len(got) == len(want)
        assert read.value - before == len(lines)


def test_gaps_are_filled_in_one_pass(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x

    rows = [(1, 0.0, 1.0, "a"), (1, 3.0, 4.0, "b"), (1, 4.0, 4.5, None), (None, 2.0, 3.0, "c"), (2, 5.0, 6.0, "d"), (3, 0.0, 7.0, "e")]
    frame = spark.createDataFrame(rows, "k int, b double, e double, name string")
    got = sequences.fill_gaps(frame.withColumn("b", seen("b")), "k", "b", "e", "name", F.lit(6.0)).collect()
    empty = [(1, 1.0, 3.0, ""), (1, 4.5, 6.0, ""), (None, 0.0, 2.0, ""), (None, 3.0, 6.0, ""), (2, 0.0, 5.0, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows + empty))
    assert read.value == len(rows)
