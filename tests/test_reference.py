"""Operators outside the corpus subpackage, against brute force and round trips."""

import itertools
import math
import struct

import numpy as np
import pytest
from cadenza.functions import signal, text
from cadenza.operators import corpus, evaluation, hmm, sequences, trees
from cadenza.plans import catalogue
from cadenza.sources import binary, sinks
from cadenza.sources import text as source
from cadenza.streaming import live
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_catalogue_is_complete():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 80


@pytest.mark.parametrize("name", ["alignment_chunks", "bootstrap_strata", "em_passes", "wer_breakdown", "wer_total"])
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_transcript_files(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("<s> hello world </s> (u1)\n\nu2 leading form\nlonely\nu1 again later\n")
    assert {tuple(r) for r in source.transcripts(spark, str(path)).collect()} == {("u1", "again later"), ("u2", "leading form")}
    ids = tmp_path / "ids"
    ids.write_text(" b \n\na\n")
    assert [tuple(r) for r in source.file_ids(spark, str(ids)).orderBy("pos").collect()] == [(0, "b"), (1, "a")]


def test_prompts_are_strict(spark, tmp_path):
    good, bad = tmp_path / "g.tsv", tmp_path / "b.tsv"
    good.write_text("a\tone two\nb\tthree\n")
    bad.write_text("a\tone\n../b\ttwo\n")
    assert [tuple(r) for r in source.prompts(spark, str(good)).orderBy("line_no").collect()] == [("a", "one two", 1), ("b", "three", 2)]
    with pytest.raises(Exception, match="bad prompt"):
        source.prompts(spark, str(bad)).collect()


def test_lexicon_files(spark, tmp_path):
    path = tmp_path / "d"
    path.write_text("# head\nread R EH D\nread(2) R IY D # c\n\n")
    rows = {(r["word"], r["base_word"], r["variant"], tuple(r["phones"])) for r in source.lexicon(spark, str(path)).collect()}
    assert rows == {("read", "read", 1, ("R", "EH", "D")), ("read(2)", "read", 2, ("R", "IY", "D"))}
    path.write_text("word\n")
    with pytest.raises(Exception, match="no pronunciation"):
        source.lexicon(spark, str(path)).collect()
    m = tmp_path / "m"
    m.write_text("AX -> AH\nX -> K S\nH ->\nbad line\n")
    assert {(r["src"], tuple(r["dst"])) for r in source.phone_map(spark, str(m)).collect()} == {("AX", ("AH",)), ("X", ("K", "S")), ("H", ())}
    j = tmp_path / "m.json"
    j.write_text('{"_c": "x", "AX": "AH"}')
    assert [(r["src"], r["dst"]) for r in source.phone_map_json(spark, str(j)).collect()] == [("AX", ["AH"])]


def test_lexicon_merge_numbers_variants(spark):
    make = lambda rows: spark.createDataFrame(rows, "base_word string, variant int, phones array<string>")
    got = corpus.merge_lexicons(make([("a", 1, ["X"]), ("a", 2, ["Y"])]), make([("a", 1, ["Y"]), ("a", 2, ["Z"]), ("b", 1, ["Q"])])).collect()
    assert {(r[0], r[1], tuple(r[2])) for r in got} == {("a", 1, ("X",)), ("a", 2, ("Y",)), ("a", 3, ("Z",)), ("b", 1, ("Q",))}


def test_string_functions(spark):
    df = spark.createDataFrame([("'Ello, WÖRLD! -- été.",)], "t string")
    assert df.select(text.normalise(F.col("t"))).first()[0] == "ello wörld été"
    row = spark.range(1).select(
        text.variant(F.lit("a(3)")), text.base_word(F.lit("a(3)")), text.strip_stress(F.lit("AH1")), text.stress(F.lit("AH1")), text.stress(F.lit("B")),
        text.primary_stress(F.array(F.lit("K"), F.lit("AH0"), F.lit("EY1"))), text.escape_textgrid(F.lit('a"b')), text.unsafe_id(F.lit("a/../b")),
    ).first()
    assert tuple(row) == (3, "a", "AH", 1, None, 1, '"a""b"', True)


def test_wav_and_feature_files(spark, tmp_path):
    x = np.array([0, 100, -100, 32767], dtype="<i2")
    stereo = np.repeat(x, 2).tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(stereo), b"WAVE", b"fmt ", 16, 1, 2, 16000, 64000, 4, 16, b"data", len(stereo))
    (tmp_path / "a.wav").write_bytes(head + stereo)
    row = binary.audio(spark, str(tmp_path)).first()
    assert (row["rate"], row["channels"], row["samples"]) == (16000, 2, x.tolist())
    frames = spark.createDataFrame([("u", n, [float(n + d) for d in range(13)]) for n in range(4)], "key string, frame int, vec array<double>")
    content = binary.encode_features(frames, "key").first()["content"]
    (tmp_path / "u.mfc").write_bytes(bytes(content))
    back = binary.features(spark, str(tmp_path), first=1, last=2).orderBy("frame").collect()
    assert [(r["frame"], r["vec"]) for r in back] == [(n, [float(n + d) for d in range(13)]) for n in (1, 2)]
    kinds = {r["path"].rsplit("/", 1)[1]: r["k"] for r in binary.files(spark, str(tmp_path)).select("path", binary.kind_of(F.col("content"), F.col("path")).alias("k")).collect()}
    assert kinds == {"a.wav": "wav", "u.mfc": "mfc"}


def test_front_end_functions(spark):
    x = [math.sin(0.7 * n) + 0.3 for n in range(16)]
    df = spark.createDataFrame([(x,)], "x array<double>")
    spectrum = df.select(signal.power_spectrum(F.col("x"), 16)).first()[0]
    assert np.allclose(spectrum, np.abs(np.fft.rfft(x)) ** 2)
    window = df.select(signal.hamming(F.col("x"))).first()[0]
    assert np.allclose(window, np.array(x) * np.hamming(16))
    c = df.select(signal.dct(F.col("x"), 16, 4)).first()[0]
    basis = [[math.sqrt((1 if k == 0 else 2) / 16) * math.cos(math.pi * k * (n + 0.5) / 16) for n in range(16)] for k in range(4)]
    assert np.allclose(c, np.array(basis) @ x)
    assert spark.range(1).select(signal.hertz(signal.mel(F.lit(440.0)))).first()[0] == pytest.approx(440)
    assert spark.range(1).select(signal.log_add(F.lit(-1000.0), F.lit(-1000.0))).first()[0] == pytest.approx(-1000 + math.log(2))
    bank = signal.filter_bank(16000, 16, 3, 100, 7000)
    assert np.allclose(df.select(signal.filtered(signal.power_spectrum(F.col("x"), 16), bank)).first()[0], np.array(bank) @ spectrum)


def brute_paths(emit, start, move):
    n, k = emit.shape
    out = {}
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * np.prod([move[a, b] for a, b in itertools.pairwise(path)]) * np.exp(sum(emit[t, s] for t, s in enumerate(path)))
        out[path] = p
    return out


def test_forward_backward_and_viterbi_match_enumeration():
    rng = np.random.default_rng(1)
    emit, start = rng.normal(size=(5, 3)), np.array([0.5, 0.3, 0.2])
    move = rng.random((3, 3))
    move /= move.sum(axis=1, keepdims=True)
    paths = brute_paths(emit, start, move)
    total = sum(paths.values())
    ll, gamma, moves = hmm.forward_backward(emit, start, move)
    assert ll == pytest.approx(math.log(total))
    want = np.zeros((5, 3))
    steps = np.zeros((3, 3))
    for path, p in paths.items():
        for t, s in enumerate(path):
            want[t, s] += p / total
        for a, b in itertools.pairwise(path):
            steps[a, b] += p / total
    assert np.allclose(gamma, want) and np.allclose(moves, steps)
    score, path = hmm.viterbi(emit, start, move)
    best = max(paths, key=paths.get)
    assert tuple(path) == best and score == pytest.approx(math.log(paths[best]))


def _frames(spark, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(12):
        for t in range(20):
            rows.append((f"u{u}", t, [float(rng.normal(3 * (t // 10), 0.5)), float(rng.normal())]))
    return spark.createDataFrame(rows, "utt string, frame int, vec array<double>")


MODEL = {"start": np.array([0.9, 0.1]), "move": np.array([[0.8, 0.2], [0.1, 0.9]]), "mean": np.array([[0.5, 0.0], [2.0, 0.0]]), "var": np.ones((2, 2))}


def test_training_raises_the_likelihood(spark):
    model, passes = hmm.train(_frames(spark), "utt", MODEL, 5)
    totals = [p["total_ll"] for p in passes]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(totals)) and passes[0]["frames"] == 240
    assert np.allclose(sorted(model["mean"][:, 0]), [0, 3], atol=0.3)
    path = hmm.best_paths(_frames(spark), "utt", model).filter("utt = 'u3'").orderBy("frame").collect()
    assert [r["state"] for r in path] == [0] * 10 + [1] * 10


def test_forced_alignment(spark):
    frames = _frames(spark)
    states = spark.createDataFrame([(f"u{u}", [0, 1]) for u in range(11)] + [("u11", list(range(2)) * 15)], "utt string, states array<int>")
    got = hmm.align(frames, states, "utt", MODEL | {"mean": np.array([[0.0, 0.0], [3.0, 0.0]])}).filter("utt = 'u1'").orderBy("seq").collect()
    assert [(r["state"], r["start_frame"], r["end_frame"]) for r in got] == [(0, 0, 9), (1, 10, 19)]
    assert hmm.align(frames, states, "utt", MODEL).select("utt").distinct().count() == 11


def test_regression_recovers_a_transform(spark):
    rng = np.random.default_rng(3)
    a, b = np.array([[1.2, 0.3], [-0.4, 0.8]]), np.array([0.5, -1.0])
    rows = [(1.0, m.tolist(), [1.0, 1.0], (a @ m + b).tolist()) for m in rng.normal(size=(50, 2))]
    got = {r["d"]: r["row"] for r in hmm.regression(spark.createDataFrame(rows, "gamma double, mean array<double>, var array<double>, vec array<double>"), 2).collect()}
    assert np.allclose([got[0], got[1]], np.column_stack([a, b]))


def brute_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d = [i] + [min(d[j] + (x != y), d[j + 1] + 1, 0) if False else min(d[j] + (x != y), d[j + 1] + 1) for j, y in enumerate(b)]
        for j in range(1, len(d)):
            d[j] = min(d[j], d[j - 1] + 1)
    return d[-1]


def test_edit_alignment():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = (list(rng.choice(list("abc"), rng.integers(0, 9))) for _ in range(2))
        ops = evaluation.align(a, b)
        assert sum(o != "C" for o in ops) == brute_distance(a, b)
        assert sum(o != "I" for o in ops) == len(a) and sum(o != "D" for o in ops) == len(b)


def test_rates_and_bootstrap(spark):
    rows = [("s1", 8, 1, 1, 0), ("s1", 9, 0, 0, 1), ("s2", 0, 0, 0, 0)]
    scores = spark.createDataFrame(rows, "speaker string, hits int, subs int, dels int, ins int")
    got = {r["speaker"]: r for r in evaluation.rates(scores, "speaker").collect()}
    assert got["s1"]["wer"] == pytest.approx(3 / 19) and got["s2"]["wer"] == 0 and got["s2"]["wip"] == 0
    pairs = spark.createDataFrame([(n % 2, int(n % 3 == 0), 10) for n in range(40)], "speaker int, errors int, words int")
    ends = evaluation.bootstrap(pairs, "speaker", "errors", "words", 500).first()
    assert ends["low"] < 14 / 400 < ends["high"]
    gate = evaluation.paired_gate(pairs.withColumn("other", F.col("errors") + 1), "speaker", "errors", "other", "words", 100).first()
    assert gate["passed"]


def test_tree_grows_and_ties(spark):
    counts = spark.createDataFrame([("a", "x", 90), ("a", "y", 10), ("b", "x", 10), ("b", "y", 90), ("c", "x", 50), ("c", "y", 50)], "ctx string, out string, n long")
    asked = spark.createDataFrame([("A", "a"), ("B", "b"), ("AC", "a"), ("AC", "c")], "question string, member string")
    nodes = trees.grow(counts, "ctx", "out", "n", asked, 3)
    assert len(nodes) == 2 and nodes[0]["question"] == "A"
    tied = trees.tie(counts, "ctx", nodes, {"A": ["a"], "B": ["b"], "AC": ["a", "c"]})
    assert tied.select("leaf").distinct().count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "a b")], "utt_id string, text string")
    assert [r[0] for r in sinks.transcript_lines(rows, "sphinx").collect()] == ["<s> a b </s> (u1)"]
    sums = spark.createDataFrame([(1, 0, "s", 2.0), (1, 1, "s", 3.0)], "pass int, shard int, senone string, occ double")
    sinks.write_accumulators(sums, str(tmp_path / "acc"))
    assert sinks.restore_accumulators(spark, str(tmp_path / "acc"), ["senone"], ["occ"]).first()["occ"] == 5.0
    phones = spark.createDataFrame([("B",), ("SIL",), ("A",), ("A1",)], "phone string")
    assert [r[0] for r in sinks.phone_lines(phones).collect()] == ["SIL", "A", "B"]


def test_framing_and_hangover(spark):
    s = spark.createDataFrame([("u", list(range(10)))], "utt string, x array<int>")
    assert [r["samples"] for r in sequences.framing(s, "utt", "x", 4, 3).orderBy("frame").collect()] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    f = spark.createDataFrame([("u", n, c == "1") for n, c in enumerate("0110111010000")], "utt string, frame int, speech boolean")
    got = "".join("01"[r["in_speech"]] for r in sequences.hangover(f, "utt", "speech", 2, 2).orderBy("frame").collect())
    assert got == "0011111111000"  # frames 9 and 10 are the first two silent ones in a row


def test_live_deltas_match_batch(spark, tmp_path):
    values = [float(v) for v in np.random.default_rng(5).normal(size=9)]
    schema = "utt string, frame int, value double, last boolean"
    rows = [("u", n, v, n == 8) for n, v in enumerate(values)]
    for k, part in enumerate((rows[:4], rows[4:7], rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = live.live_deltas(stream, "utt", "value").writeStream.format("memory").queryName("deltas").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [r["delta"] for r in spark.table("deltas").orderBy("frame").collect()]
    clip = lambda n: values[min(max(n, 0), 8)]
    assert np.allclose(got, [clip(n + 2) - clip(n - 2) for n in range(9)])


def test_entry_survives_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "cadenza", tmp_path / "cadenza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize(
    "line, want",
    [
        ("utt1 i read(2)", ("utt1", "i read(2)")),
        ("<s> hello world </s> (utt1)", ("utt1", "hello world")),
        ("hello world (a session 7)", ("a session 7", "hello world")),
        ("<s> </s> (u)", ("u", "")),
        ("  <s> a (b) c </s>  (u)  ", ("u", "a (b) c")),
        ("u <s> a </s>", ("u", "<s> a </s>")),
        ("lonely", None),
        ("   ", None),
    ],
)
def test_transcript_forms(spark, line, want):
    got = spark.createDataFrame([(line,)], "l string").select(text.utterance(F.col("l")).alias("u")).first()["u"]
    assert (None if got is None else tuple(got)) == want


def test_format_of_files(spark):
    cases = {"# a,b\n\n<s> x </s> (u)\n": "sphinx", "x (u)\n": "unknown", "\n  u\tx, y\n": "tsv", "u,x\nv\ty\n": "csv", "": "unknown", "# only\n": "unknown", "u1 x\nu,y": "unknown"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.format_of(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in rows} == cases


def test_convergence_after_zero(spark):
    rows = spark.createDataFrame([(1, 0.0, 10), (2, -20.0, 10), (3, -20.0, 10), (4, 5.0, 10)], "pass int, ll double, n long")
    got = [(r["delta"], r["stop"]) for r in evaluation.convergence(rows, "pass", "ll", "n", 0.1, 3).orderBy("pass").collect()]
    assert got == [(None, False), (-1.0, False), (0.0, True), (2.5, False)]


def test_letter_distance_of_many_words(spark):
    rng = np.random.default_rng(8)
    cases = [([f"w{n}" for n in range(300)], [f"w{n}" if n != 250 else "other" for n in range(300)])]
    for size in (0, 1, 40, 400):
        cases.append(([f"w{k}" for k in rng.integers(0, 500, size)], [f"w{k}" for k in rng.integers(0, 500, max(0, size - 3))]))
    rows = spark.createDataFrame(cases, "a array<string>, b array<string>").select("a", "b", evaluation.letter_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in rows] == [sum(o != "C" for o in evaluation.align(r["a"], r["b"])) for r in rows]
    assert rows[0]["d"] == 1


def test_live_mean_leaves_low_frames_alone(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(1, 2, 200)
    rows = spark.createDataFrame([("u", n, float(v)) for n, v in enumerate(x)], "utt string, frame int, x double")
    got = [r["y"] for r in sequences.live_mean_normalised(rows, "utt", "x", 5.0, 10, 20).orderBy("frame").collect()]
    mean, total, n, want = 5.0, 50.0, 10, []
    for v in x:
        want.append(v - mean if v >= 0 else v)
        if v >= 0:
            total, n = total + v, n + 1
        if n > 20:
            mean = total / n
            total, n = mean * 10, 10
    assert np.allclose(got, want)


def test_boundaries_after_an_insertion(spark):
    schema = "utt string, seq int, label string, start double, end double"
    ref = [("u", 0, "a", 0.0, 0.1), ("u", 1, "b", 0.1, 0.2), ("u", 2, "c", 0.2, 0.3), ("v", 0, "a", 0.0, 1.0)]
    hyp = [("u", 0, "x", 0.0, 0.02), ("u", 1, "a", 0.02, 0.115), ("u", 2, "b", 0.115, 0.23), ("u", 3, "c", 0.23, 0.3)]
    got = {r["utt"]: r for r in evaluation.boundary_scores(spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema), "utt").collect()}
    u = got["u"]
    assert (u["reference_boundaries"], u["hypothesis_boundaries"], u["comparable"], u["insertions"]) == (2, 3, 2, 1)
    assert u["mean_error_ms"] == pytest.approx(22.5) and u["median_error_ms"] == pytest.approx(22.5)
    assert u["recall"] == [0.0, 0.5, 0.5, 1.0] and u["precision"] == pytest.approx([0, 1 / 3, 1 / 3, 2 / 3]) and u["f1"][3] == pytest.approx(0.8)
    assert got["v"]["mean_error_ms"] == math.inf and got["v"]["deletions"] == 1 and got["v"]["f1"] == [0.0] * 4
    with pytest.raises(Exception, match="bad interval"):
        evaluation.boundary_scores(spark.createDataFrame([("u", 0, "", 0.0, 0.1)], schema), spark.createDataFrame(hyp, schema), "utt").collect()


def test_partitions_agree_within_subjects(spark):
    schema = "subject string, context string, part int"
    left = [("s", "a", 1), ("s", "b", 1), ("s", "c", 2), ("t", "a", 1), ("t", "b", 2), ("u", "a", 1)]
    right = [("s", "a", 7), ("s", "b", 8), ("s", "c", 8), ("t", "a", 5), ("t", "b", 6), ("w", "a", 1)]
    rows = {r["subject"]: r for r in trees.agreement(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "subject", "context", "part").collect()}
    assert (rows["s"]["pairs"], rows["s"]["disagreements"], rows["s"]["equal"]) == (3, 2, False)
    assert rows["t"]["equal"] and rows["t"]["left_parts"] == 2
    assert (rows["u"]["left_only"], rows["u"]["equal"], rows["w"]["right_only"]) == (1, False, 1)


def test_variance_floor_counts_all_variances(spark):
    from cadenza.operators import gaussians

    rows = spark.createDataFrame([(0, 0.0)] * 5 + [(0, float(v)) for v in (1, 2, 3, 4, 5)], "dim int, var double")
    assert gaussians.percentile_floor(rows, 4, 0.2).first()["floor"] == pytest.approx(4.0)
    assert gaussians.percentile_floor(rows, 4, 0.6).first()["floor"] == pytest.approx(6.0)
