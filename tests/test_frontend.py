"""The front end against a plain version, known signals, and its own streams."""

import json
import math
import struct

import numpy as np
import pytest

from cadenza.operators import frontend
from cadenza.operators.frontend import FrontEnd
from cadenza.sources import binary
from cadenza.streaming import live


def plain_features(x, front):
    """Frame by frame, with a transform by its definition."""
    size, shift, n = front.size, front.shift, front.fft
    count = (1 + (len(x) - size) // shift if len(x) >= size else 0)
    count += len(x) > count * shift
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    step = (mel(front.high) - mel(front.low)) / (front.filters + 1)
    edge = [700 * (10 ** ((mel(front.low) + k * step) / 2595) - 1) for k in range(front.filters + 2)]
    bin_ = front.rate / n
    edge = [int(e / bin_ + 0.5) * bin_ for e in edge]
    out = []
    for f in range(count):
        v = [(x[i] - front.alpha * (x[i - 1] if i else 0)) if i < len(x) else 0.0 for i in range(f * shift, f * shift + size)]
        mean = sum(v) / size
        v = [(a - mean) * (0.54 - 0.46 * math.cos(2 * math.pi * min(k, size - 1 - k) / (size - 1))) for k, a in enumerate(v)]
        turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2), np.arange(size)) / n)
        power = np.abs(turn @ np.array(v)) ** 2
        logs = []
        for k in range(front.filters):
            left, top, right = edge[k : k + 3]
            total = 0.0
            for b in range(n // 2):
                if left <= b * bin_ <= right:
                    sides = [(b * bin_ - left) / (top - left) if top > left else math.inf, (right - b * bin_) / (right - top) if right > top else math.inf]
                    total += power[b] * min(sides) * 2 / (right - left)
            logs.append(math.log(total + 1e-4))
        cep = []
        for c in range(front.cepstra):
            waves = [math.cos(math.pi / front.filters * c * (k + 0.5)) for k in range(front.filters)]
            if front.transform == "legacy":
                y = sum(w * v * (0.5 if k == 0 else 1) for k, (w, v) in enumerate(zip(waves, logs, strict=True))) / front.filters
            else:
                y = sum(w * v for w, v in zip(waves, logs, strict=True)) * math.sqrt((1 if c == 0 and front.transform == "dct" else 2) / front.filters)
            cep.append(y * (1 + front.lifter // 2 * math.sin(c * math.pi / front.lifter)) if front.lifter else y)
        out.append(cep)
    return np.array(out)


def wav(samples, rate=16000):
    data = np.asarray(samples, "<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize("transform, lifter", [("dct", 22), ("htk", 0), ("legacy", 21)])
def test_recordings_become_cepstra(spark, tmp_path, monkeypatch, transform, lifter):
    rng = np.random.default_rng(0)
    signals = {"a": (rng.normal(size=3000) * 3000).astype(int), "b": (8000 * np.sin(np.arange(1234) / 5)).astype(int), "short": np.array([5, -7, 9])}
    for name, x in signals.items():
        (tmp_path / f"{name}.wav").write_bytes(wav(x))
    (tmp_path / "empty.wav").write_bytes(wav([]))
    front = FrontEnd(transform=transform, lifter=lifter, dither=False, remove_noise=False)
    monkeypatch.setattr(frontend, "BLOCK", 4)  # several blocks a recording
    got = {}
    for r in frontend.cepstra(binary.audio(spark, str(tmp_path)), "path", "samples", front).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1][:-4], {})[r["frame"]] = r["vec"]
    assert set(got) == set(signals)
    for name, x in signals.items():
        want = plain_features(x.tolist(), front)
        assert sorted(got[name]) == list(range(len(want)))
        assert np.allclose([got[name][f] for f in range(len(want))], want, atol=1e-6)


def test_filters_and_log_spectra():
    wide = frontend.mel_bank(FrontEnd(double_width=True, rounded=False, low=300.0, high=6000.0))
    narrow = frontend.mel_bank(FrontEnd(double_width=False, rounded=False, low=300.0, high=6000.0))
    assert (wide > 0).sum() > 1.7 * (narrow > 0).sum()
    with pytest.raises(ValueError):
        frontend.mel_bank(FrontEnd(double_width=True, low=1.0, high=7999.0))
    assert frontend.mel_bank(FrontEnd(unit_area=False)).max() <= 1.0
    front = FrontEnd(cepstra=25, lifter=0, remove_noise=False)
    # With as many cepstra as filters, the transform and its inverse cancel out.
    assert np.allclose(frontend.inverse_cosines(front) @ frontend.cosines(front), np.eye(25))
    frames = np.random.default_rng(1).normal(size=(3, front.size)) * 1000
    outputs = {o: frontend.Analysis(FrontEnd(**{**front.__dict__, "output": o})).features(frames, frontend.Noise(front))[0] for o in ("raw", "smooth")}
    assert np.allclose(outputs["raw"], outputs["smooth"])
    x = np.arange(1000)
    whole = frontend.dithered(x, 0, 9) - x
    assert 180 < whole.sum() < 320 and set(whole) == {0, 1}
    assert np.array_equal(whole[333:], frontend.dithered(x[333:], 333, 9) - x[333:])


def test_noise_is_tracked_and_taken_out():
    front = FrontEnd(dither=False)
    rng = np.random.default_rng(2)
    analysis = frontend.Analysis(front)
    t = np.arange(16000 * 2)
    tone = np.where((t > 16000) & (t < 24000), 6000 * np.sin(2 * np.pi * 1000 * t / 16000), 0.0)
    frames, _ = frontend.cut_frames(rng.normal(size=len(t)) * 50 + tone, 0.0, True, front)
    mel = analysis.mel(frames)
    cleaned, speech = frontend.Noise(front).track(mel)
    speech = np.array(speech)
    # The noise is learned first; a tone that stays is taken for noise after a while.
    assert speech[104:120].all() and speech[45:98].mean() < 0.1 and speech[160:].mean() < 0.2
    assert (cleaned[60:98] < 0.9 * mel[60:98]).mean() > 0.9
    halves = frontend.Noise(front)
    first = halves.track(mel[:77])[0]
    again = frontend.Noise(front, halves.state())
    assert np.allclose(np.concatenate([first, again.track(mel[77:])[0]]), cleaned)


def test_pitch_of_known_signals(spark):
    rng = np.random.default_rng(3)
    t = np.arange(4000)
    rows = [("tone", (8000 * np.sin(2 * np.pi * t / 40)).astype(int).tolist()), ("noise", (rng.normal(size=4000) * 3000).astype(int).tolist()), ("flat", [7] * 900), ("short", [1, 2])]
    got = {}
    for r in frontend.pitch(spark.createDataFrame(rows, "utt string, x array<int>"), "utt", "x", 8000.0, 256, 80).collect():
        got.setdefault(r["utt"], {})[r["frame"]] = r
    assert set(got) == {"tone", "noise", "flat"} and len(got["tone"]) == 1 + (4000 - 256) // 80
    # The first lag below the threshold comes a little before the period itself.
    assert all(36 <= r["period"] <= 40 and r["hertz"] is not None for r in got["tone"].values())
    assert sum(r["hertz"] is not None for r in got["noise"].values()) == 0
    d = np.array([[1.0, 0.9, 0.4, 0.05, 0.3], [1.0, 0.5, 0.2, 0.6, 0.15], [1.0, 0.9, 0.9, 0.9, 0.9]])
    assert frontend.best_periods(d, 0.1, 0.34, 0) == [(3, 0.05), (4, 0.15), (1, 0.9)]
    assert frontend.best_periods(d, 0.1, 0.34, 1) == [(3, 0.05), (2, 0.2), (3, 0.9)]
    assert frontend.normalised_differences(np.full((1, 8), 3.0)).tolist() == [[1.0, 1.0, 1.0, 1.0]]


def run_stream(spark, tmp_path, parts, schema, made, name):
    for n, part in enumerate(parts):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n:03}.json").write_text("\n".join(json.dumps(r) for r in part))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name).collect()


def test_streamed_samples_give_the_batch_frames(spark, tmp_path):
    rng = np.random.default_rng(4)
    front = FrontEnd(rate=8000.0, frame_rate=100.0, window=0.02, fft=256, filters=12, low=200.0, high=3500.0)
    signals = {k: (rng.normal(size=n) * 2000).astype(int) for k, n in (("u", 1777), ("v", 160), ("w", 30))}
    parts = [[] for _ in range(4)]
    for k, x in signals.items():
        cuts = np.sort(rng.integers(0, len(x) + 1, size=5)).tolist()
        for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(x)], strict=True)):
            parts[int(rng.integers(4))].append({"utt": k, "piece": n, "x": x[a:b].tolist(), "last": n == 5})  # out of order
    got = run_stream(spark, tmp_path, parts, "utt string, piece int, x array<int>, last boolean", lambda s: live.live_cepstra(s, "utt", "x", front), "live_cepstra")
    batch = frontend.cepstra(spark.createDataFrame([(k, x.tolist()) for k, x in signals.items()], "utt string, x array<int>"), "utt", "x", front).collect()
    by = lambda rows: {(r["utt"], r["frame"]): r for r in rows}
    assert by(got).keys() == by(batch).keys() and len(got) == len(batch)
    for k, r in by(batch).items():
        assert np.allclose(by(got)[k]["vec"], r["vec"]) and by(got)[k]["speech"] == r["speech"]


def test_endpoints_in_batch_and_stream(spark, tmp_path):
    flags = [int(c) for c in "0110111011000001101111000"]
    rows = [("u", n, bool(f)) for n, f in enumerate(flags)] + [("v", n, None) for n in range(3)] + [("w", n, n > 1) for n in range(4)]
    frame = spark.createDataFrame(rows, "utt string, frame int, speech boolean")
    got = sorted(tuple(r) for r in frontend.endpointed(frame, "utt", "speech", 2, 3, 4).collect())
    # Speech from the second flag in a row (2), with the frames held back before it; silent from the third 0 in a row (12) on.
    want = [("u", n, 0) for n in range(0, 12)] + [("u", n, 1) for n in range(13, 24)] + [("w", n, 0) for n in range(4)]
    assert got == want
    parts = [[{"utt": u, "frame": n, "speech": s} for u, n, s in rows if n % 25 in range(a, b)] for a, b in ((0, 2), (2, 11), (11, 16), (16, 25))]
    live_rows = run_stream(spark, tmp_path, parts, "utt string, frame int, speech boolean", lambda s: live.live_endpoints(s, "utt", "speech", 2, 3, 4), "live_endpoints")
    assert sorted(tuple(r) for r in live_rows) == want
