"""The acoustic front end as one operator: samples to cepstra, and the frames of speech among them.

Recordings are rows; a task turns the frames of one into blocks of arrays: window, real FFT, mel filters,
logarithm and cosine transform are each one call for a block. What carries over from one frame to the next (samples
left over, the sample before, the endpointer's counters) is a small state, so that a stream of pieces gives the same frames.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames whose spectra are held at once.
BLOCK = 4096


@dataclass(frozen=True)
class FrontEnd:
    """Settings: rates in hertz, window in seconds. transform: legacy, dct or htk; output: cepstra, raw or smooth (log spectra).

    speech_ratio: the log ratio of power to noise that a frame of speech has in some band.
    """

    rate: float = 16000.0
    frame_rate: float = 100.0
    window: float = 0.025625
    fft: int = 512
    filters: int = 25
    low: float = 130.0
    high: float = 6800.0
    cepstra: int = 13
    alpha: float = 0.97
    lifter: int = 22
    transform: str = "dct"
    output: str = "cepstra"
    dither: bool = True
    seed: int = 0
    remove_dc: bool = True
    remove_noise: bool = True
    speech_ratio: float = 2.0
    rounded: bool = True
    unit_area: bool = True
    double_width: bool = False
    floor: float = 1e-4

    @property
    def size(self) -> int:
        return int(self.window * self.rate + 0.5)

    @property
    def shift(self) -> int:
        return int(self.rate / self.frame_rate + 0.5)


def mel_bank(front: FrontEnd) -> np.ndarray:
    """Weights (filters, fft / 2 + 1) of triangles even on the mel scale; edges on bins and of unit area if so set. The last bin has no weight."""
    mel = lambda f: 2595.0 * np.log10(1 + f / 700.0)
    hertz = lambda m: 700.0 * (10 ** (m / 2595.0) - 1)
    first, last, bin_ = mel(front.low), mel(front.high), front.rate / front.fft
    step, reach = (last - first) / (front.filters + 1), 1
    if front.double_width:
        first, last, reach = first - step, last + step, 2
        if hertz(first) < 0 or hertz(last) > front.rate / 2:
            raise ValueError("filters reach out of the spectrum")
    edges = hertz(first + (np.arange(front.filters)[:, None] + reach * np.arange(3)) * step)
    if front.rounded:
        edges = np.floor(edges / bin_ + 0.5) * bin_
    at = np.arange(front.fft // 2 + 1) * bin_
    left, top, right = edges[:, :1], edges[:, 1:2], edges[:, 2:]
    height = 2 / (right - left) if front.unit_area else 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.fmin((at - left) / (top - left), (right - at) / (right - top)) * height
    weights[(at < left) | (at > right)] = 0.0
    weights[:, -1] = 0.0
    return weights


def cosines(front: FrontEnd) -> np.ndarray:
    """The transform (cepstra, filters) of log spectra."""
    n = front.filters
    wave = np.cos(np.pi / n * np.arange(front.cepstra)[:, None] * (np.arange(n) + 0.5))
    if front.transform == "legacy":
        wave[:, 0] *= 0.5  # the first band counts half
        return wave / n
    scale = np.full((front.cepstra, 1), np.sqrt(2 / n))
    if front.transform == "dct":
        scale[0] = np.sqrt(1 / n)
    elif front.transform != "htk":
        raise ValueError(f"no transform {front.transform}")
    return wave * scale


def inverse_cosines(front: FrontEnd) -> np.ndarray:
    """The transform (filters, cepstra) from orthonormal cepstra back to log spectra."""
    wave = np.cos(np.pi / front.filters * np.arange(front.cepstra) * (np.arange(front.filters)[:, None] + 0.5))
    wave[:, 0] = np.sqrt(0.5)
    return wave * np.sqrt(2 / front.filters)


def lifter_weights(front: FrontEnd) -> np.ndarray:
    if not front.lifter:
        return np.ones(front.cepstra)
    return 1 + front.lifter // 2 * np.sin(np.arange(front.cepstra) * np.pi / front.lifter)


class Analysis:
    """What of the settings is the same for every frame."""

    def __init__(self, front: FrontEnd):
        self.front, self.bank, self.wave, self.lift = front, mel_bank(front), cosines(front), lifter_weights(front)
        n = front.size
        half = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n // 2) / (n - 1.0)) if n > 1 else np.ones(0)
        self.hamming = np.ones(n)
        self.hamming[: n // 2], self.hamming[n - n // 2 :] = half, half[::-1]
        smooth = FrontEnd(**{**front.__dict__, "transform": "dct"})
        self.smooth = inverse_cosines(front) @ cosines(smooth)

    def mel(self, frames: np.ndarray) -> np.ndarray:
        """Mel spectra of emphasised frames (n, size)."""
        if self.front.remove_dc:
            frames = frames - frames.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(frames * self.hamming, self.front.fft, axis=1)
        return (spectrum.real**2 + spectrum.imag**2) @ self.bank.T

    def features(self, frames: np.ndarray, noise: Noise) -> tuple[np.ndarray, list[bool]]:
        """Features of frames, and which are speech; noise is what the frames before left."""
        mel, speech = noise.track(self.mel(frames))
        logs = np.log(mel + self.front.floor)
        if self.front.output == "raw":
            return logs, speech
        if self.front.output == "smooth":
            return logs @ self.smooth.T, speech
        return logs @ self.wave.T * self.lift, speech


#: Smoothing of power; of the lower envelope where it rises and falls; decay of peaks, where they mask and how low; largest gain;
#: decay and learning of the loudness peak, and how far below it a frame is quiet: fixed values.
POWER, RISE, FALL, DECAY, MASKED, GAIN = 0.7, 0.995, 0.5, 0.85, 0.2, 20.0
FORGET, LEARN, QUIET_RANGE, NEIGHBOURS = 0.9995, 0.9, 8.0, 4


def _envelope(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The lower envelope, slow to rise and quick to fall."""
    keep = np.where(x >= low, RISE, FALL)
    return keep * low + (1 - keep) * x


class Noise:
    """Recursive estimates by band: smoothed power, noise as its lower envelope, floor of the signal above it, peaks that mask; and of the loudness."""

    def __init__(self, front: FrontEnd, state: list[float] | None = None):
        self.front, self.bands = front, None
        if state:
            self.loudness, self.bands = state[0], np.array(state[1:]).reshape(4, -1)
        n = front.filters
        low, high = np.maximum(np.arange(n) - NEIGHBOURS, 0), np.minimum(np.arange(n) + NEIGHBOURS, n - 1)
        self.smooth = ((np.arange(n) >= low[:, None]) & (np.arange(n) <= high[:, None])) / (high - low + 1)[:, None]

    def state(self) -> list[float]:
        return [] if self.bands is None else [self.loudness, *self.bands.ravel().tolist()]

    def _step(self, mel: np.ndarray) -> tuple[np.ndarray, bool]:
        if self.bands is None:
            self.loudness, self.bands = 0.0, np.stack([mel, mel / GAIN, mel / GAIN, np.zeros(len(mel))])
        power, noise, floor, peak = self.bands
        power = POWER * power + (1 - POWER) * mel
        noise = _envelope(power, noise)
        signal = np.maximum(power - noise, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.log(power / noise)
        loud = float(np.log(signal.sum()))
        keep = LEARN if loud > self.loudness else FORGET
        self.loudness = self.loudness * keep + loud * (1 - keep)
        speech = bool(max(0.0, float(np.nanmax(ratio, initial=0.0))) >= self.front.speech_ratio and self.loudness - QUIET_RANGE <= loud)
        floor = _envelope(signal, floor)
        peak = peak * DECAY
        masked = np.maximum(np.where(signal < DECAY * peak, peak * MASKED, signal), floor)
        self.bands = np.stack([power, noise, floor, np.maximum(peak, signal)])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.clip(np.where(masked < GAIN * power, masked / power, GAIN), 1 / GAIN, GAIN)
        return mel * (self.smooth @ gain), speech

    def track(self, mel: np.ndarray) -> tuple[np.ndarray, list[bool]]:
        """Mel spectra with the noise taken out, and which frames are speech; without remove_noise all are, as they were."""
        if not self.front.remove_noise or not len(mel):
            return mel, [True] * len(mel)
        steps = [self._step(row) for row in mel]
        return np.array([m for m, _ in steps]), [s for _, s in steps]


def dithered(samples: np.ndarray, first: int, seed: int) -> np.ndarray:
    """One added to a quarter of the samples; which ones depends on the seed and their place (first on) only."""
    bits = np.random.Philox(key=seed, counter=first // 4).random_raw(len(samples) + first % 4)[first % 4 :]
    return samples + (bits % 4 == 0)


def seed_of(front: FrontEnd, key) -> int:
    return front.seed * (1 << 32) + zlib.crc32(str(key).encode())


def cut_frames(samples: np.ndarray, before: float, last: bool, front: FrontEnd) -> tuple[np.ndarray, int]:
    """Emphasised frames (n, size) of the samples at hand, the last one padded with zeros, and the samples they used up.

    before: the sample before these, 0 at the begin. Without last, only whole frames are made.
    """
    n, size, shift = len(samples), front.size, front.shift
    whole = 1 + (n - size) // shift if n >= size else 0
    count = whole + (1 if last and n > whole * shift else 0)
    x = samples - front.alpha * np.concatenate([[before], samples[:-1]]) if n else samples
    padded = np.zeros(max(n, (count - 1) * shift + size if count else 0))
    padded[:n] = x
    at = np.arange(count)[:, None] * shift + np.arange(size)
    return padded[at], count * shift


def cepstra(audio: DataFrame, key: str, samples: str, front: FrontEnd) -> DataFrame:
    """key, frame, vec, speech: the features of every frame of every recording (samples: an array of whole numbers).

    The last frame is padded with zeros if samples are left for it. A recording without samples has no frame; a
    null sample is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analysis = Analysis(front)
        for batch in batches:
            for name, x in zip(batch[key], batch[samples], strict=True):
                if x is None or not len(x):
                    continue
                noise = Noise(front)
                x = np.asarray(x, dtype=float)
                if np.isnan(x).any():
                    raise ValueError(f"a sample of {name} is null")
                if front.dither:
                    x = dithered(x, 0, seed_of(front, name))
                for a in range(0, len(x), BLOCK * front.shift):
                    # A block sees as many samples ahead as its last frame needs.
                    b = min(len(x), a + (BLOCK - 1) * front.shift + front.size)
                    frames, _ = cut_frames(x[a:b], x[a - 1] if a else 0.0, b == len(x), front)
                    vec, speech = analysis.features(frames[:BLOCK], noise)
                    yield pd.DataFrame({key: name, "frame": np.arange(len(vec), dtype=np.int32) + a // front.shift, "vec": list(vec), "speech": speech})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, samples).mapInPandas(run, f"{key} {kind}, frame int, vec array<double>, speech boolean")


# --- endpoints ---------------------------------------------------------------------------------------

#: in_speech, speech frames in a row before it, silent frames in a row in it, segment number, frames held back.
QUIET = (False, 0, 0, -1, ())


def endpoint(state: tuple, frames: list, start: int, stop: int, held: int) -> tuple[tuple, list]:
    """The state after frames (number, speech) and the (number, segment) of those that belong to speech.

    Speech begins with the start-th speech frame in a row and takes the last held frames before along; it ends with
    the stop-th silent frame in a row, which is not part of it any more.
    """
    talking, before, after, segment, kept = state
    kept, out = list(kept), []
    for number, speech in frames:
        if not talking:
            kept = [*kept, number][-held:] if held else []
        if speech:
            after = 0
            if not talking:
                before += 1
                if before >= start:
                    talking, before, segment = True, 0, segment + 1
        else:
            before = 0
            if talking:
                after += 1
                if after >= stop:
                    talking, after, kept = False, 0, []
        if talking:
            out += [(n, segment) for n in kept or [number]]
            kept = []
    return (talking, before, after, segment, tuple(kept)), out


def endpointed(frames: DataFrame, key: str, speech: str, start: int = 10, stop: int = 50, held: int = 20) -> DataFrame:
    """key, frame, segment of the frames that belong to speech, by endpoint. A null flag counts as silence."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        flags = [bool(s) if s is not None and s == s else False for s in rows[speech]]
        _, found = endpoint(QUIET, list(zip(rows["frame"].tolist(), flags, strict=True)), start, stop, held)
        return pd.DataFrame([(rows[key].iloc[0], *x) for x in found], columns=[key, "frame", "segment"])

    kinds = {c: frames.schema[c].dataType.simpleString() for c in (key, "frame")}
    return frames.select(key, "frame", F.coalesce(F.col(speech), F.lit(False)).alias(speech)).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, frame {kinds['frame']}, segment int")


# --- pitch -------------------------------------------------------------------------------------------


def normalised_differences(frames: np.ndarray) -> np.ndarray:
    """The squared difference of the first half of each frame to itself t samples later, over its mean for 1 to t; 1 at t = 0."""
    n = frames.shape[1] // 2
    d = np.stack([((frames[:, :n] - frames[:, t : t + n]) ** 2).sum(axis=1) for t in range(n)], axis=1)
    total = np.cumsum(d, axis=1)
    out = np.ones_like(d)
    np.divide(d * np.arange(n), total, out=out, where=total > 0)
    out[:, 0] = 1.0
    return out


def first_below(d: np.ndarray, threshold: float, begin: int, end: int) -> int:
    """The first place below the threshold, else the first of the least; 0 where there is none."""
    part = d[begin:end]
    if not len(part):
        return 0
    below = np.flatnonzero(part < threshold)
    return begin + int(below[0] if len(below) else part.argmin())


def best_periods(d: np.ndarray, threshold: float, reach: float, smooth: int) -> list[tuple[int, float]]:
    """Period and difference of each frame: its own, unless a frame up to smooth away has a lower difference: then the own one near that period."""
    own = [first_below(x, threshold, 0, len(x)) for x in d]
    off = [float(x[p]) for x, p in zip(d, own, strict=True)]
    out = []
    for i in range(len(d)):
        near = range(max(0, i - smooth), min(len(d), i + smooth + 1))
        k = min([i, *near], key=lambda j: off[j])  # ties: the frame itself, then the first
        period, best = own[k], off[k]
        if period != own[i]:
            width = max(1, int(period * reach))
            period = first_below(d[i], threshold, max(0, period - width), min(d.shape[1], period + width))
            best = min(1.0, float(d[i][period]))
        out.append((period, best))
    return out


def pitch(audio: DataFrame, key: str, samples: str, rate: float, size: int, shift: int, threshold: float = 0.1, reach: float = 0.2, smooth: int = 2) -> DataFrame:
    """key, frame, period (samples), difference, hertz of whole frames of size samples; hertz is null where no difference is below threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, x in zip(batch[key], batch[samples], strict=True):
                if x is None or len(x) < size:
                    continue
                x = np.asarray(x, dtype=float)
                at = np.arange(1 + (len(x) - size) // shift)
                # A difference function has half a frame's length, so those of a recording are about as large as itself.
                parts = [normalised_differences(x[a[:, None] * shift + np.arange(size)]) for a in np.array_split(at, -(-len(at) // BLOCK))]
                found = best_periods(np.concatenate(parts), threshold, reach, smooth)
                hertz = [rate / p if p and d < threshold else None for p, d in found]
                yield pd.DataFrame({key: name, "frame": at.astype(np.int32), "period": [p for p, _ in found], "difference": [d for _, d in found], "hertz": hertz})

    kind = audio.schema[key].dataType.simpleString()
    return audio.select(key, samples).mapInPandas(run, f"{key} {kind}, frame int, period int, difference double, hertz double")
