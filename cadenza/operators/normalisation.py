"""Cepstral normalisation by codewords: noise and tilt of an utterance by EM over a codebook of clean speech, then the expected clean frames.

An utterance is one row of frames; the codebook is small and shipped with the tasks. Codeword 0 stands for noise. What noise
and tilt do to a codeword is a correction vector: the cepstrum of ln(1 + e^s), with s the log spectrum of noise less tilt and codeword.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Intervals of the spectrum, passes at most, part of the range of c0 below which frames start as noise.
BINS, PASSES, QUIET = 32, 7, 1 / 20


def _spectrum(cepstra: np.ndarray) -> np.ndarray:
    """The cosine transform of even sequences (rows, BINS + 1): its own inverse but for a factor 2 * BINS."""
    k = np.arange(BINS + 1)
    wave = 2 * np.cos(np.pi * np.outer(k, k) / BINS)
    wave[0], wave[-1] = 1.0, (-1.0) ** k
    return cepstra @ wave


def corrections(noise: np.ndarray, tilt: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The correction of each codeword; that of codeword 0 is what speech adds to the noise."""
    at = noise - tilt - mean
    at[0] = -at[0]
    wide = np.zeros((len(mean), BINS + 1))
    wide[:, : mean.shape[1]] = at
    return _spectrum(np.logaddexp(_spectrum(wide), 0.0))[:, : mean.shape[1]] / (2 * BINS)


def _shares(z: np.ndarray, centre: np.ndarray, var: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log density of each frame up to a constant, and the share of each codeword in it; prior: log of probability over volume."""
    each = prior - 0.5 * ((z[:, None] - centre) ** 2 / var).sum(axis=2)
    top = each.max(axis=1, keepdims=True)
    part = np.exp(each - top)
    whole = part.sum(axis=1, keepdims=True)
    return (np.log(whole) + top)[:, 0], part / whole


def estimated(z: np.ndarray, prob: np.ndarray, mean: np.ndarray, var: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Noise, tilt, log-likelihood a frame and passes after the first: until the likelihood falls or passes are done.

    Noise starts as the mean of the frames of least c0, tilt as the mean of all less that of the codebook.
    """
    prior = np.log(np.maximum(prob, 1e-300)) - 0.5 * np.log(var).sum(axis=1)
    tilt = z.mean(axis=0) - prob @ mean
    low, high = z[:, 0].min(), z[:, 0].max()
    quiet = z[:, 0] < low + (high - low) * QUIET
    noise = z[quiet].mean(axis=0) if quiet.any() else z[z[:, 0] == low].mean(axis=0)
    before, done = -10.0, 0
    while True:
        correction = corrections(noise, tilt, mean)
        centre = np.concatenate([(noise + correction[0])[None], mean[1:] + correction[1:] + tilt])
        ll, share = _shares(z, centre, var, prior)
        now, silent = float(ll.mean()), share[:, 0].sum()
        if silent > 0:
            noise = (share[:, :1] * (z - correction[0])).sum(axis=0) / silent
        if len(z) - silent > 0:
            tilt = np.einsum("tk,tkd->d", share[:, 1:], z[:, None] - (mean + correction)[1:]) / (len(z) - silent)
        if not (now > before and done < passes):
            return noise, tilt, now, done
        before, done = now, done + 1


def cleaned(z: np.ndarray, noise: np.ndarray, tilt: np.ndarray, prob: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """The expected clean frames: each codeword's correction and the tilt taken out, by its share; noise counts as a frame of zeros."""
    prior = np.log(np.maximum(prob, 1e-300)) - 0.5 * np.log(var).sum(axis=1)
    correction = corrections(noise, tilt, mean)
    _, share = _shares(z, mean + tilt + correction, var, prior)
    return np.einsum("tk,tkd->td", share[:, 1:], z[:, None] - tilt - correction[1:])


def codeword_normalised(utterances: DataFrame, key: str, codebook: dict, passes: int = PASSES) -> DataFrame:
    """key, frame, vec, noise, tilt, likelihood: the clean frames of each utterance (key, frames: array of vectors), with its estimates.

    codebook: prob, mean and var (arrays; codeword 0 is noise), of at most BINS + 1 dimensions. Utterances without frames have no row.
    """
    prob, mean, var = (np.asarray(codebook[c], dtype=float) for c in ("prob", "mean", "var"))
    if mean.shape[1] > BINS + 1 or len(mean) < 2:
        raise ValueError("a codebook needs two codewords or more, of at most 33 dimensions")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, flat, n in zip(batch[key], batch["x"], batch["n"], strict=True):
                if not n > 0:
                    continue
                z = np.asarray(flat, dtype=float).reshape(n, mean.shape[1])
                noise, tilt, likelihood, _ = estimated(z, prob, mean, var, passes)
                x = cleaned(z, noise, tilt, prob, mean, var)
                rows = {key: name, "frame": np.arange(len(z), dtype=np.int32), "vec": list(x)}
                yield pd.DataFrame(rows).assign(noise=[noise] * len(z), tilt=[tilt] * len(z), likelihood=likelihood)

    kind = utterances.schema[key].dataType.simpleString()
    # All numbers of the frames in one array: an object for each frame would take many times the memory.
    flat = utterances.select(key, F.coalesce(F.size("frames"), F.lit(0)).alias("n"), F.flatten("frames").cast("array<double>").alias("x"))
    return flat.mapInPandas(run, f"{key} {kind}, frame int, vec array<double>, noise array<double>, tilt array<double>, likelihood double")


def read_codebook(spark: SparkSession, path: str) -> dict:
    """A codebook file: numbers of codewords and dimensions, then of each codeword its probability, mean and variance, all as words.

    A file of too few or too many numbers is an error.
    """
    numbers = [float(w) for r in spark.read.text(path, wholetext=True).collect() for w in r["value"].split()]
    if len(numbers) < 2 or len(numbers) != 2 + int(numbers[0]) * (1 + 2 * int(numbers[1])):
        raise ValueError("not a codebook")
    n, dim = int(numbers[0]), int(numbers[1])
    rows = np.array(numbers[2:]).reshape(n, 1 + 2 * dim)
    return {"prob": rows[:, 0], "mean": rows[:, 1 : 1 + dim], "var": rows[:, 1 + dim :]}


def codebook_lines(model: DataFrame) -> DataFrame:
    """line_no, line of the file of a codebook (code, prob, mean, var), in the order of code: small, one row a codeword."""
    words = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.6g", x)), " ")
    ordered = F.array_sort(F.collect_list(F.struct("code", "prob", "mean", "var")))
    book = model.agg(ordered.alias("b"))
    head = F.concat_ws(" ", F.size("b"), F.size(F.get("b", F.lit(0))["mean"]))
    lines = F.transform("b", lambda c: F.concat_ws(" ", F.format_string("%.6g", c["prob"]), words(c["mean"]), words(c["var"])))
    return book.select(F.posexplode(F.concat(F.array(head), lines)).alias("line_no", "line"))
