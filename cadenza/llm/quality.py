"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. A line's features describe its characters and words and those of the
lines beside it; transitions tie neighbouring labels. The field is fitted by gradient on a bounded sample
of labelled documents, whose lines take the document's label; a document's quality is the mean of its
lines' forward-backward marginals, weighted by length, then calibrated by logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold
from .langid import bounded_sample, slices
from .toxicity import hash_runs

#: Sampled documents of either label, gradient steps and strength of L2.
SAMPLE, STEPS, L2 = 1500, 200, 1e-3
#: Fold of the rows that nothing is learned from; score from which a text is predicted good.
MODULUS, HELD_OUT, LIMIT = 5, 0, 0.3

#: Classes of bytes: upper case, lower case, other scripts, digits, white space, sentence marks, !, |, symbols.
UPPER, LOWER, OTHER, DIGIT, SPACE, MARK, BANG, PIPE, SYMBOL = range(9)
_CLASS = np.full(256, SYMBOL, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = UPPER, LOWER, OTHER, DIGIT
_CLASS[[32, *range(9, 14)]], _CLASS[[33]], _CLASS[[124]] = SPACE, BANG, PIPE
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = MARK


class Lines:
    """The lines of some texts that aren't blank: features, length, and each text's first line and number of lines."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        stops = np.flatnonzero(data == 10)
        begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
        number = np.repeat(np.arange(len(stops)), stops - begins + 1)
        count = np.bincount(number * 9 + _CLASS[data], minlength=9 * len(stops)).reshape(-1, 9).astype(float)
        count[:, SPACE] -= 1  # the line feed
        length = count.sum(axis=1)
        doc = np.searchsorted(ends, begins, side="right")
        # Words, and which of them were seen before in the line or in the document.
        begin, _, h = hash_runs(data, _CLASS[data] != SPACE)
        line_of = number[begin]
        words = np.bincount(line_of, minlength=len(stops)).astype(float)

        def seen_before(group: np.ndarray) -> np.ndarray:
            key = h ^ ((group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            new = np.ones(len(key), dtype=bool)
            new[np.unique(key, return_index=True)[1]] = False
            return np.bincount(line_of, weights=new, minlength=len(stops))

        in_line, in_doc = seen_before(line_of), seen_before(doc[line_of])
        # A line's hash is the sum over its words, by place.
        place = np.arange(len(h)) - (np.cumsum(words) - words).astype(np.int64)[line_of]
        whole = np.zeros(len(stops), dtype=np.uint64)
        np.add.at(whole, line_of, h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        key = whole ^ ((doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        n, w = np.maximum(1, length), np.maximum(1, words)
        letters = np.maximum(1, count[:, UPPER] + count[:, LOWER] + count[:, OTHER])
        own = np.stack(
            [
                np.log1p(length) / 8,
                count[:, UPPER] / letters,
                count[:, UPPER] / letters > 0.5,
                letters / n,
                count[:, DIGIT] / n,
                count[:, MARK] / n,
                np.minimum(1, 10 * count[:, BANG] / n),
                np.minimum(1, 10 * count[:, PIPE] / n),
                np.minimum(1, 10 * count[:, SYMBOL] / n),
                count[:, SYMBOL] / w > 0.2,
                np.minimum(1, length / w / 20),
                in_line / w,
                in_doc / w,
                times[back] > 1,
                words < 4,
            ],
            axis=1,
        ).astype(float)
        there = words > 0
        own, length, doc = own[there], length[there], doc[there]
        self.count = np.bincount(doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        same = doc[1:] == doc[:-1]
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
        edge = np.ones((len(own), 3))
        edge[1:, 1], edge[:-1, 2] = ~same, ~same
        self.x = np.concatenate([own, before, after, edge], axis=1)
        self.length, self.doc = length, doc


def forward_backward(s: np.ndarray, first: np.ndarray, count: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward messages and emissions of all chains at once; s: log-odds of good by line."""
    emit = np.stack([np.ones(len(s)), np.exp(np.clip(s, -30, 30))], axis=1)
    emit /= emit.sum(axis=1, keepdims=True)
    order = np.argsort(-count, kind="stable")
    at, left = first[order], -count[order]
    alpha, beta = np.ones((len(s), 2)), np.ones((len(s), 2))
    most = int(count.max()) if len(count) else 0
    going = np.searchsorted(left, -np.arange(most), side="left")  # chains longer than t
    for t in range(most):
        i = at[: going[t]] + t
        a = emit[i] if t == 0 else (alpha[i - 1] @ transition) * emit[i]
        alpha[i] = a / a.sum(axis=1, keepdims=True)
    for t in range(most - 2, -1, -1):
        i = at[: going[t + 1]] + t
        b = (beta[i + 1] * emit[i + 1]) @ transition.T
        beta[i] = b / b.sum(axis=1, keepdims=True)
    return alpha, beta, emit


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1)


def document_means(p: np.ndarray, lines: Lines) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 for a text without lines."""
    n = len(lines.count)
    weight = np.bincount(lines.doc, weights=lines.length, minlength=n)
    return np.bincount(lines.doc, weights=lines.length * p, minlength=n) / np.maximum(1e-9, weight)


class Model:
    """Feature means and scales, weights, log transitions and the two calibration numbers."""

    def __init__(self, centre, scale, w, log_transition, calibration):
        self.centre, self.scale, self.w, self.calibration = centre, scale, w, calibration
        self.transition = np.exp(log_transition)

    def means(self, lines: Lines) -> np.ndarray:
        s = ((lines.x - self.centre) / self.scale) @ self.w[:-1] + self.w[-1]
        alpha, beta, _ = forward_backward(s, lines.first, lines.count, self.transition)
        return document_means(marginals(alpha, beta), lines)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known = [t or "" for t in texts]
        out = np.zeros(len(known))
        for a, b in slices(known):
            out[a:b] = self.means(Lines(known[a:b]))
        margin = self.calibration[0] * out + self.calibration[1]
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for n in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    return x


def fit(texts: list[str], labels: np.ndarray, share: float, steps: int = STEPS) -> Model:
    """The field and its calibration; share: of good documents among all labelled ones."""
    lines = Lines(texts)
    y = labels[lines.doc].astype(float)
    sure = lines.x.std(axis=0)
    centre, scale = lines.x.mean(axis=0) if len(lines.x) else 0, np.where(sure > 1e-6, sure, 1.0)
    x = (lines.x - centre) / scale
    both = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())])
    of_doc = 1 / np.maximum(1, lines.count) ** 0.5 / both[labels]
    of_doc /= max(1e-12, (of_doc * lines.count).sum())
    weight = of_doc[lines.doc]
    pair = np.flatnonzero(lines.doc[1:] == lines.doc[:-1])
    width = x.shape[1]

    def gradient(theta: np.ndarray) -> np.ndarray:
        w, bias, log_transition = theta[:width], theta[width], theta[width + 1 :].reshape(2, 2)
        transition = np.exp(log_transition)
        alpha, beta, emit = forward_backward(x @ w + bias, lines.first, lines.count, transition)
        off = (marginals(alpha, beta) - y) * weight
        xi = alpha[pair][:, :, None] * transition * (emit * beta)[pair + 1][:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        expected = (xi * weight[pair][:, None, None]).sum(axis=0)
        seen = np.diag([weight[pair][y[pair] == v].sum() for v in (0, 1)])
        return np.concatenate([x.T @ off + L2 * w, [off.sum()], (expected - seen + 0.02 * log_transition).ravel()])

    theta = _adam(gradient, np.zeros(width + 5), steps, 0.05)
    model = Model(centre, scale, theta[: width + 1], theta[width + 1 :].reshape(2, 2), (1.0, 0.0))
    raw = model.means(lines)
    part = np.where(labels == 1, share, 1 - share) / both[labels]

    def off_by(c: np.ndarray) -> np.ndarray:
        off = (1 / (1 + np.exp(-(c[0] * raw + c[1]))) - labels) * part
        return np.array([(off * raw).sum() + 1e-4 * c[0], off.sum() + 1e-4 * c[1]])

    model.calibration = tuple(_adam(off_by, np.array([4.0, -2.0]), 2000, 0.05))
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of labels.quality from at most sample rows of either label outside the held-out fold."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("g")).filter(
        F.col("g").isin(0, 1) & (fold(F.col("doc_id"), MODULUS) != HELD_OUT)
    )
    totals = checkpoint(marked.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    count = {r["g"]: r["n"] for r in totals.collect()}
    few = bounded_sample(marked, F.col("g"), F.xxhash64("label_id"), sample, totals).select("label_id", "g")
    # Broadcast: at most two times sample ids.
    taught = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "g")
    share = count.get(1, 0) / max(1, sum(count.values()))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)  # a bounded sample
        texts = [t or "" for t in rows["text"]]
        if not any(t.strip() for t in texts):
            return
        m = fit(texts, rows["g"].to_numpy(np.int64), share)
        parts = (m.centre, m.scale, m.w, np.log(m.transition).ravel(), np.array(m.calibration))
        yield pd.DataFrame([{"part": n, "numbers": list(map(float, v))} for n, v in enumerate(parts)])

    one = taught.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    table = {r["part"]: np.array(r["numbers"]) for r in one.mapInPandas(train, "part int, numbers array<double>").collect()}
    if not table:
        return None
    return Model(table[0], table[1], table[2], table[3].reshape(2, 2), tuple(table[4]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from a score of LIMIT).

    A null text counts as empty; a text without lines that hold words gets the score of mean 0. Without
    labels to learn from, every score is 0.5. Labels other than 0 and 1, of unknown or null ids, teach nothing.
    Rows that repeat are each returned. Only doc_id and text are read from docs, doc_id and quality from labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model = shared.value
            found = np.full(len(batch), 0.5) if model is None else model.scores(batch["text"].tolist())
            yield pd.DataFrame({"row": batch["row"], "score": found})

    rows = docs.select(F.col("doc_id").cast("string").alias("row"), "text")
    doc_id = F.col("row").cast(kind)
    return rows.mapInPandas(run, "row string, score double").select(
        doc_id.alias("doc_id"),
        (fold(doc_id, MODULUS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
    )
