"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, pairs of neighbours and pairs with one word between. FTRL-proximal
keeps a learning rate per coordinate and an L1 threshold, so few weights differ from zero; those are
broadcast as two short arrays. The model is fitted in one task on a bounded sample of labelled rows;
scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold
from .langid import bounded_sample, slices

#: Hash buckets (a power of two), sampled rows of either label, passes over the sample.
BUCKETS, SAMPLE, PASSES = 1 << 20, 4000, 5
#: FTRL-proximal's learning rate, smoothing, L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
#: Fold of the rows that nothing is learned from; score from which a text is predicted toxic.
MODULUS, HELD_OUT, LIMIT = 4, 2, 0.3

_WORDLY = np.zeros(256, dtype=bool)
_WORDLY[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True  # digits, lower case, other scripts


def hash_runs(data: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of every run of member bytes; data must end with another byte.

    The hash sums the bytes of a run, each times a power of an odd number that goes by its place.
    """
    edge = np.diff(member.astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return begin, stop, np.zeros(0, dtype=np.uint64)
    chars, length = np.flatnonzero(member), stop - begin
    first = np.cumsum(length) - length
    place = np.arange(len(chars)) - np.repeat(first, length)
    power = np.cumprod(np.concatenate([[1], np.full(int(length.max()), 0x100000001B3)]).astype(np.uint64))
    return begin, stop, np.add.reduceat((data[chars].astype(np.uint64) + np.uint64(1)) * power[place], first)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every word, pair and skip-pair, repeats included."""
    parts = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    begin, _, h = hash_runs(data, _WORDLY[data])
    doc = np.searchsorted(ends, begin, side="right")
    out = [(doc, h)]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[:-gap] == doc[gap:]
        out.append((doc[:-gap][same], (h[:-gap] * np.uint64(salt) + h[gap:] * np.uint64(gap * 2 + 1))[same]))
    docs, hashes = np.concatenate([d for d, _ in out]), np.concatenate([x for _, x in out])
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return docs, (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, passes: int = PASSES, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dense weights (BUCKETS) and bias. rows: distinct buckets of each document; weights: of each document."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(passes):
        for r in rng.permutation(len(rows)):
            at = rows[r]
            zs, ns = z[at], n[at]
            w = weight(zs, ns)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)  # no L1 on the bias
            margin = np.clip(w.sum() + bias, -35, 35)
            g = (1 / (1 + np.exp(-margin)) - labels[r]) * weights[r]
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    return weight(z, n), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


class Model:
    """The nonzero weights: sorted buckets and their values."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray, bias: float):
        self.buckets, self.values, self.bias = buckets, values, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known = [t or "" for t in texts]
        margin = np.full(len(known), self.bias)
        table = np.zeros(BUCKETS, dtype=np.float32)
        table[self.buckets] = self.values
        for a, b in slices(known):
            doc, bucket = features(known[a:b])
            live = table[bucket] != 0  # few are left before repeats are removed
            once = np.unique(doc[live] * BUCKETS + bucket[live])
            margin[a:b] += np.bincount(once // BUCKETS, weights=table[once % BUCKETS].astype(float), minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.toxic from at most sample rows of either label outside the held-out fold."""
    marked = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("g")).filter(
        F.col("g").isin(0, 1) & (fold(F.col("doc_id"), MODULUS) != HELD_OUT)
    )
    totals = checkpoint(marked.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    count = {r["g"]: r["n"] for r in totals.collect()}
    few = bounded_sample(marked, F.col("g"), F.xxhash64("label_id"), sample, totals).select("label_id", "g")
    # Broadcast: at most two times sample ids.
    taught = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "g")
    whole = max(1, sum(count.values()))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, marks = [], []
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in slices(texts):
                doc, bucket = features(texts[a:b])
                once = np.unique(doc * BUCKETS + bucket)
                cuts = np.searchsorted(once // BUCKETS, np.arange(1, b - a))
                rows += np.split((once % BUCKETS).astype(np.int32), cuts)
            marks += batch["g"].tolist()
        if not rows:
            return
        y = np.array(marks, dtype=float)
        seen = {v: max(1, int((y == v).sum())) for v in (0, 1)}
        # The sample is even where the labels are not: the weights restore their shares, up to a common factor.
        share = {v: count.get(v, 0) / whole / (seen[v] / len(y)) for v in (0, 1)}
        w, bias = fit(rows, y, np.where(y == 1, share[1], share[0]))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"bucket": np.append(at, -1), "value": np.append(w[at], bias)})

    # One task for a bounded sample; sorted, so that reruns agree.
    one = taught.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    table = one.mapInPandas(train, "bucket long, value double").toArrow().to_pandas()
    if not len(table):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), -35.0)
    own = table["bucket"] >= 0
    return Model(table.loc[own, "bucket"].to_numpy(np.int64), table.loc[own, "value"].to_numpy(), float(table.loc[~own, "value"].iloc[0]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from a score of LIMIT).

    A null text counts as empty and gets the bias alone, as does a text without words. Without any label to
    learn from, every score is about 0. Labels other than 0 and 1, of unknown or null ids, teach nothing.
    Rows that repeat are each returned. Only doc_id and text are read from docs, doc_id and toxic from labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "score": shared.value.scores(batch["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("string").alias("row"), "text")
    doc_id = F.col("row").cast(kind)
    return rows.mapInPandas(run, "row string, score double").select(
        doc_id.alias("doc_id"),
        (fold(doc_id, MODULUS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
    )
