"""Adaptation of means by classes: regression classes, one linear transform for each class and stream, its inverse, tied starts.

Everything works on a model's accumulators (one row a Gaussian), which passes over frames have summed. Each task adds
the normal equations of its rows up by class before they are shuffled, so a class costs one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-5


def regression_classes(model: DataFrame, by: list[str], levels: int) -> DataFrame:
    """model with class: Gaussians (n, mean array) split in two, levels times over, where their means differ most.

    In each class the dimension of the largest count-weighted variance of means is taken (ties: the lowest), and the
    means above the class's weighted mean go to the upper half: class 2 c + 1, the others to 2 c. Classes may stay whole
    where all means are equal. Gaussians without a count follow the others' borders.
    """
    now = model.withColumn("class", F.lit(0).cast("long"))
    for _ in range(levels):
        each = now.filter(F.col("n") > 0).select("class", "n", F.posexplode("mean").alias("d", "m"))
        n, s = F.sum("n"), F.sum(F.col("n") * F.col("m"))
        spread = each.groupBy("class", "d").agg((s / n).alias("border"), (F.sum(F.col("n") * F.col("m") * F.col("m")) / n - (s / n) * (s / n)).alias("spread"))
        cut = spread.groupBy("class").agg(F.max_by(F.struct("d", "border"), F.struct("spread", -F.col("d"))).alias("cut"))
        upper = F.coalesce(F.get("mean", F.col("cut.d")) > F.col("cut.border"), F.lit(False)).cast("long")
        now = now.join(cut, "class", "left").withColumn("class", F.col("class") * 2 + upper).drop("cut")
    return now.select(*model.columns, "class")


def _parts(kind: str) -> tuple[bool, bool]:
    if kind not in ("affine", "scale", "shift"):
        raise ValueError(f"no transform {kind}")
    return kind != "shift", kind != "scale"


def transforms(accumulators: DataFrame, kind: str = "affine", floor: float = FLOOR) -> DataFrame:
    """class, stream, a (rows), b: the transform of the means that makes the adaptation data likeliest.

    accumulators: class, stream, mean and var (arrays), n (occupancy) and sums (occupancy-weighted observations) of each
    Gaussian. kind: affine, scale (b is 0) or shift (a is the identity). Variances count as floor at least. Gaussians
    without occupancy add nothing; a class without any has the identity. Where the data leave a transform open, the smallest one that fits is taken.
    """
    scale, shift = _parts(kind)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for c, stream, mean, var, n, seen in batch.itertuples(index=False):
                mean, seen = np.array(mean, dtype=float), np.array(seen, dtype=float)
                weight = 1 / np.maximum(np.array(var, dtype=float), floor)
                e = np.concatenate([mean, [1.0]])
                if (c, stream) not in sums:
                    sums[c, stream] = [np.zeros((len(mean), len(e), len(e))), np.zeros((len(mean), len(e)))]
                if n > 0:
                    sums[c, stream][0] += (n * weight)[:, None, None] * np.outer(e, e)
                    sums[c, stream][1] += (weight * seen)[:, None] * e
        rows = [(c, s, len(k), g.tobytes(), k.tobytes()) for (c, s), (g, k) in sums.items()]
        yield pd.DataFrame(rows, columns=["class", "stream", "dim", "g", "k"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        g = sum(np.frombuffer(x).reshape(dim, dim + 1, dim + 1) for x in rows["g"])
        k = sum(np.frombuffer(x).reshape(dim, dim + 1) for x in rows["k"])
        a, b = np.eye(dim), np.zeros(dim)
        for d in range(dim):
            if not g[d].any():
                continue
            if scale and shift:
                row = np.linalg.lstsq(g[d], k[d], rcond=1e-12)[0]
                a[d], b[d] = row[:-1], row[-1]
            elif scale:
                a[d] = np.linalg.lstsq(g[d][:-1, :-1], k[d][:-1], rcond=1e-12)[0]
            else:
                b[d] = (k[d][-1] - g[d][-1, d]) / g[d][-1, -1]
        return pd.DataFrame({"class": [rows["class"].iloc[0]], "stream": [rows["stream"].iloc[0]], "a": [a.tolist()], "b": [b.tolist()]})

    names = accumulators.select(F.col("class").cast("long").alias("class"), F.col("stream").cast("int").alias("stream"), "mean", "var", F.col("n").cast("double").alias("n"), "sums")
    part = names.mapInPandas(equations, "class long, stream int, dim int, g binary, k binary")
    return part.groupBy("class", "stream").applyInPandas(solve, "class long, stream int, a array<array<double>>, b array<double>")


def adapted(model: DataFrame, found: DataFrame) -> DataFrame:
    """model (class, stream, mean and more) with the means a m + b of their classes; classes without a transform stay as they are."""
    dot = lambda row, m: F.aggregate(F.zip_with(row, m, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    moved = F.zip_with(F.transform("a", lambda row: dot(row, F.col("mean"))), F.col("b"), lambda x, y: x + y)
    joined = model.join(found, ["class", "stream"], "left")
    return joined.withColumn("mean", F.coalesce(moved, F.col("mean"))).select(*model.columns)


def inverse(found: DataFrame) -> DataFrame:
    """The transforms that undo those found; a singular one is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                back = np.linalg.inv(np.array([list(r) for r in a]))
                pairs.append((back.tolist(), (-back @ np.array(b)).tolist()))
            yield batch[["class", "stream"]].assign(a=[p[0] for p in pairs], b=[p[1] for p in pairs])

    return found.select("class", "stream", "a", "b").mapInPandas(run, "class long, stream int, a array<array<double>>, b array<double>")


def averaged_sources(parameters: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Parameters (key, place, value) of new tied states: the mean of those of the states that map to each (src, dst).

    A target that only maps to states without parameters has no row; a source may serve several targets, and once each.
    """
    pairs = mapping.select(F.col("src").alias(key), "dst").distinct()
    return parameters.join(pairs, key).groupBy("dst", "place").agg(F.avg("value").alias("value")).withColumnRenamed("dst", key)


def class_lines(classes: DataFrame, place: str, cls: str) -> DataFrame:
    """line_no, line: the class of each codebook as text, in the order of place; -1 where a codebook has none."""
    line = Window.orderBy(place)  # one row a codebook
    return classes.select((F.row_number().over(line) - 1).alias("line_no"), F.coalesce(F.col(cls), F.lit(-1)).cast("string").alias("line"))


def read_classes(lines: DataFrame, classes: int) -> DataFrame:
    """cb, class of such lines (line_no, line); anything but -1 or a class below classes is an error."""
    number = F.trim("line")
    value = number.try_cast("long")
    good = number.rlike("^-?[0-9]+$") & (value >= -1) & (value < classes)
    checked = F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit("no class: "), F.coalesce("line", F.lit("")))).cast("long"))
    return lines.select(F.col("line_no").alias("cb"), checked.alias("class"))
