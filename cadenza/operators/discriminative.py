"""Discriminative training on lattices: posteriors of arcs, numerator less denominator statistics, extended Baum-Welch updates.

A lattice is the arcs of one key, its rows gathered into one; tasks run the recursions over lattices, at once over those
of a batch that have the same arcs; the frames'
statistics are joins and sums of DataFrames, or, where a key's frames lie beside its arcs, are summed where the posteriors
are made, so that no arc and no frame is shuffled or stored; and an update is a column expression over the summed statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import spread

FLOOR = 1e-4
#: Factor of the least damping that keeps variances positive, and damping for each unit of denominator occupancy.
SAFE, DAMP = 2.0, 3.0


def posteriors_of(src: np.ndarray, dst: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lattices of the same arcs (score: lattices, arcs): log totals of all paths from nodes without arcs into them to nodes without arcs out of them, and the log posteriors of the arcs.

    Arcs are taken in a topological order of their nodes; a cycle is an error.
    """
    names, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b, n = place[: len(src)], place[len(src) :], len(names)
    out = [[] for _ in range(n)]
    for i, node in enumerate(a):
        out[node].append(i)
    waiting, order, alpha = np.bincount(b, minlength=n), [], np.full((len(score), n), -np.inf)
    starts = np.flatnonzero(waiting == 0)
    open_ = starts.tolist()
    alpha[:, starts] = 0.0
    while open_:
        node = open_.pop()
        for i in out[node]:
            order.append(i)
            alpha[:, b[i]] = np.logaddexp(alpha[:, b[i]], alpha[:, node] + score[:, i])
            waiting[b[i]] -= 1
            if not waiting[b[i]]:
                open_.append(b[i])
    if len(order) < len(src):
        raise ValueError("a lattice with a cycle")
    beta = np.tile(np.where(np.bincount(a, minlength=n) == 0, 0.0, -np.inf), (len(score), 1))
    for i in reversed(order):
        beta[:, a[i]] = np.logaddexp(beta[:, a[i]], beta[:, b[i]] + score[:, i])
    total = np.logaddexp.reduce(beta[:, starts], axis=1)
    return total, alpha[:, a] + score + beta[:, b] - total[:, None]


def arc_posteriors(arcs: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """key, arc, log_posterior, log_total of every arc (key, arc, src, dst, acoustic, language): acoustic scores are divided by scale.

    Arcs out of and into the same nodes are ways of their own. A null score leaves an arc out of every path, with a null posterior.
    """
    kinds = {c: arcs.schema[c].dataType.simpleString() for c in (key, "arc")}
    score = F.col("acoustic").cast("double") / scale + F.col("language").cast("double")
    each = F.struct("arc", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), score.alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alike: dict = {}  # lattices of the same arcs, and of the same arcs without a score, are worked on at once
            for row, (src, dst, score) in enumerate(zip(batch["src"], batch["dst"], batch["score"], strict=True)):
                alike.setdefault((src.tobytes(), dst.tobytes(), np.isnan(score).tobytes()), []).append(row)
            for rows in alike.values():
                src, dst = batch["src"].iloc[rows[0]], batch["dst"].iloc[rows[0]]
                score = np.stack([batch["score"].iloc[r] for r in rows])
                good = ~np.isnan(score[0])
                total, log = np.full(len(rows), np.nan), np.full(score.shape, np.nan)
                if good.any():
                    total, log[:, good] = posteriors_of(src[good], dst[good], score[:, good])
                names, size = batch[key].iloc[rows].to_numpy().repeat(len(src)), len(src)
                arc = np.concatenate([batch["arc"].iloc[r] for r in rows])
                as_is = lambda v: pd.Series(v, dtype=object if v.dtype.kind == "O" else None)
                yield pd.DataFrame({key: as_is(names), "arc": as_is(arc), "log_posterior": log.ravel(), "log_total": total.repeat(size)})

    lattices = arcs.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("arcs")).select(key, *[F.col(f"arcs.{c}").alias(c) for c in ("arc", "src", "dst", "score")])
    return spread(lattices).mapInPandas(run, f"{key} {kinds[key]}, arc {kinds['arc']}, log_posterior double, log_total double")


def occupancies(posteriors: DataFrame, spans: DataFrame, key: str, least: float = 1e-8) -> DataFrame:
    """key, frame, label, gamma: how far each frame belongs to a label over all arcs, those below least left out.

    spans: key, arc, label, start_frame, end_frame (inclusive) of the labels of each arc.
    """
    joined = spans.join(posteriors.filter(F.col("log_posterior").isNotNull()), [key, "arc"])
    each = joined.select(key, "label", F.exp("log_posterior").alias("p"), F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return each.groupBy(key, "frame", "label").agg(F.sum("p").alias("gamma")).filter(F.col("gamma") >= least)


def label_sums(gammas: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """label, dim, n, s, q: occupancy, weighted sum and sum of squares of the frames (key, frame, vec)."""
    each = gammas.join(frames, [key, "frame"]).select("label", "gamma", F.posexplode("vec").alias("dim", "x"))
    x = F.col("x").cast("double")
    return each.groupBy("label", "dim").agg(F.sum("gamma").alias("n"), F.sum(F.col("gamma") * x).alias("s"), F.sum(F.col("gamma") * x * x).alias("q"))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The elements of all lists one after the other, and the begin and size of each list."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), np.cumsum(sizes) - sizes, sizes


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _numbers(structs: pa.Array, name: str, dtype: type = np.int64) -> np.ndarray:
    """A field as numbers; of floating ones a null is NaN."""
    field = pc.struct_field(structs, name)
    if dtype is np.float64:
        return field.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return field.to_numpy(zero_copy_only=False).astype(dtype)


def _flat_posteriors(begins: np.ndarray, sizes: np.ndarray, src: np.ndarray, dst: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The log posteriors of the arcs of all lattices (one after the other); NaN for those without a score."""
    log = np.full(len(src), np.nan)
    for size in np.unique(sizes[sizes > 0]):
        at = begins[sizes == size][:, None] + np.arange(size)
        kinds, which = np.unique(np.concatenate([src[at], dst[at], np.isnan(score[at])], axis=1), axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        for kind, rows in zip(kinds, np.split(order, np.cumsum(np.bincount(which.ravel()))[:-1]), strict=True):
            good = kind[2 * size :] == 0
            if good.any():
                some = at[rows][:, good]
                log[some] = posteriors_of(kind[:size][good], kind[size : 2 * size][good], score[some])[1]
    return log


def _batch_statistics(batch: pa.RecordBatch, scale: float, least: float) -> Iterator[tuple]:
    """side, label, dim, n, s, q of the lattices of one batch, as lattice_statistics sums them."""
    arcs, arc_at, arc_n = _lists(batch["arcs"])
    frames, frame_at, frame_n = _lists(batch["frames"])
    vecs, vec_at, vec_n = _lists(pc.struct_field(frames, "vec"))
    # Only a null is left out: NaN is a value.
    x, there = vecs.cast(pa.float64()).to_numpy(zero_copy_only=False), pc.is_valid(vecs).to_numpy(zero_copy_only=False)
    score = _numbers(arcs, "acoustic", np.float64) / scale + _numbers(arcs, "language", np.float64)
    p = np.exp(_flat_posteriors(arc_at, arc_n, _numbers(arcs, "src"), _numbers(arcs, "dst"), score))
    label, begin, end = (_numbers(arcs, c) for c in ("label", "start_frame", "end_frame"))
    numerator, lattice = _numbers(arcs, "numerator", bool), np.repeat(np.arange(len(arc_n)), arc_n)
    dims = int(vec_n.max(initial=0))
    for side, mask in (("num", numerator), ("den", np.ones(len(p), dtype=bool))):
        kept = np.flatnonzero(mask & ~np.isnan(p) & (end >= begin))
        arc = np.repeat(kept, (end - begin + 1)[kept])
        frame, of = _ranges(begin[kept], (end - begin + 1)[kept]), lattice[arc]
        inside = (frame >= 0) & (frame < frame_n[of])
        arc, frame = arc[inside], (frame_at[of] + frame)[inside]
        labels, named = np.unique(label[arc], return_inverse=True)
        pair, which = np.unique(frame * max(len(labels), 1) + named, return_inverse=True)
        gamma = np.bincount(which, p[arc], len(pair))
        pair, gamma = pair[gamma >= least], gamma[gamma >= least]
        frame, named = np.divmod(pair, max(len(labels), 1))
        value = _ranges(vec_at[frame], vec_n[frame])
        cell = np.repeat(named, vec_n[frame]) * dims + _ranges(np.zeros_like(frame), vec_n[frame])
        weight, v = np.repeat(gamma, vec_n[frame]), np.where(there[value], x[value], 0.0)
        sums = [np.bincount(cell, w, len(labels) * dims) for w in (weight, weight * v, weight * v * v)]
        for c in np.unique(cell):
            yield side, int(labels[c // dims]), int(c % dims), *(float(w[c]) for w in sums)
    labels, named = np.unique(_numbers(frames, "label"), return_inverse=True)
    cell = (np.repeat(named, vec_n) * dims + _ranges(np.zeros_like(vec_n), vec_n))[there]
    n = np.bincount(cell, minlength=len(labels) * dims)
    mean = np.bincount(cell, x[there], len(n)) / np.maximum(n, 1)
    off = np.bincount(cell, (x[there] - mean[cell]) ** 2, len(n))
    for c in np.flatnonzero(n):
        yield "all", int(labels[c // dims]), int(c % dims), float(n[c]), float(mean[c]), float(off[c])


def lattice_statistics(lattices: DataFrame, scale: float = 1.0, least: float = 1e-8) -> DataFrame:
    """side, label, dim, n, s, q of all lattices, whose rows hold a key's arcs and frames.

    arcs: array of src, dst, acoustic, language as in arc_posteriors, label, start_frame, end_frame (inclusive) as in
    occupancies, numerator; frames: array of label, vec, by their numbers. Sides num (of the numerator's arcs) and den (of
    all) are what label_sums gives of the occupancies; side all has the number, mean and sum of squares about it of the frames
    of each label. Each batch of a task gives a few sums; sides num and den are added up, side all has a row for each batch.
    """
    names = ["side", "label", "dim", "n", "s", "q"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*_batch_statistics(batch, scale, least), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    return lattices.select("arcs", "frames").mapInArrow(run, "side string, label long, dim int, n double, s double, q double")


def side_sums(statistics: DataFrame, side: str) -> DataFrame:
    """label, dim, n, s, q: one side of lattice_statistics added up, as label_sums has them."""
    return statistics.filter(F.col("side") == side).groupBy("label", "dim").agg(*[F.sum(c).alias(c) for c in "nsq"])


def frame_moments(statistics: DataFrame) -> DataFrame:
    """label, dim, mean, var of all frames, from the parts that lattice_statistics gives."""
    parts = statistics.filter("side = 'all'").select("label", "dim", "n", F.col("s").alias("part"), "q")
    means = parts.groupBy("label", "dim").agg((F.sum(F.col("n") * F.col("part")) / F.sum("n")).alias("mean"))
    off = F.col("part") - F.col("mean")
    return parts.join(means, ["label", "dim"]).groupBy("label", "dim", "mean").agg((F.sum(F.col("q") + F.col("n") * off * off) / F.sum("n")).alias("var"))


def _largest_root(x: Column, y: Column, z: Column) -> Column:
    """The largest real root of x d^2 + y d + z; a slightly negative discriminant counts as 0; null without a root."""
    inside = y * y - 4 * x * z
    nearly = F.when((inside < 0) & (y != 0) & (F.abs(inside / (y * y)) < 1e-4), 0.0).when(inside >= 0, inside)
    both = F.greatest((F.sqrt(nearly) - y) / (2 * x), (-F.sqrt(nearly) - y) / (2 * x))
    return F.when(x == 0, F.when(y != 0, -z / y)).otherwise(both)


def updated(model: DataFrame, numerator: DataFrame, denominator: DataFrame, label: str = "label", damp: float = DAMP, floor: float = FLOOR) -> DataFrame:
    """label, dim, mean, var, damping: Gaussians moved towards the numerator and away from the denominator statistics.

    model: label, dim, mean, var; statistics as label_sums gives them. A label's damping is the largest that one of its
    dimensions needs: twice the point from which its variance stays positive, at least damp times its denominator occupancy.
    A label without statistics, or whose damped occupancy isn't positive, stays as it is. Variances are floored.
    """
    side = lambda df, p: df.select(label, "dim", *[F.col(c).alias(f"{p}_{c}") for c in "nsq"])
    joined = model.join(side(numerator, "num"), [label, "dim"], "left").join(side(denominator, "den"), [label, "dim"], "left")
    less = lambda c: F.coalesce(F.col(f"num_{c}"), F.lit(0.0)) - F.coalesce(F.col(f"den_{c}"), F.lit(0.0))
    known = joined.select(label, "dim", "mean", "var", F.coalesce("den_n", F.lit(0.0)).alias("den"), less("n").alias("n"), less("s").alias("s"), less("q").alias("q"))
    power = F.col("var") + F.col("mean") * F.col("mean")
    root = _largest_root(F.col("var"), power * F.col("n") + F.col("q") - 2 * F.col("mean") * F.col("s"), F.col("q") * F.col("n") - F.col("s") * F.col("s"))
    needed = F.greatest(F.coalesce(root, F.lit(0.0)) * SAFE, damp * F.col("den"), F.lit(0.0))
    damping = known.withColumn("d", needed).groupBy(label).agg(F.max("d").alias("damping"))
    whole = F.col("n") + F.col("damping")
    mean = F.when(whole > 0, (F.col("s") + F.col("damping") * F.col("mean")) / whole).otherwise(F.col("mean"))
    moved = known.join(damping, label).withColumn("new", mean)
    var = F.when(whole > 0, (F.col("q") + F.col("damping") * power) / whole - F.col("new") * F.col("new")).otherwise(F.col("var"))
    return moved.select(label, "dim", F.col("new").alias("mean"), F.greatest(var, F.lit(floor)).alias("var"), "damping")
