"""Diagonal Gaussian statistics, distances and updates over plain tables.

Frames are rows (keys, dim, x); models are rows (keys, dim, mean, var, ...). Everything is grouping,
joining on keys and column expressions, so partial aggregation keeps the shuffles at the size of the
model, not of the frames.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

FLOOR = 1e-4


def frames(vectors: DataFrame, keys: Sequence[str], vec: str, first: int | None = None) -> DataFrame:
    """keys, dim, x: one row per component, as double; only the first components if so told."""
    v = F.col(vec) if first is None else F.slice(vec, 1, first)
    return vectors.select(*keys, F.posexplode(v).alias("dim", "raw")).select(*keys, "dim", F.col("raw").cast("double").alias("x"))


def estimate(dims: DataFrame, by: Sequence[str], floor: float | None = FLOOR) -> DataFrame:
    """by, dim, n, mean, var (population), floored."""
    var = F.var_pop("x")
    return dims.groupBy(*by, "dim").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (var if floor is None else F.greatest(var, F.lit(floor))).alias("var")
    )


def two_pass(dims: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, dim, n, mean, var: the squared deviations from the mean of a first pass."""
    means = dims.groupBy(*by, "dim").agg(F.avg("x").alias("mean"))
    off = F.col("x") - F.col("mean")
    return dims.join(means, [*by, "dim"]).groupBy(*by, "dim").agg(
        F.count("x").alias("n"), F.first("mean").alias("mean"), F.avg(off * off).alias("var")
    )


def full_covariance(vectors: DataFrame, by: Sequence[str], vec: str, width: int) -> DataFrame:
    """by, i, j, cov for i <= j below width, from one pass over the vectors."""
    v = F.transform(F.slice(vec, 1, width), lambda x: x.cast("double"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(width) for j in range(i, width)])
    each = vectors.select(*by, v.alias("v"), F.explode(pairs).alias("p"))
    x, y = F.get("v", F.col("p.i")), F.get("v", F.col("p.j"))
    return each.select(*by, "p.i", "p.j", x.alias("x"), y.alias("y")).groupBy(*by, "i", "j").agg(F.covar_pop("x", "y").alias("cov"))


def collapse(mixture: DataFrame, by: Sequence[str], weight: str = "weight") -> DataFrame:
    """by, dim, mean, var of a mixture as one Gaussian (law of total variance); weights of a group sum to 1."""
    w, m, v = F.col(weight), F.col("mean"), F.col("var")
    return mixture.groupBy(*by, "dim").agg(F.sum(w * m).alias("mean"), F.sum(w * (v + m * m)).alias("second")).select(
        *by, "dim", "mean", (F.col("second") - F.col("mean") * F.col("mean")).alias("var")
    )


def pairs(model: DataFrame, key: str) -> DataFrame:
    """a, b, dim and both sides' means and variances of every unordered pair of models, joined by dimension."""
    left = model.select(F.col(key).alias("a"), "dim", F.col("mean").alias("ma"), F.col("var").alias("va"))
    right = model.select(F.col(key).alias("b"), "dim", F.col("mean").alias("mb"), F.col("var").alias("vb"))
    return left.join(right, "dim").filter("a < b")


def distances(model: DataFrame, key: str) -> DataFrame:
    """a, b and their Bhattacharyya, KL (both ways and their sum), Mahalanobis, Euclidean and cosine measures."""
    d = F.col("ma") - F.col("mb")
    va, vb = F.col("va"), F.col("vb")
    both = (va + vb) / 2
    kl = lambda v, w: 0.5 * F.sum(F.log(w / v) + v / w + d * d / w - 1)
    norm_a, norm_b = F.sqrt(F.sum(F.col("ma") * F.col("ma"))), F.sqrt(F.sum(F.col("mb") * F.col("mb")))
    return pairs(model, key).groupBy("a", "b").agg(
        F.sum(d * d / both / 8 + 0.5 * F.log(both / F.sqrt(va * vb))).alias("bhattacharyya"),
        kl(va, vb).alias("kl_ab"),
        kl(vb, va).alias("kl_ba"),
        (kl(va, vb) + kl(vb, va)).alias("kl_sum"),
        F.sqrt(F.sum(d * d / both)).alias("mahalanobis"),
        F.sqrt(F.sum(d * d)).alias("euclidean"),
        F.when((norm_a > 0) & (norm_b > 0), F.sum(F.col("ma") * F.col("mb")) / (norm_a * norm_b)).otherwise(0.0).alias("cosine"),
    )


def as_arrays(model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, mean and var as arrays in the order of dimensions."""
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean", "var")))
    return model.groupBy(*keys).agg(ordered.alias("p")).select(*keys, F.col("p.mean").alias("mean"), F.col("p.var").alias("var"))


def log_density(vec: Column, mean: Column, var: Column) -> Column:
    """Log of a diagonal Gaussian at vec; arrays of one length."""
    parts = F.zip_with(F.zip_with(vec, mean, lambda x, m: (x - m) * (x - m)), var, lambda q, v: q / v + F.log(v * 6.283185307179586))
    return -0.5 * F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def densities(vectors: DataFrame, model: DataFrame, key: str, vec: str) -> DataFrame:
    """Every vector against every density of the codebook: the columns of vectors but vec, key, ll.

    The model is one row with all densities; Spark broadcasts it while small enough, else hashes it.
    """
    book = as_arrays(model, [key]).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "mean", "var"))).alias("book"))
    v = F.transform(vec, lambda x: x.cast("double"))
    each = F.transform("book", lambda d: F.struct(d["k"].alias(key), log_density(F.col("v"), d["mean"], d["var"]).alias("ll")))
    keep = [c for c in vectors.columns if c not in (vec, key)]
    return vectors.select(*keep, v.alias("v")).crossJoin(book).select(*keep, F.inline(each))


def top_n(scores: DataFrame, by: Sequence[str], n: int, key: str = "label") -> DataFrame:
    """The n densities of highest ll for each frame, ties to the lower key; rank from 1."""
    listed = scores.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("ll")).alias("loss"), key))).alias("s"))
    best = F.slice("s", 1, n)
    each = listed.select(*by, F.posexplode(best).alias("r", "s"))
    return each.select(*by, (F.col("r") + 1).alias("rank"), F.col(f"s.{key}").alias(key), (-F.col("s.loss")).alias("ll"))


def responsibilities(vectors: DataFrame, model: DataFrame, key: str, vec: str, cut: float | None = None) -> DataFrame:
    """The columns of vectors but vec and key; v, lp (log of the mean density), key, gamma of every density: no shuffle.

    All scores of a frame stay in its row: exp(ll - best) over its sum, densities more than cut below the best 0.
    """
    book = as_arrays(model, [key]).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "mean", "var"))).alias("book"))
    keep = [c for c in vectors.columns if c not in (vec, key)]
    scored = vectors.select(*keep, F.transform(vec, lambda x: x.cast("double")).alias("v")).crossJoin(book)
    ll = F.transform("book", lambda d: log_density(F.col("v"), d["mean"], d["var"]))
    scored = scored.select(*keep, "v", F.transform("book", lambda d: d["k"]).alias("ks"), ll.alias("ll")).withColumn("best", F.array_max("ll"))
    whole = F.aggregate(F.transform("ll", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, x: a + x)
    low = F.lit(False) if cut is None else None
    e = F.transform("ll", lambda x: F.when(low if cut is None else x < F.col("best") - cut, 0.0).otherwise(F.exp(x - F.col("best"))))
    scored = scored.withColumn("lp", F.log(whole / F.size("ll")) + F.col("best")).withColumn("e", e)
    scored = scored.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return scored.select(*keep, "v", "lp", F.inline(F.arrays_zip(F.col("ks").alias(key), F.transform("e", lambda x: x / F.col("total")).alias("gamma"))))


def accumulate(gammas: DataFrame, key: str) -> DataFrame:
    """key, dim, occ, sum_x, sum_xx: posterior-weighted sums of rows (v, key, gamma), combined before the one shuffle."""
    g, x = F.col("gamma"), F.col("x")
    each = gammas.filter("gamma > 0").select(key, "gamma", F.posexplode("v").alias("dim", "x"))
    return each.groupBy(key, "dim").agg(F.sum(g).alias("occ"), F.sum(g * x).alias("sum_x"), F.sum(g * x * x).alias("sum_xx"))


def split(model: DataFrame, key: str, n_inc: int, spread: float = 0.2) -> DataFrame:
    """The n_inc densities of highest count (ties: lowest key) become two: mean +- spread std, half the count.

    key, part (0 kept or minus, 1 plus), dim, n, mean, var. Unsplit densities have part 0 only.
    """
    chosen = model.select(key, "n").distinct().orderBy(F.desc("n"), key).limit(n_inc).select(key, F.lit(True).alias("chosen"))
    marked = model.join(chosen, key, "left")
    parts = F.when(F.col("chosen"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sign = F.when(F.col("chosen").isNull(), 0.0).when(F.col("part") == 0, -1.0).otherwise(1.0)
    return marked.withColumn("part", F.explode(parts)).select(
        key, "part", "dim",
        F.when(F.col("chosen"), F.col("n") / 2).otherwise(F.col("n").cast("double")).alias("n"),
        (F.col("mean") + sign * spread * F.sqrt("var")).alias("mean"), "var",
    )


def nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """vectors (..., v) with k and d2: the centre (k, dim, c) of least squared distance, ties to the lowest k; no shuffle.

    The centres, of the model's size, are one row that every vector meets.
    """
    arrays = centres.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("cs")).select("k", F.col("cs.c").alias("c"))
    book = arrays.agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("book"))
    far = lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    best = F.array_min(F.transform("book", lambda b: F.struct(far(b["c"]).alias("d2"), b["k"].alias("k"))))
    return vectors.crossJoin(book).withColumn("best", best).select(*vectors.columns, F.col("best.k").alias("k"), F.col("best.d2").alias("d2"))


def kmeans(vectors: DataFrame, centres: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """Lloyd steps over vectors (..., v): the centres (k, dim, c) after the last one, and the assignment it was made from."""
    assigned = None
    for _ in range(steps):
        assigned = nearest(vectors, centres)
        centres = assigned.select("k", F.posexplode("v").alias("dim", "x")).groupBy("k", "dim").agg(F.avg("x").alias("c"))
    return centres, assigned


def kmeans_converged(vectors: DataFrame, centres: DataFrame, least: float = 1e-3, most: int = 100) -> tuple[DataFrame, list[dict]]:
    """Lloyd steps until the squared error falls by at most the share least of the one before, or most of them: centres and telemetry.

    The centres are those of the last assignment. The telemetry has step (moves of the centres so far), error and fell
    (the relative fall; null for the first). A cluster that no vector chooses is an error. Vectors are read once:
    a step is one pass over the different ones with their numbers, and one row a cluster comes to the driver.
    """
    telemetry, names = [], {r["k"] for r in centres.select("k").distinct().collect()}
    different = cut(vectors.groupBy("v").agg(F.count(F.lit(1)).alias("w")))
    while True:
        dims = F.transform("v", lambda x, i: F.struct(i.alias("dim"), x.alias("x")))
        # The error stands beside the dimensions of a cluster, so that one aggregation gives both.
        error_too = F.concat(dims, F.array(F.struct(F.lit(-1).alias("dim"), F.col("d2").alias("x"))))
        each = nearest(different, centres).select("k", "w", F.explode(error_too).alias("e"))
        sums = cut(each.groupBy("k", "e.dim").agg(F.sum(F.col("e.x") * F.col("w")).alias("s"), F.sum("w").alias("n")))
        errors = {r["k"]: r["s"] for r in sums.filter("dim = -1").collect()}
        if names - errors.keys():
            raise ValueError(f"empty clusters: {sorted(names - errors.keys())}")
        error, before = sum(errors[k] for k in sorted(errors)), telemetry[-1]["error"] if telemetry else None
        fell = None if before is None else (before - error) / before if before else 0.0
        telemetry.append({"step": len(telemetry), "error": error, "fell": fell})
        if (fell is not None and fell <= least) or len(telemetry) > most:
            return centres, telemetry
        centres = sums.filter("dim >= 0").select("k", "dim", (F.col("s") / F.col("n")).alias("c"))


def adapt(prior: DataFrame, data: DataFrame, key: str, tau: float = 10.0) -> DataFrame:
    """MAP and Bayes means and the MAP variance of data (key, dim, n, mean, var) under a prior of the same form."""
    p = prior.select(key, "dim", F.col("mean").alias("m0"), F.col("var").alias("v0"))
    n, m, v, m0, v0 = F.col("n"), F.col("mean"), F.col("var"), F.col("m0"), F.col("v0")
    new = (tau * m0 + n * m) / (tau + n)
    return p.join(data, [key, "dim"]).select(
        key, "dim", new.alias("map_mean"),
        ((v0 * n * m + v * m0) / (v0 * n + v)).alias("bayes_mean"),
        F.greatest((tau * (v0 + (m0 - new) * (m0 - new)) + n * (v + (m - new) * (m - new))) / (tau + n), F.lit(FLOOR)).alias("map_var"),
    )


def transform_means(model: DataFrame, key: str, matrix: Sequence[Sequence[float]], offset: Sequence[float]) -> DataFrame:
    """key, dim, mean: A mean + b; the matrix is small and becomes literals of the plan."""
    arrays = as_arrays(model, [key])
    rows = [
        sum((F.get("mean", F.lit(j)) * float(a) for j, a in enumerate(row)), F.lit(float(b)))
        for row, b in zip(matrix, offset, strict=True)
    ]
    return arrays.select(key, F.posexplode(F.array(*rows)).alias("dim", "mean"))


def project(vectors: DataFrame, keys: Sequence[str], vec: str, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """keys, y: the product of a small matrix with the first components of each vector."""
    part = lambda j: F.get(vec, F.lit(j)).cast("double")
    rows = [sum((part(j) * float(a) for j, a in enumerate(row)), F.lit(0.0)) for row in matrix]
    return vectors.select(*keys, F.array(*rows).alias("y"))


def subvectors(vectors: DataFrame, keys: Sequence[str], vec: str, streams: Sequence[Sequence[int]]) -> DataFrame:
    """keys, stream, y: the listed components of each stream."""
    parts = [F.struct(F.lit(n).alias("stream"), F.array(*[F.get(vec, F.lit(i)).cast("double") for i in s]).alias("y")) for n, s in enumerate(streams)]
    return vectors.select(*keys, F.inline(F.array(*parts)))


def array_statistics(dims: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, lowest, highest, mean, std (population), percent of zeros and of ones."""
    return dims.groupBy(*by).agg(
        F.min("x").alias("lowest"), F.max("x").alias("highest"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        (F.avg((F.col("x") == 0).cast("double")) * 100).alias("zeros"), (F.avg((F.col("x") == 1).cast("double")) * 100).alias("ones"),
    )


def compare_arrays(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """One row: max and mean absolute difference, where the greatest is (first key), and whether all are close."""
    y = b.select(*keys, F.col("x").alias("y"))
    off = F.abs(F.col("x") - F.col("y"))
    joined = a.join(y, list(keys)).withColumn("off", off)
    return joined.agg(
        F.max("off").alias("max_abs"), F.avg("off").alias("mean_abs"),
        F.max_by(F.struct(*keys), F.struct("off", *[(-F.col(k)).alias(f"n_{k}") for k in keys])).alias("at"),
        F.bool_and(F.col("off") <= atol + rtol * F.abs("y")).alias("all_close"),
    ).select("max_abs", "mean_abs", "at.*", "all_close")


def percentile_floor(variances: DataFrame, bins: int, share: float) -> DataFrame:
    """dim, floor: the upper edge of the histogram bin where the share of all variances is first exceeded.

    The histogram is of the positive variances; the share is of all, so that where it isn't reached the floor
    is one bin above the highest. Dimensions without positive variances are left out.
    """
    positive = variances.filter(F.col("var") > 0).select("dim", "var")
    own = F.when(F.col("var") > 0, F.col("var"))
    span = variances.groupBy("dim").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.count(F.lit(1)).alias("n")).filter("low IS NOT NULL")
    width = (F.col("high") - F.col("low")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor(F.when(width > 0, (F.col("var") - F.col("low")) / width).otherwise(0.0)).cast("int"))
    counted = positive.join(span, "dim").select("dim", "low", "high", "n", bin_.alias("bin")).groupBy("dim", "low", "high", "n", "bin").agg(F.count(F.lit(1)).alias("c"))
    # At most bins rows a dimension are ranged over.
    line = F.sum("c").over(_line("dim", "bin"))
    over = counted.withColumn("sum", line)
    first = F.coalesce(F.min(F.when(F.col("sum") > share * F.col("n"), F.col("bin"))), F.lit(bins))
    return over.groupBy("dim", "low", "high").agg(first.alias("bin")).select(
        "dim", (F.col("low") + (F.col("bin") + 1) * (F.col("high") - F.col("low")) / bins).alias("floor")
    )


def compare_models(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """One row a component: keys, verdict (equal, close, differs, only left, only right), max_abs of rows (keys, dim, x)."""
    left = a.select(*keys, "dim", F.col("x").alias("l"), F.lit(True).alias("in_l"))
    right = b.select(*keys, "dim", F.col("x").alias("r"), F.lit(True).alias("in_r"))
    both = left.join(right, [*keys, "dim"], "full_outer")
    off = F.abs(F.col("l") - F.col("r"))
    summed = both.groupBy(*keys).agg(
        F.count("in_l").alias("n_l"), F.count("in_r").alias("n_r"), F.count(F.lit(1)).alias("n"), F.max(off).alias("max_abs"),
        F.bool_and(F.coalesce(F.col("l") == F.col("r"), F.lit(False))).alias("same"), F.bool_and(F.coalesce(off <= atol + rtol * F.abs("r"), F.lit(False))).alias("near"),
    )
    verdict = F.when(F.col("n_r") == 0, "only left").when(F.col("n_l") == 0, "only right").when(F.col("same"), "equal").when(F.col("near"), "close").otherwise("differs")
    return summed.select(*keys, verdict.alias("verdict"), "max_abs")


def paired_distances(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, bhattacharyya, mahalanobis of each density of a against that of the same key in b (key, dim, mean, var)."""
    other = b.select(key, "dim", F.col("mean").alias("mb"), F.col("var").alias("vb"))
    d, both = F.col("mean") - F.col("mb"), (F.col("var") + F.col("vb")) / 2
    return a.join(other, [key, "dim"]).groupBy(key).agg(
        F.sum(d * d / both / 8 + 0.5 * F.log(both / F.sqrt(F.col("var") * F.col("vb")))).alias("bhattacharyya"), F.sqrt(F.sum(d * d / both)).alias("mahalanobis")
    )


def distance_summary(distances_: DataFrame, measure: str) -> DataFrame:
    """One row: n, mean, highest, lowest and population std of a measure."""
    return distances_.agg(
        F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.max(measure).alias("highest"), F.min(measure).alias("lowest"), F.stddev_pop(measure).alias("std")
    )


def most_different(distances_: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The n keys of greatest measure, ties to the lower key: a report of fixed length."""
    return distances_.orderBy(F.desc(measure), key).limit(n)


def log_density_full(vectors: DataFrame, model: DataFrame, key: str, vec: str) -> DataFrame:
    """The columns of vectors but vec, key, ll under full-covariance Gaussians (key, mean array, cov array of rows).

    The model, of its own size, is one row beside every vector; a singular covariance gives minus infinity.
    """
    book = model.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "mean", "cov"))).alias("book"))
    kind = model.schema[key].dataType.simpleString()

    @F.pandas_udf(f"array<struct<{key}:{kind},ll:double>>")
    def score(vec: pd.Series, book: pd.Series) -> pd.Series:
        out, known = [], None
        for v, b in zip(vec, book, strict=True):
            if known is None:  # the same model in every row
                known = []
                for g in b:
                    cov = np.array([list(r) for r in g["cov"]], dtype=float)
                    sign, size = np.linalg.slogdet(cov)
                    known.append((g["k"], np.array(g["mean"], dtype=float), np.linalg.inv(cov) if sign > 0 else None, size))
            x, row = np.asarray(v, dtype=float), []
            for k, mean, inverse, size in known:
                d = x - mean
                row.append({key: k, "ll": float("-inf") if inverse is None else float(-0.5 * (d @ inverse @ d + size + len(d) * np.log(2 * np.pi)))})
            out.append(row)
        return pd.Series(out)

    keep = [c for c in vectors.columns if c not in (vec, key)]
    v = F.transform(vec, lambda x: x.cast("double"))
    return vectors.select(*keep, v.alias("v")).crossJoin(book).select(*keep, F.inline(score("v", "book")))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row (rows at most columns) in the one-to-one matching of least sum.

    Rows enter one by one; each is placed along the cheapest chain of rows that give way, found by growing the
    reached columns with reduced costs (dual prices keep those of matched pairs at zero). Cubic time.
    """
    rows, columns = cost.shape
    price_row, price_column = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for new in range(rows):
        least, via = np.full(columns, np.inf), np.full(columns, -1)
        done, row, end = np.zeros(columns, dtype=bool), new, -1
        reached, base = [(new, -1)], 0.0
        while end < 0:
            way = base + cost[row] - price_row[row] - price_column
            better = ~done & (way < least)
            least[better], via[better] = way[better], row
            column = int(np.where(done, np.inf, least).argmin())
            base, done[column] = least[column], True
            if owner[column] < 0:
                end = column
            else:
                row = owner[column]
                reached.append((row, column))
        for r, c in reached:
            price_row[r] += base - (least[c] if c >= 0 else 0.0)
        inside = done & (least < base)
        price_column[inside] -= base - least[inside]
        while end >= 0:  # hand the columns over along the chain
            r = int(via[end])
            at = np.flatnonzero(owner == r)
            owner[end] = r
            end = int(at[0]) if r != new else -1
    out = np.empty(rows, dtype=int)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def matched_components(a: DataFrame, b: DataFrame, by: str, floor: float = 1e-6) -> DataFrame:
    """by, a, b, cost: the one-to-one matching of the densities of two mixtures with the least sum of Bhattacharyya distances.

    a and b: by, component, dim, mean, var (not below floor); the larger side's rest stays unmatched. A group's
    table has one number for each pair of components.
    """
    at_least = lambda c: F.greatest(F.col(c), F.lit(floor))
    left = a.select(by, F.col("component").alias("a"), "dim", F.col("mean").alias("ma"), at_least("var").alias("va"))
    right = b.select(by, F.col("component").alias("b"), "dim", F.col("mean").alias("mb"), at_least("var").alias("vb"))
    d, both = F.col("ma") - F.col("mb"), (F.col("va") + F.col("vb")) / 2
    costs = left.join(right, [by, "dim"]).groupBy(by, "a", "b").agg(F.sum(d * d / both / 8 + 0.5 * F.log(both / F.sqrt(F.col("va") * F.col("vb")))).alias("cost"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in costs.schema)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="a", columns="b", values="cost").sort_index().sort_index(axis=1)
        turned = table.shape[0] > table.shape[1]
        cost = table.to_numpy().T if turned else table.to_numpy()
        picked = assignment(cost)
        pairs = [(c, r) if turned else (r, c) for r, c in enumerate(picked)]
        return pd.DataFrame([(rows[by].iloc[0], table.index[x], table.columns[y], table.iat[x, y]) for x, y in pairs], columns=[by, "a", "b", "cost"])

    return costs.groupBy(by).applyInPandas(match, schema)


def matched_summary(matched: DataFrame, by: str) -> DataFrame:
    """by, mean_distance, max_distance, min_distance, n of the matched densities."""
    return matched.groupBy(by).agg(F.avg("cost").alias("mean_distance"), F.max("cost").alias("max_distance"), F.min("cost").alias("min_distance"), F.count(F.lit(1)).alias("n"))


def monte_carlo_kl(a: DataFrame, b: DataFrame, samples: int = 10_000, seed: int = 7, floor: float = 1e-6, block: int = 1024) -> DataFrame:
    """One row, kl: the mean of ln a(x) - ln b(x) over samples of the mixture a; mixtures are rows (component, weight, mean array, var array).

    Densities of weight 0 take no part, and variances count as floor at least in the logarithms. Samples are
    drawn in blocks, each with a generator of its own, so they are the same however the blocks are dealt.
    """

    def book(m: DataFrame, name: str) -> DataFrame:
        each = F.struct("component", F.col("weight").cast("double").alias("weight"), F.transform("mean", lambda x: x.cast("double")).alias("mean"), F.transform("var", lambda x: x.cast("double")).alias("var"))
        return m.agg(F.array_sort(F.collect_list(each)).alias(name))

    def parts(g) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = np.array([c["weight"] for c in g])
        mean, var = (np.array([list(c[n]) for c in g]) for n in ("mean", "var"))
        return weight[weight > 0], mean[weight > 0], var[weight > 0]

    def log_mixture(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
        total = np.full(len(x), -np.inf)
        for w, m, v in zip(weight, mean, np.maximum(var, floor), strict=True):
            total = np.logaddexp(total, np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum() + ((x - m) ** 2 / v).sum(axis=1)))
        return total

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, p, q in zip(batch["id"], batch["p"], batch["q"], strict=True):
                (weight, mean, var), other = parts(p), parts(q)
                rng = np.random.default_rng([seed, n])
                count = min(block, samples - n * block)
                picked = rng.choice(len(weight), size=count, p=weight / weight.sum())
                x = mean[picked] + rng.standard_normal((count, mean.shape[1])) * np.sqrt(var[picked])
                out.append(float((log_mixture(x, weight, mean, var) - log_mixture(x, *other)).sum()))
            yield pd.DataFrame({"s": out})

    blocks = a.sparkSession.range(-(-samples // block)).crossJoin(book(a, "p")).crossJoin(book(b, "q"))
    return blocks.mapInPandas(draw, "s double").agg((F.sum("s") / samples).alias("kl"))


def tied_variances(sums: DataFrame, tie: str) -> DataFrame:
    """tie, dim, n, mean, var of accumulators (tie, dim, n, sum_x, sum_xx) pooled over each tied set."""
    pooled = sums.groupBy(tie, "dim").agg(F.sum("n").alias("n"), F.sum("sum_x").alias("x"), F.sum("sum_xx").alias("xx"))
    mean = F.try_divide("x", "n")
    return pooled.select(tie, "dim", "n", mean.alias("mean"), (F.try_divide("xx", "n") - mean * mean).alias("var"))


def flat_start(dims: DataFrame, states: DataFrame, state: str, floor: float = FLOOR) -> DataFrame:
    """state, dim, mean, var, weight: every state begins with the mean and variance of all frames and one density."""
    whole = dims.groupBy("dim").agg(F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(floor)).alias("var"))
    # One row a component: small beside the states.
    return states.select(state).distinct().join(F.broadcast(whole)).select(state, "dim", "mean", "var", F.lit(1.0).alias("weight"))


def flat_transitions(topology: DataFrame, states: DataFrame, state: str) -> DataFrame:
    """state, i, j, p: each model's transitions uniform over what the topology (i, j) allows."""
    out = topology.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return states.select(state).distinct().join(F.broadcast(topology.join(out, "i"))).select(state, "i", "j", (1 / F.col("n")).alias("p"))


def _line(by: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
