"""Queries on the embeddings: vectors are frames, labels are states or densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaussians as G
from ..operators.lineage import cut
from ..operators.trees import agreement

DIMS = """dims AS (
  SELECT label, vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings
)"""
MODEL = f"""{DIMS}, model AS (
  SELECT label, dim, count(x) AS n, avg(x) AS mean, greatest(var_pop(x), 1e-4) AS var FROM dims GROUP BY label, dim
)"""


def _read(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _dims(spark, sf_dir, keys=("label", "vec_id"), first=None):
    return G.frames(_read(spark, sf_dir), list(keys), "embedding", first)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def gaussian_reestimate(spark, sf_dir):
    return _round(G.estimate(_dims(spark, sf_dir), ["label"]), "mean", "var")


def gaussian_two_pass_variance(spark, sf_dir):
    return _round(G.two_pass(_dims(spark, sf_dir), ["label"]), "mean", "var")


def gaussian_full_covariance(spark, sf_dir):
    return _round(G.full_covariance(_read(spark, sf_dir), ["label"], "embedding", 4), "cov")


def _halves(spark, sf_dir):
    dims = _dims(spark, sf_dir).withColumn("part", (F.col("vec_id") % 2).cast("int"))
    model = G.estimate(dims, ["label", "part"], floor=None)
    total = model.groupBy("label", "dim").agg(F.sum("n").alias("total"))
    return model.join(total, ["label", "dim"]).withColumn("weight", F.col("n") / F.col("total"))


def mixture_collapse(spark, sf_dir):
    return _round(G.collapse(_halves(spark, sf_dir), ["label"]), "mean", "var")


MEASURES = ("bhattacharyya", "kl_ab", "kl_ba", "kl_sum", "mahalanobis", "euclidean", "cosine")


def state_distance_matrix(spark, sf_dir):
    return _round(G.distances(G.estimate(_dims(spark, sf_dir), ["label"]), "label"), *MEASURES)


def closest_state_pair(spark, sf_dir):
    near = G.distances(G.estimate(_dims(spark, sf_dir), ["label"]), "label")
    best = near.agg(F.min(F.struct("bhattacharyya", "a", "b")).alias("m")).filter("m IS NOT NULL")
    return _round(best.select("m.a", "m.b", "m.bhattacharyya"), "bhattacharyya")


def _scored(spark, sf_dir):
    """The vectors and the labels' Gaussians."""
    return _read(spark, sf_dir), G.estimate(_dims(spark, sf_dir), ["label"])


def _scores(spark, sf_dir):
    return G.densities(*_scored(spark, sf_dir), "label", "embedding")


def log_density_scores(spark, sf_dir):
    return _round(_scores(spark, sf_dir), "ll", digits=4)


def topn_densities(spark, sf_dir):
    return _round(G.top_n(_scores(spark, sf_dir), ["vec_id"], 3), "ll", digits=4)


def _gammas(spark, sf_dir, cut=None):
    """The frames' posteriors of the labels' Gaussians, as _scores has their densities."""
    vectors, model = _scored(spark, sf_dir)
    return G.responsibilities(vectors, model, "label", "embedding", cut)


def posterior_accumulate(spark, sf_dir):
    return _round(G.accumulate(_gammas(spark, sf_dir, cut=22.0), "label"), "occ", "sum_x", "sum_xx", digits=5)


def density_counts(spark, sf_dir):
    gammas = _gammas(spark, sf_dir)
    return _round(gammas.groupBy("label").agg(F.sum("gamma").alias("count")), "count", digits=4)


def _start(dims, k=5):
    """The first k vectors are the starting centres."""
    return dims.filter(F.col("vec_id") < k).select(F.col("vec_id").alias("k"), "dim", F.col("x").alias("c"))


def _kmeans(spark, sf_dir, steps):
    dims = _dims(spark, sf_dir, ["vec_id"])
    vectors = _read(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return dims, *G.kmeans(vectors, _start(dims), steps)


def kmeans_step(spark, sf_dir):
    return _round(_kmeans(spark, sf_dir, 1)[1], "c")


def kmeans_two_steps(spark, sf_dir):
    return _round(_kmeans(spark, sf_dir, 2)[1], "c")


def kmeans_converged(spark, sf_dir):
    """Order lines in two figures from six centres until the error falls by less than a thousandth."""
    figures = F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100)
    vectors = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(figures.alias("v"))
    start = spark.range(6).select(F.col("id").alias("k"), F.posexplode(F.array((F.col("id") * 9 + 1).cast("double"), (F.col("id") * 4 % 7).cast("double"))).alias("dim", "c"))
    centres, telemetry = G.kmeans_converged(vectors, start, 1e-3, 30)
    last = telemetry[-1]
    return centres.select("k", "dim", F.round("c", 4).alias("c"), F.lit(last["step"]).alias("steps"), F.round(F.lit(last["error"]), 2).alias("error"))


def kmeans_gaussian_init(spark, sf_dir):
    dims, _, assigned = _kmeans(spark, sf_dir, 1)
    labelled = dims.join(assigned.select("vec_id", "k"), "vec_id")
    model = G.estimate(labelled, ["k"])
    whole = assigned.agg(F.count(F.lit(1)).alias("whole"))
    return _round(model.crossJoin(whole).select("k", "dim", (F.col("n") / F.col("whole")).alias("weight"), "mean", "var"), "weight", "mean", "var")


def quantisation_distortion(spark, sf_dir):
    _, _, assigned = _kmeans(spark, sf_dir, 1)
    return _round(assigned.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("d2").alias("distortion")), "distortion")


def gaussian_split(spark, sf_dir):
    return _round(G.split(G.estimate(_dims(spark, sf_dir), ["label"]), "label", 3), "n", "mean", "var")


def map_adapt(spark, sf_dir):
    dims = _dims(spark, sf_dir)
    prior = G.estimate(dims.filter(F.col("vec_id") % 2 == 1), ["label"])
    data = G.estimate(dims.filter(F.col("vec_id") % 2 == 0), ["label"])
    return _round(G.adapt(prior, data, "label"), "map_mean", "bayes_mean", "map_var")


A, B = ((1.0, 0.5), (-0.25, 0.75)), (0.1, -0.2)


def mllr_transform(spark, sf_dir):
    model = G.estimate(_dims(spark, sf_dir, first=2), ["label"])
    return _round(G.transform_means(model, "label", A, B), "mean")


def lda_project(spark, sf_dir):
    out = G.project(_read(spark, sf_dir), ["vec_id"], "embedding", ((1.0, -1.0, 0.5), (0.25, 0.25, 0.25)))
    return _round(out.select("vec_id", F.get("y", F.lit(0)).alias("y0"), F.get("y", F.lit(1)).alias("y1")), "y0", "y1")


def subvector_project(spark, sf_dir):
    out = G.subvectors(_read(spark, sf_dir), ["vec_id"], "embedding", ((0, 1), (2, 5)))
    return _round(out.select("vec_id", "stream", F.get("y", F.lit(0)).alias("y0"), F.get("y", F.lit(1)).alias("y1")), "y0", "y1")


def array_stats(spark, sf_dir):
    return _round(G.array_statistics(_dims(spark, sf_dir), ["label"]), "lowest", "highest", "mean", "std", "zeros", "ones")


def _two_models(spark, sf_dir):
    dims = _dims(spark, sf_dir)
    make = lambda odd: G.estimate(dims.filter(F.col("vec_id") % 2 == odd), ["label"]).select("label", "dim", F.col("mean").alias("x"))
    return make(0), make(1)


def array_compare(spark, sf_dir):
    return _round(G.compare_arrays(*_two_models(spark, sf_dir), ["label", "dim"]), "max_abs", "mean_abs")


def per_dim_compare(spark, sf_dir):
    a, b = _two_models(spark, sf_dir)
    mean = lambda m, n: m.groupBy("dim").agg(F.avg("x").alias(n))
    both = mean(a, "a").join(mean(b, "b"), "dim")
    # Names of the 64 components in thirds, as static, delta and delta-delta features.
    name = F.when(F.col("dim") < 22, "static").when(F.col("dim") < 44, "delta").otherwise("ddelta")
    off = F.abs(F.col("a") - F.col("b"))
    return _round(both.select("dim", name.alias("part"), off.alias("off"), (off < 1e-5).alias("same")), "off")


def variance_percentile_floor(spark, sf_dir):
    # Two labels count as unobserved, with variances of zero.
    model = G.estimate(_dims(spark, sf_dir), ["label"], floor=None).withColumn("var", F.when(F.col("label") > 1, F.col("var")).otherwise(0.0))
    return _round(G.percentile_floor(model, 20, 0.3), "floor")


def zero_codebooks(spark, sf_dir):
    model = G.estimate(_dims(spark, sf_dir), ["label"], floor=None)
    return model.groupBy("label").agg(F.bool_and((F.col("mean") == 0) & (F.col("var") == 0)).alias("all_zero"))


def partition_agreement(spark, sf_dir):
    """Labels against clusters, within seven subjects; every thirteenth vector has no cluster."""
    subject = (F.col("vec_id") % 7).alias("subject")
    labels = _read(spark, sf_dir).select(subject, "vec_id", F.col("label").alias("part"))
    clusters = _kmeans(spark, sf_dir, 1)[2].select(subject, F.when(F.col("vec_id") % 13 == 0, -F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("vec_id"), F.col("k").alias("part"))
    return agreement(labels, clusters, "subject", "vec_id", "part")


def em_passes(spark, sf_dir):
    """Three EM passes of a 10-density mixture: total log-likelihood of each pass, and convergence."""
    vectors = _read(spark, sf_dir)
    model = G.estimate(G.frames(vectors, ["label", "vec_id"], "embedding"), ["label"])
    telemetry = None
    for n in range(1, 4):
        gammas = G.responsibilities(vectors.select("vec_id", "embedding"), model, "label", "embedding", cut=22.0)
        # Every density has a row of each frame; the first one stands for the frame.
        first = F.when(F.col("label") == 0, F.col("lp"))
        row = cut(gammas.agg(F.sum(first).alias("total_ll"), F.count(first).alias("frames")).select(F.lit(n).alias("pass"), "total_ll", "frames"))
        telemetry = row if telemetry is None else telemetry.union(row)
        sums = G.accumulate(gammas, "label")
        mean = F.col("sum_x") / F.col("occ")
        model = sums.filter("occ > 0").select("label", "dim", F.col("occ").alias("n"), mean.alias("mean"), F.greatest(F.col("sum_xx") / F.col("occ") - mean * mean, F.lit(G.FLOOR)).alias("var"))
        model = cut(model)
    from ..operators.evaluation import convergence

    return _round(convergence(telemetry, "pass", "total_ll", "frames", 1e-4), "total_ll", "delta", digits=3)


ASSIGN = """start AS (SELECT vec_id AS k, dim, x AS c FROM dv WHERE vec_id < 5),
far AS (SELECT d.vec_id, s.k, sum((d.x - s.c) * (d.x - s.c)) AS d2 FROM dv d JOIN start s USING (dim) GROUP BY ALL),
assigned AS (SELECT vec_id, arg_min(k, (d2, k)) AS k, min(d2) AS d2 FROM far GROUP BY vec_id)"""
DV = """dv AS (
  SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
)"""
SCORES = f"""{MODEL}, scores AS (
  SELECT d.vec_id, m.label, -0.5 * sum((d.x - m.mean) * (d.x - m.mean) / m.var + ln(m.var * 6.283185307179586)) AS ll
  FROM dims d JOIN model m USING (dim) GROUP BY d.vec_id, m.label
)"""
GAMMAS = f"""{SCORES}, scaled AS (
  SELECT vec_id, label, ll, max(ll) OVER (PARTITION BY vec_id) AS best FROM scores
), e AS (
  SELECT vec_id, label, CASE WHEN ll < best - 22 THEN 0 ELSE exp(ll - best) END AS cut, exp(ll - best) AS whole FROM scaled
), gammas AS (
  SELECT vec_id, label, cut / sum(cut) OVER (PARTITION BY vec_id) AS gamma, whole / sum(whole) OVER (PARTITION BY vec_id) AS soft FROM e
)"""
DISTANCES = f"""{MODEL}, p AS (
  SELECT a.label AS a, b.label AS b, a.mean AS ma, a.var AS va, b.mean AS mb, b.var AS vb, (a.var + b.var) / 2 AS v, a.mean - b.mean AS d
  FROM model a JOIN model b ON a.dim = b.dim AND a.label < b.label
), dist AS (
  SELECT a, b,
    sum(d * d / v / 8 + 0.5 * ln(v / sqrt(va * vb))) AS bhattacharyya,
    0.5 * sum(ln(vb / va) + va / vb + d * d / vb - 1) AS kl_ab,
    0.5 * sum(ln(va / vb) + vb / va + d * d / va - 1) AS kl_ba,
    sqrt(sum(d * d / v)) AS mahalanobis,
    sqrt(sum(d * d)) AS euclidean,
    CASE WHEN sum(ma * ma) > 0 AND sum(mb * mb) > 0 THEN sum(ma * mb) / (sqrt(sum(ma * ma)) * sqrt(sum(mb * mb))) ELSE 0 END AS cosine
  FROM p GROUP BY a, b
)"""
TWO = f"""{DIMS}, two AS (
  SELECT label, dim, avg(x) FILTER (vec_id % 2 = 0) AS x, avg(x) FILTER (vec_id % 2 = 1) AS y FROM dims GROUP BY label, dim
), off AS (SELECT *, abs(x - y) AS off FROM two WHERE x IS NOT NULL AND y IS NOT NULL)"""

QUERIES = {
    "gaussian_reestimate": (
        gaussian_reestimate,
        f"WITH {MODEL} SELECT label, dim, n, round(mean, 6) AS mean, round(var, 6) AS var FROM model",
    ),
    "gaussian_two_pass_variance": (
        gaussian_two_pass_variance,
        f"""WITH {DIMS}, m AS (SELECT label, dim, avg(x) AS mean FROM dims GROUP BY label, dim)
SELECT label, dim, count(x) AS n, round(first(mean), 6) AS mean, round(avg((x - mean) * (x - mean)), 6) AS var
FROM dims JOIN m USING (label, dim) GROUP BY label, dim""",
    ),
    "gaussian_full_covariance": (
        gaussian_full_covariance,
        f"""WITH {DIMS} SELECT a.label AS label, a.dim AS i, b.dim AS j, round(covar_pop(a.x, b.x), 6) AS cov
FROM dims a JOIN dims b ON a.vec_id = b.vec_id AND a.dim <= b.dim WHERE a.dim < 4 AND b.dim < 4 GROUP BY ALL""",
    ),
    "mixture_collapse": (
        mixture_collapse,
        f"""WITH {DIMS}, c AS (
  SELECT label, vec_id % 2 AS part, dim, count(x) AS n, avg(x) AS mean, var_pop(x) AS var FROM dims GROUP BY ALL
), w AS (SELECT *, n / sum(n) OVER (PARTITION BY label, dim) AS weight FROM c),
s AS (SELECT label, dim, sum(weight * mean) AS mean, sum(weight * (var + mean * mean)) AS second FROM w GROUP BY ALL)
SELECT label, dim, round(mean, 6) AS mean, round(second - mean * mean, 6) AS var FROM s""",
    ),
    "state_distance_matrix": (
        state_distance_matrix,
        f"""WITH {DISTANCES} SELECT a, b, round(bhattacharyya, 6) AS bhattacharyya, round(kl_ab, 6) AS kl_ab, round(kl_ba, 6) AS kl_ba,
round(kl_ab + kl_ba, 6) AS kl_sum, round(mahalanobis, 6) AS mahalanobis, round(euclidean, 6) AS euclidean, round(cosine, 6) AS cosine FROM dist""",
    ),
    "closest_state_pair": (
        closest_state_pair,
        f"WITH {DISTANCES} SELECT a, b, round(bhattacharyya, 6) AS bhattacharyya FROM dist ORDER BY bhattacharyya, a, b LIMIT 1",
    ),
    "log_density_scores": (log_density_scores, f"WITH {SCORES} SELECT vec_id, label, round(ll, 4) AS ll FROM scores"),
    "topn_densities": (
        topn_densities,
        f"""WITH {SCORES}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY ll DESC, label) AS INTEGER) AS rank FROM scores)
SELECT vec_id, rank, label, round(ll, 4) AS ll FROM r WHERE rank <= 3""",
    ),
    "posterior_accumulate": (
        posterior_accumulate,
        f"""WITH {GAMMAS} SELECT g.label AS label, d.dim AS dim, round(sum(gamma), 5) AS occ, round(sum(gamma * x), 5) AS sum_x, round(sum(gamma * x * x), 5) AS sum_xx
FROM gammas g JOIN dims d USING (vec_id) GROUP BY ALL""",
    ),
    "density_counts": (density_counts, f"WITH {GAMMAS} SELECT label, round(sum(soft), 4) AS count FROM gammas GROUP BY label"),
    "kmeans_step": (
        kmeans_step,
        f"WITH {DV}, {ASSIGN} SELECT k, dim, round(avg(x), 6) AS c FROM dv JOIN assigned USING (vec_id) GROUP BY k, dim",
    ),
    "kmeans_two_steps": (
        kmeans_two_steps,
        f"""WITH {DV}, {ASSIGN}, again AS (SELECT k, dim, avg(x) AS c FROM dv JOIN assigned USING (vec_id) GROUP BY k, dim),
far2 AS (SELECT d.vec_id, s.k, sum((d.x - s.c) * (d.x - s.c)) AS d2 FROM dv d JOIN again s USING (dim) GROUP BY ALL),
assigned2 AS (SELECT vec_id, arg_min(k, (d2, k)) AS k FROM far2 GROUP BY vec_id)
SELECT k, dim, round(avg(x), 6) AS c FROM dv JOIN assigned2 USING (vec_id) GROUP BY k, dim""",
    ),
    "kmeans_converged": (
        kmeans_converged,
        """WITH RECURSIVE v AS (SELECT l_quantity::DOUBLE AS x, l_discount::DOUBLE * 100 AS y FROM lineitem),
s AS (SELECT 0 AS step, list_transform(range(6), lambda k: (k * 9 + 1)::DOUBLE) AS a, list_transform(range(6), lambda k: (k * 4 % 7)::DOUBLE) AS b, NULL::DOUBLE AS before, NULL::DOUBLE AS error, [0.0::DOUBLE] AS a0, [0.0::DOUBLE] AS b0
  UNION ALL
  SELECT step + 1, list(mx ORDER BY k), list(my ORDER BY k), any_value(error), sum(e), any_value(a), any_value(b) FROM (
    SELECT step, error, a, b, k, avg(x) AS mx, avg(y) AS my, sum(d) AS e FROM (
      SELECT step, error, a, b, x, y, list_min(ds) AS d, list_position(ds, list_min(ds)) AS k FROM (
        SELECT step, error, a, b, x, y, list_transform(range(1, 7), lambda j: (x - a[j]) ** 2 + (y - b[j]) ** 2) AS ds FROM s, v
        WHERE step < 31 AND (before IS NULL OR (before - error) / before > 1e-3)))
    GROUP BY step, error, a, b, k) GROUP BY step),
l AS (SELECT * FROM s ORDER BY step DESC LIMIT 1)
SELECT k, CAST(dim AS INTEGER) AS dim, round(CASE dim WHEN 0 THEN a0[k + 1] ELSE b0[k + 1] END, 4) AS c, step - 1 AS steps, round(error, 2) AS error FROM l, range(6) t(k), range(2) u(dim)""",
    ),
    "kmeans_gaussian_init": (
        kmeans_gaussian_init,
        f"""WITH {DV}, {ASSIGN} SELECT k, dim, round(count(*) / (SELECT count(*) FROM assigned), 6) AS weight, round(avg(x), 6) AS mean,
round(greatest(var_pop(x), 1e-4), 6) AS var FROM dv JOIN assigned USING (vec_id) GROUP BY k, dim""",
    ),
    "quantisation_distortion": (
        quantisation_distortion,
        f"WITH {DV}, {ASSIGN} SELECT k, count(*) AS n, round(avg(d2), 6) AS distortion FROM assigned GROUP BY k",
    ),
    "gaussian_split": (
        gaussian_split,
        f"""WITH {MODEL}, chosen AS (SELECT DISTINCT label, n FROM model ORDER BY n DESC, label LIMIT 3),
s AS (SELECT m.*, c.label IS NOT NULL AS chosen FROM model m LEFT JOIN chosen c ON m.label = c.label),
e AS (SELECT *, CAST(unnest(CASE WHEN chosen THEN [0, 1] ELSE [0] END) AS INTEGER) AS part FROM s)
SELECT label, part, dim, round(CASE WHEN chosen THEN n / 2 ELSE CAST(n AS DOUBLE) END, 6) AS n,
round(mean + CASE WHEN NOT chosen THEN 0 WHEN part = 0 THEN -0.2 * sqrt(var) ELSE 0.2 * sqrt(var) END, 6) AS mean, round(var, 6) AS var FROM e""",
    ),
    "map_adapt": (
        map_adapt,
        f"""WITH {DIMS}, g AS (
  SELECT label, vec_id % 2 AS part, dim, count(x) AS n, avg(x) AS m, greatest(var_pop(x), 1e-4) AS v FROM dims GROUP BY ALL
), j AS (
  SELECT d.label, d.dim, d.n, d.m, d.v, p.m AS m0, p.v AS v0, (10.0 * p.m + d.n * d.m) / (10.0 + d.n) AS new
  FROM g d JOIN g p ON d.label = p.label AND d.dim = p.dim WHERE d.part = 0 AND p.part = 1
)
SELECT label, dim, round(new, 6) AS map_mean, round((v0 * n * m + v * m0) / (v0 * n + v), 6) AS bayes_mean,
round(greatest((10.0 * (v0 + (m0 - new) * (m0 - new)) + n * (v + (m - new) * (m - new))) / (10.0 + n), 1e-4), 6) AS map_var FROM j""",
    ),
    "mllr_transform": (
        mllr_transform,
        f"""WITH {MODEL}, m AS (SELECT label, max(mean) FILTER (dim = 0) AS m0, max(mean) FILTER (dim = 1) AS m1 FROM model GROUP BY label)
SELECT label, 0 AS dim, round(m0 * 1.0 + m1 * 0.5 + 0.1, 6) AS mean FROM m
UNION ALL SELECT label, 1 AS dim, round(m0 * -0.25 + m1 * 0.75 - 0.2, 6) AS mean FROM m""",
    ),
    "lda_project": (
        lda_project,
        """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
SELECT vec_id, round(a - b + 0.5 * c, 6) AS y0, round(0.25 * a + 0.25 * b + 0.25 * c, 6) AS y1 FROM v""",
    ),
    "subvector_project": (
        subvector_project,
        """SELECT vec_id, 0 AS stream, round(CAST(embedding[1] AS DOUBLE), 6) AS y0, round(CAST(embedding[2] AS DOUBLE), 6) AS y1 FROM embeddings
UNION ALL SELECT vec_id, 1 AS stream, round(CAST(embedding[3] AS DOUBLE), 6) AS y0, round(CAST(embedding[6] AS DOUBLE), 6) AS y1 FROM embeddings""",
    ),
    "array_stats": (
        array_stats,
        f"""WITH {DIMS} SELECT label, round(min(x), 6) AS lowest, round(max(x), 6) AS highest, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std,
round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS zeros, round(avg(CASE WHEN x = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS ones FROM dims GROUP BY label""",
    ),
    "array_compare": (
        array_compare,
        f"""WITH {TWO} SELECT round(max(off), 6) AS max_abs, round(avg(off), 6) AS mean_abs,
(SELECT label FROM off ORDER BY off DESC, label, dim LIMIT 1) AS label, (SELECT dim FROM off ORDER BY off DESC, label, dim LIMIT 1) AS dim,
bool_and(off <= 1e-8 + 1e-5 * abs(y)) AS all_close FROM off""",
    ),
    "per_dim_compare": (
        per_dim_compare,
        f"""WITH {TWO}, d AS (SELECT dim, abs(avg(x) - avg(y)) AS off FROM two GROUP BY dim)
SELECT dim, CASE WHEN dim < 22 THEN 'static' WHEN dim < 44 THEN 'delta' ELSE 'ddelta' END AS part, round(off, 6) AS off, off < 1e-5 AS same FROM d""",
    ),
    "variance_percentile_floor": (
        variance_percentile_floor,
        f"""WITH {DIMS}, v AS (SELECT label, dim, CASE WHEN label > 1 THEN var_pop(x) ELSE 0 END AS var FROM dims GROUP BY label, dim), pos AS (SELECT * FROM v WHERE var > 0),
s AS (SELECT dim, min(var) FILTER (var > 0) AS low, max(var) AS high, count(*) AS n FROM v GROUP BY dim),
b AS (SELECT dim, low, high, n, least(19, CAST(floor(CASE WHEN high > low THEN (var - low) / ((high - low) / 20) ELSE 0 END) AS INTEGER)) AS bin FROM pos JOIN s USING (dim)),
c AS (SELECT dim, low, high, n, bin, count(*) AS c FROM b GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin) AS s FROM c)
SELECT dim, round(low + (coalesce(min(bin) FILTER (s > 0.3 * n), 20) + 1) * (high - low) / 20, 6) AS floor FROM r GROUP BY dim, low, high""",
    ),
    "zero_codebooks": (
        zero_codebooks,
        f"WITH {DIMS}, v AS (SELECT label, dim, avg(x) AS m, var_pop(x) AS v FROM dims GROUP BY ALL) SELECT label, bool_and(m = 0 AND v = 0) AS all_zero FROM v GROUP BY label",
    ),
    "partition_agreement": (
        partition_agreement,
        f"""WITH {DV}, {ASSIGN}, k AS (SELECT vec_id % 7 AS subject, CASE WHEN vec_id % 13 = 0 THEN -vec_id - 1 ELSE vec_id END AS vec_id, k FROM assigned),
l AS (SELECT vec_id % 7 AS subject, vec_id, label FROM embeddings),
t AS (SELECT subject, vec_id, label, k FROM l JOIN k USING (subject, vec_id)),
p AS (SELECT a.subject, count(*) AS pairs, count(*) FILTER ((a.label = b.label) <> (a.k = b.k)) AS disagreements FROM t a JOIN t b ON a.subject = b.subject AND a.vec_id < b.vec_id GROUP BY a.subject),
s AS (SELECT subject, count(*) AS common, count(DISTINCT label) AS left_parts, count(DISTINCT k) AS right_parts FROM t GROUP BY subject),
lo AS (SELECT subject, count(*) AS left_only FROM l ANTI JOIN k USING (subject, vec_id) GROUP BY subject),
ro AS (SELECT subject, count(*) AS right_only FROM k ANTI JOIN l USING (subject, vec_id) GROUP BY subject),
u AS (SELECT subject FROM l UNION SELECT subject FROM k)
SELECT subject, coalesce(left_only, 0) = 0 AND coalesce(right_only, 0) = 0 AND coalesce(disagreements, 0) = 0 AS equal, coalesce(common, 0) AS common, coalesce(left_only, 0) AS left_only, coalesce(right_only, 0) AS right_only,
coalesce(left_parts, 0) AS left_parts, coalesce(right_parts, 0) AS right_parts, coalesce(pairs, 0) AS pairs, coalesce(disagreements, 0) AS disagreements
FROM u LEFT JOIN s USING (subject) LEFT JOIN p USING (subject) LEFT JOIN lo USING (subject) LEFT JOIN ro USING (subject)""",
    ),
    "em_passes": (em_passes, None),
}
