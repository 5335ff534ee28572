"""Queries of measures, layouts, tied and flat models, text conversions and further checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import text as T
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import gaussians as G
from ..operators import sequences as S
from ..operators import validation as V
from .models import DIMS
from .sequences import SEQ
from .texts import LEX, WORDS, _lexicon, _t

TYPES = ("click", "view", "error", "signup", "purchase")


def _model(spark, sf_dir):
    """label, n, mean, var: one diagonal Gaussian a label, as arrays."""
    dims = G.frames(_t(spark, sf_dir, "embeddings"), ["label", "vec_id"], "embedding")
    model = G.estimate(dims, ["label"])
    sizes = model.groupBy("label").agg(F.max("n").cast("double").alias("n"))
    return G.as_arrays(model, ["label"]).join(sizes, "label")


def gaussian_entropies(spark, sf_dir):
    return _model(spark, sf_dir).select("label", F.round(M.gaussian_entropy(F.col("var")), 5).alias("entropy"))


def merge_losses(spark, sf_dir):
    m = _model(spark, sf_dir)
    both = m.alias("x").join(m.alias("y"), F.col("x.label") < F.col("y.label"))
    loss = M.gaussian_merge_loss(*[F.col(f"{s}.{c}") for s in "xy" for c in ("n", "mean", "var")])
    return both.select(F.col("x.label").alias("a"), F.col("y.label").alias("b"), F.round(loss, 4).alias("loss"))


def _type_counts(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array(*[F.count(F.when(F.col("event_type") == k, 1)).cast("double") for k in TYPES]).alias("c"))


def type_divergence(spark, sf_dir):
    """Each user's types against those of all users, with one more count of every type."""
    c = _type_counts(spark, sf_dir)
    smooth = lambda x: F.transform(x, lambda v: (v + 1) / (F.aggregate(x, F.lit(0.0), lambda a, y: a + y) + len(TYPES)))
    whole = c.agg(F.array(*[F.sum(F.get("c", F.lit(n))) for n in range(len(TYPES))]).alias("w"))
    p, q = smooth(F.col("c")), smooth(F.col("w"))
    row = c.join(F.broadcast(whole))
    return row.select(
        "user_id", F.round(M.directed_divergence(p, q), 6).alias("directed"), F.round(M.divergence(p, q), 6).alias("both"), F.round(M.cross_entropy(p, q), 6).alias("cross"),
        F.round(M.count_merge_loss(F.col("c"), F.col("w")), 4).alias("loss"), M.largest(F.col("c")).cast("int").alias("top"),
    )


def frequency_warps(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    hertz = F.col("value") * 40
    bent = M.piecewise_warp(hertz, 1.1, 3000.0, 8000.0)
    return e.select(
        "event_id", F.round(M.affine_warp(hertz, 1.2, 30.0), 5).alias("affine"), F.round(M.inverse_linear_warp(hertz, 1.25), 5).alias("inverse_linear"),
        F.round(bent, 5).alias("piecewise"), F.round(M.inverse_piecewise_warp(bent, 1.1, 3000.0, 8000.0), 4).alias("back"),
    )


def _cepstra(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 13), lambda x: x.cast("double")).alias("vec"))
    return S.number(rows, "label", "vec_id")


def feature_layout(spark, sf_dir):
    """The 39 components of every frame, thirteen of them static."""
    out = S.single_stream(_cepstra(spark, sf_dir), "label", "vec")
    return out.select("label", "frame", F.posexplode("feat").alias("at", "x")).select("label", "frame", "at", F.round("x", 5).alias("x"))


def long_deltas_of_streams(spark, sf_dir):
    out = S.four_streams(_cepstra(spark, sf_dir), "label", "vec").select("label", "frame", F.slice("dcep", 13, 12).alias("d"))
    return out.select("label", "frame", F.posexplode("d").alias("at", "x")).select("label", "frame", "at", F.round("x", 5).alias("x"))


def agc_estimates(spark, sf_dir):
    """Users are utterances in the order of their ids, in three streams."""
    e = _t(spark, sf_dir, "events")
    top = e.groupBy((F.col("user_id") % 3).alias("stream"), "user_id").agg(F.max("value").alias("top"))
    return S.estimated_maxima(top, "stream", "user_id", "top", 10.0).select("stream", "user_id", F.round("estimate", 3).alias("estimate"))


def tied_variances(spark, sf_dir):
    dims = G.frames(_t(spark, sf_dir, "embeddings"), ["label"], "embedding")
    sums = dims.groupBy("label", (F.col("label") % 3).alias("tie"), "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum(F.col("x") * F.col("x")).alias("sum_xx"))
    out = G.tied_variances(sums, "tie")
    return out.select("tie", "dim", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def flat_start(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    out = G.flat_start(G.frames(v, ["vec_id"], "embedding"), v, "label")
    return out.select("label", "dim", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"), "weight")


def flat_transitions(spark, sf_dir):
    topology = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (2, 3)], "i int, j int")
    return G.flat_transitions(topology, _t(spark, sf_dir, "embeddings"), "label").select("label", "i", "j", F.round("p", 6).alias("p"))


def copied_parameters(spark, sf_dir):
    """Each label's mean goes to two other labels; odd ones go nowhere."""
    dims = G.frames(_t(spark, sf_dir, "embeddings"), ["label", "vec_id"], "embedding")
    model = G.estimate(dims, ["label"]).select("label", "dim", F.round("mean", 6).alias("mean"))
    src = _t(spark, sf_dir, "embeddings").select("label").distinct().filter("label % 2 = 0")
    return V.copied(model, src.select(F.col("label").alias("src"), F.explode(F.array(F.col("label") + 100, F.col("label") + 200)).alias("dst")), "label")


def senone_codebooks(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).cast("int").alias("senone"))
    mapping = spark.range(50).select(F.col("id").cast("int").alias("senone"), (F.col("id") % 7).cast("int").alias("cb"))
    return V.senone_codebooks(e, mapping).groupBy("cb").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("senone").alias("senones"))


def unseen_senones(spark, sf_dir):
    """Pairs of a user's last digits and a type that never come with a value above 200."""
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("senone"), "event_type", F.when(F.col("value") > 200, F.col("value")).otherwise(0.0).alias("occ"))
    return V.unseen(e, e, ["senone", "event_type"], "occ")


def unknown_phones(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir)
    return V.unknown_phones(lexicon, lexicon.select(F.explode("phones").alias("phone")).filter("phone NOT IN ('e', 'k', 'z')"))


def segmentation_agreement(spark, sf_dir):
    """Types of a user's events against a segmentation with wrong phones at some places and users cut short."""
    e = S.number(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", F.col("frame").alias("pos"), F.col("event_type").alias("phone"), "event_id")
    wrong = F.when((F.col("event_id") % 97 == 5) & (F.col("user_id") % 3 == 0), "SIL").when((F.col("pos") == 3) & (F.col("user_id") % 5 == 1), F.lit(None)).otherwise(F.col("phone"))
    return V.segmentation_agrees(e.select("user_id", "pos", "phone"), e.select("user_id", "pos", wrong.alias("phone")), "user_id")


def interval_problems(spark, sf_dir):
    e = S.number(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    start = F.when(F.col("event_id") % 31 == 0, -1.0).when(F.col("event_id") % 37 == 0, F.col("frame") - 2.5).otherwise(F.col("frame") * 1.0)
    rows = e.select("user_id", F.col("frame").alias("seq"), F.when(F.col("event_id") % 41 == 0, "").otherwise(F.col("event_type")).alias("label"), start.alias("start"), (F.col("frame") + 0.5).alias("end"))
    return V.interval_problems(rows, "user_id")


def wer_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return E.wer_summary(e.select((F.col("event_id") % 11).alias("hits"), (F.col("event_id") % 3).alias("subs"), (F.col("event_id") % 2).alias("dels"), (F.col("event_id") % 5).alias("ins")))


def prompt_texts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.prompt_text(F.concat(F.lit("'don't' stop-it,' "), "text")).alias("text"))


def decoder_transcripts(spark, sf_dir):
    """Texts on one line with an id in brackets, earlier brackets, or none."""
    text = F.regexp_replace("text", r"[\s()]+", " ")
    form = F.col("doc_id") % 3
    number = F.col("doc_id").cast("string")
    line = F.when(form == 0, F.concat(F.lit("<s> "), text, F.lit(" </s> ( u"), number, F.lit(" )"))).when(form == 1, F.concat(F.lit("a (b) "), text, F.lit("(u"), number, F.lit(") x"))).otherwise(text)
    return _t(spark, sf_dir, "documents").select("doc_id", T.decoder_utterance(line).alias("u")).select("doc_id", "u.*")


def converted_lines(spark, sf_dir):
    """Texts on one line as tsv, sphinx or comment lines, converted to the sphinx form."""
    text, number = F.regexp_replace("text", r"\s+", " "), F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 2 == 0, "tsv").otherwise("sphinx")
    line = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# "), text)).when(kind == "tsv", F.concat(F.lit(" u"), number, F.lit("\t"), text)).otherwise(F.concat(F.lit("<s> "), text, F.lit(" </s> (u"), number, F.lit(")")))
    return _t(spark, sf_dir, "documents").select("doc_id", T.to_sphinx(line, kind).alias("line"))


def converted_csv(spark, sf_dir):
    """Texts as quoted CSV lines of several fields, converted to the sphinx form."""
    text, number = F.regexp_replace("text", r"\s+", " "), F.col("doc_id").cast("string")
    field = F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(field, F.lit(',b,"c, ""d""" e'))).otherwise(field)
    return _t(spark, sf_dir, "documents").select("doc_id", T.to_sphinx(F.concat(F.lit('"u'), number, F.lit('",'), more), F.lit("csv")).alias("line"))


def matched_densities(spark, sf_dir):
    """Each label's vectors as two mixtures, of three parts and of four by vec_id; the parts are matched."""
    e = _t(spark, sf_dir, "embeddings")

    def parts(n):
        dims = G.frames(e.select("label", (F.col("vec_id") % n).alias("component"), "embedding"), ["label", "component"], "embedding")
        return G.estimate(dims, ["label", "component"]).select("label", "component", "dim", "mean", "var")

    return G.matched_components(parts(3), parts(4), "label").withColumn("cost", F.round("cost", 5))


def reversed_phone_map(spark, sf_dir):
    """The lexicon, word to letters in the order of words, turned around: every letter's last word."""
    mapping = _lexicon(spark, sf_dir).select(F.col("word").alias("pos"), F.col("word").alias("source"), F.concat_ws(" ", "phones").alias("target"))
    return C.reversed_map(mapping).select("phone", F.col("source").alias("word"))


def stress_map(spark, sf_dir):
    """The marks of every vowel that two letters of a document spell."""
    letters = F.regexp_replace(F.upper("text"), "[^A-Z]", "")
    pairs = F.regexp_extract_all(letters, F.lit("(?=([A-Z]{2}))"), F.lit(1))
    spelled = _t(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.filter(pairs, lambda p: p.isin(*T.VOWELS)))).alias("v")).distinct()
    return spelled.select(F.explode(T.stress_map(F.array("v"), F.array(*map(F.lit, "012")))).alias("phone", "base"))


def _two_halves(spark, sf_dir):
    dims = G.frames(_t(spark, sf_dir, "embeddings"), ["label", "vec_id"], "embedding")
    return [G.estimate(dims.filter(F.col("vec_id") % 2 == n), ["label"]) for n in (0, 1)]


def distance_summary(spark, sf_dir):
    out = G.distance_summary(G.paired_distances(*_two_halves(spark, sf_dir), "label"), "bhattacharyya")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "highest", "lowest", "std")])


def most_different_states(spark, sf_dir):
    return G.most_different(G.paired_distances(*_two_halves(spark, sf_dir), "label"), "label", "mahalanobis", 3).select("label", F.round("mahalanobis", 6).alias("mahalanobis"))


def model_comparison(spark, sf_dir):
    """The vectors against a copy in which some are missing, changed a little, or changed."""
    a = G.frames(_t(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    i = F.col("vec_id")
    moved = F.when((i % 5 == 1) & (F.col("dim") == 3), F.col("x") + 0.5).when(i % 5 == 2, F.col("x") * (1 + 1e-7)).otherwise(F.col("x"))
    b = a.withColumn("x", moved).withColumn("vec_id", F.when(i % 11 == 0, -i - 1).otherwise(i))
    return G.compare_models(a, b, ["vec_id"]).select("vec_id", "verdict")


def first_config_difference(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    last = lambda kind: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max_by((F.col("event_id") % 3).cast("string"), "event_id").alias("value"))
    return V.first_difference(last("click"), last("view"))


def project_problems(spark, sf_dir):
    """Documents against the lexicon of the benchmark, a phone set that lacks letters, and audio for every third label."""
    lexicon = _lexicon(spark, sf_dir)
    phones = lexicon.select(F.explode("phones").alias("phone")).filter("phone NOT IN ('q', 'x')")
    audio = _t(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(-F.col("doc_id") - 1).alias("doc_id"))
    return V.project_problems(_t(spark, sf_dir, "documents"), lexicon, phones, audio, "doc_id", "text")


CEP = """v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, list_transform(embedding[1:13], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT label, max(frame) AS last FROM v GROUP BY label),
s AS (SELECT v.label, v.frame, d.d, w.v FROM v JOIN e USING (label), (SELECT unnest(range(-4, 5)) AS d) d JOIN v w ON w.label = v.label AND w.frame = least(greatest(v.frame + d.d, 0), e.last)),
p AS (SELECT label, frame, {} FROM s GROUP BY label, frame)""".format(", ".join(f"any_value(v) FILTER (d = {d}) AS {'m' if d < 0 else 'p'}{abs(d)}" for d in range(-4, 5)))
ROW = """WITH t AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS c1, count(*) FILTER (event_type = 'view') AS c2, count(*) FILTER (event_type = 'error') AS c3,
count(*) FILTER (event_type = 'signup') AS c4, count(*) FILTER (event_type = 'purchase') AS c5 FROM events GROUP BY user_id),
u AS (SELECT user_id, unnest([1, 2, 3, 4, 5]) AS k, unnest([c1, c2, c3, c4, c5]) AS c FROM t), w AS (SELECT k, sum(c) AS w FROM u GROUP BY k),
x AS (SELECT user_id, k, c, w, (c + 1.0) / (sum(c) OVER (PARTITION BY user_id) + 5) AS p, (w + 1.0) / ((SELECT sum(w) FROM w) + 5) AS q FROM u JOIN w USING (k))"""

QUERIES = {
    "gaussian_entropies": (
        gaussian_entropies,
        f"""WITH {DIMS}, v AS (SELECT label, dim, greatest(var_pop(x), 1e-4) AS var FROM dims GROUP BY ALL)
SELECT label, round(-(sum(ln(var)) / 2 + count(*) * (0.5 * ln(2 * pi()) + 0.5)) / ln(2), 5) AS entropy FROM v GROUP BY label""",
    ),
    "merge_losses": (
        merge_losses,
        f"""WITH {DIMS}, m AS (SELECT label, dim, CAST(count(x) AS DOUBLE) AS n, avg(x) AS mean, greatest(var_pop(x), 1e-4) AS var FROM dims GROUP BY ALL),
b AS (SELECT a.label AS a, b.label AS b, a.n AS n, b.n AS k, a.var AS v, b.var AS w,
  greatest((a.n * (a.var + a.mean * a.mean) + b.n * (b.var + b.mean * b.mean)) / (a.n + b.n) - pow((a.n * a.mean + b.n * b.mean) / (a.n + b.n), 2), 1e-4) AS c FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label)
SELECT a, b, round(0.5 * sum((n + k) * ln(c) - n * ln(v) - k * ln(w)), 4) AS loss FROM b GROUP BY a, b""",
    ),
    "type_divergence": (
        type_divergence,
        f"""{ROW}, l AS (SELECT user_id, sum(p * log2(p / q)) AS d, sum(q * log2(q / p)) AS r, -sum(p * ln(q)) AS x,
  sum(CASE WHEN c = 0 THEN 0 ELSE c * ln(c) END + CASE WHEN w = 0 THEN 0 ELSE w * ln(w) END - CASE WHEN c + w = 0 THEN 0 ELSE (c + w) * ln(c + w) END) AS y, sum(c) AS sc, sum(w) AS sw, arg_min(k, (-c, k)) - 1 AS top FROM x GROUP BY user_id)
SELECT user_id, round(d, 6) AS directed, round(d + r, 6) AS "both", round(x, 6) AS "cross", round(y - (sc * ln(sc) + sw * ln(sw) - (sc + sw) * ln(sc + sw)), 4) AS loss, CAST(top AS INTEGER) AS top FROM l""",
    ),
    "frequency_warps": (
        frequency_warps,
        """SELECT event_id, round(value * 40 * 1.2 + 30, 5) AS affine, round(value * 40 / 1.25, 5) AS inverse_linear,
round(CASE WHEN value * 40 < 3000 THEN value * 40 * 1.1 ELSE 8000 - (8000 - value * 40) * (8000 - 3300.0) / 5000 END, 5) AS piecewise, round(value * 40, 4) AS back FROM events""",
    ),
    "feature_layout": (
        feature_layout,
        f"""WITH {CEP}, o AS (SELECT label, frame, [p0[i + 1] FOR i IN range(1, 13)] || [p2[i + 1] - m2[i + 1] FOR i IN range(1, 13)] || [p0[1], p2[1] - m2[1], (p3[1] - m1[1]) - (p1[1] - m3[1])]
|| [(p3[i + 1] - m1[i + 1]) - (p1[i + 1] - m3[i + 1]) FOR i IN range(1, 13)] AS f FROM p)
SELECT label, CAST(frame AS INTEGER) AS frame, CAST(unnest(range(39)) AS INTEGER) AS at, round(unnest(f), 5) AS x FROM o""",
    ),
    "long_deltas_of_streams": (
        long_deltas_of_streams,
        f"""WITH {CEP}, o AS (SELECT label, frame, [p4[i + 1] - m4[i + 1] FOR i IN range(1, 13)] AS f FROM p)
SELECT label, CAST(frame AS INTEGER) AS frame, CAST(unnest(range(12)) AS INTEGER) AS at, round(unnest(f), 5) AS x FROM o""",
    ),
    "agc_estimates": (
        agc_estimates,
        """WITH RECURSIVE u AS (SELECT user_id % 3 AS stream, user_id, max(value) AS top, row_number() OVER (PARTITION BY user_id % 3 ORDER BY user_id) AS r FROM events GROUP BY user_id),
f AS (SELECT stream, 0 AS r, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS DOUBLE) AS estimate, 0.0::DOUBLE AS s, 0 AS n, 10.0::DOUBLE AS now FROM (SELECT DISTINCT stream FROM u)
UNION ALL SELECT u.stream, f.r + 1, u.user_id, f.now, CASE WHEN f.n = 15 THEN (f.s + u.top) / 2 ELSE f.s + u.top END, CASE WHEN f.n = 15 THEN 8 ELSE f.n + 1 END, (f.s + u.top) / (f.n + 1) FROM f JOIN u ON u.stream = f.stream AND u.r = f.r + 1)
SELECT stream, user_id, round(estimate, 3) AS estimate FROM f WHERE r > 0""",
    ),
    "tied_variances": (
        tied_variances,
        f"WITH {DIMS} SELECT label % 3 AS tie, dim, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM dims GROUP BY ALL",
    ),
    "flat_start": (
        flat_start,
        f"""WITH {DIMS}, g AS (SELECT dim, round(avg(x), 6) AS mean, round(greatest(var_pop(x), 1e-4), 6) AS var FROM dims GROUP BY dim)
SELECT label, dim, mean, var, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT label FROM embeddings), g""",
    ),
    "flat_transitions": (
        flat_transitions,
        """WITH t(i, j) AS (VALUES (0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2), (2, 3))
SELECT label, i, j, round(1.0::DOUBLE / count(*) OVER (PARTITION BY label, i), 6) AS p FROM (SELECT DISTINCT label FROM embeddings), t""",
    ),
    "copied_parameters": (
        copied_parameters,
        f"WITH {DIMS}, m AS (SELECT label, dim, round(avg(x), 6) AS mean FROM dims WHERE label % 2 = 0 GROUP BY ALL) SELECT label + 100 AS label, dim, mean FROM m UNION ALL SELECT label + 200, dim, mean FROM m",
    ),
    "senone_codebooks": (
        senone_codebooks,
        "SELECT CAST(user_id % 50 % 7 AS INTEGER) AS cb, count(*) AS n, count(DISTINCT user_id % 50) AS senones FROM events GROUP BY 1",
    ),
    "unseen_senones": (
        unseen_senones,
        "SELECT user_id % 40 AS senone, event_type FROM events GROUP BY ALL HAVING count(*) FILTER (value > 200) = 0",
    ),
    "unknown_phones": (
        unknown_phones,
        f"WITH {LEX}, p AS (SELECT DISTINCT word, unnest(string_split(word, '')) AS phone FROM lex) SELECT phone, count(*) AS n FROM p WHERE phone IN ('e', 'k', 'z') GROUP BY phone",
    ),
    "segmentation_agreement": (
        segmentation_agreement,
        f"""WITH {SEQ}, d AS (SELECT user_id, frame, ((event_id % 97 = 5 AND user_id % 3 = 0) OR (frame = 3 AND user_id % 5 = 1)) AS off FROM seq)
SELECT user_id, NOT bool_or(off) AS agrees, coalesce(min(frame) FILTER (off), -1) AS first_difference FROM d GROUP BY user_id""",
    ),
    "interval_problems": (
        interval_problems,
        f"""WITH {SEQ}, i AS (SELECT user_id, frame AS seq, event_id, CASE WHEN event_id % 31 = 0 THEN -1 WHEN event_id % 37 = 0 THEN frame - 2.5 ELSE frame END AS s FROM seq),
p AS (SELECT user_id, seq, CASE WHEN event_id % 41 = 0 THEN 'empty label' WHEN s < 0 OR seq + 0.5 < s THEN 'invalid times' WHEN s < lag(s) OVER (PARTITION BY user_id ORDER BY seq) THEN 'not ordered' END AS problem FROM i)
SELECT * FROM p WHERE problem IS NOT NULL""",
    ),
    "wer_summary": (
        wer_summary,
        """WITH t AS (SELECT sum(event_id % 11)::BIGINT AS h, sum(event_id % 3)::BIGINT AS s, sum(event_id % 2)::BIGINT AS d, sum(event_id % 5)::BIGINT AS i FROM events),
l AS (SELECT [printf('Word Error Rate (WER):      %.2f', 100 * (s + d + i) / (h + s + d)) || '%', printf('Match Error Rate (MER):     %.2f', 100 * (s + d + i) / (h + s + d + i)) || '%',
printf('Word Info Lost (WIL):       %.3f', 1 - (h / (h + s + d)) * (h / (h + s + i))), printf('Word Info Preserved (WIP):  %.3f', (h / (h + s + d)) * (h / (h + s + i))), '', 'Reference words:  ' || (h + s + d), 'Hypothesis words: ' || (h + s + i), '',
'Correct (hits):   ' || h, 'Substitutions:    ' || s, 'Deletions:        ' || d, 'Insertions:       ' || i, 'Total errors:     ' || (s + d + i)] AS x FROM t)
SELECT CAST(unnest(range(13)) AS INTEGER) AS line_no, unnest(x) AS line FROM l""",
    ),
    "prompt_texts": (
        prompt_texts,
        rf"""WITH k AS (SELECT doc_id, regexp_replace(upper(replace('''don''t'' stop-it,'' ' || text, 'ß', 'SS')), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s+''|''\s+', ' ', 'g'), '^''|''$', '', 'g') AS text FROM k) SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS text FROM a""",
    ),
    "decoder_transcripts": (
        decoder_transcripts,
        r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[\s()]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'u' || doc_id END AS utt_id, CASE doc_id % 3 WHEN 0 THEN '<s> ' || t || ' </s>' WHEN 1 THEN trim('a (b) ' || t) END AS text FROM t""",
    ),
    "converted_csv": (
        converted_csv,
        """WITH d AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents), l AS (SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN t || ',b,c, "d" e' ELSE t END) AS t FROM d)
SELECT doc_id, CASE WHEN t <> '' THEN '<s> ' || t || ' </s> (u' || doc_id || ')' END AS line FROM l""",
    ),
    "matched_densities": (
        matched_densities,
        f"""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
a AS (SELECT label, vec_id % 3 AS c, dim, avg(x) AS m, greatest(var_pop(x), {G.FLOOR}) AS v FROM e GROUP BY ALL),
b AS (SELECT label, vec_id % 4 AS c, dim, avg(x) AS m, greatest(var_pop(x), {G.FLOOR}) AS v FROM e GROUP BY ALL),
d AS (SELECT label, a.c AS a, b.c AS b, sum((a.m - b.m) ** 2 / ((a.v + b.v) / 2) / 8 + 0.5 * ln((a.v + b.v) / 2 / sqrt(a.v * b.v))) AS cost FROM a JOIN b USING (label, dim) GROUP BY ALL),
w AS (SELECT x.label, x.b AS b0, y.b AS b1, z.b AS b2 FROM d x JOIN d y ON y.label = x.label AND y.a = 1 AND y.b <> x.b JOIN d z ON z.label = x.label AND z.a = 2 AND z.b NOT IN (x.b, y.b)
  WHERE x.a = 0 QUALIFY row_number() OVER (PARTITION BY x.label ORDER BY x.cost + y.cost + z.cost) = 1)
SELECT label, a, b, round(cost, 5) AS cost FROM d JOIN w USING (label) WHERE b = CASE a WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END""",
    ),
    "converted_lines": (
        converted_lines,
        r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '<s> ' || trim(t) || ' </s> (u' || doc_id || ')' ELSE '<s> ' || t || ' </s> (u' || doc_id || ')' END AS line FROM t""",
    ),
    "reversed_phone_map": (
        reversed_phone_map,
        f"WITH {LEX}, p AS (SELECT word, unnest(string_split(word, '')) AS phone FROM lex) SELECT phone, max(word) AS word FROM p GROUP BY phone",
    ),
    "stress_map": (
        stress_map,
        """WITH d AS (SELECT regexp_replace(upper(text), '[^A-Z]', '', 'g') AS t FROM documents), p AS (SELECT DISTINCT unnest(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS INTEGER), 2))) AS v FROM d)
SELECT v || m AS phone, v AS base FROM p, (SELECT unnest(['0', '1', '2']) AS m) WHERE v IN ('AA','AE','AH','AO','AW','AY','EH','ER','EY','IH','IY','OW','OY','UH','UW')""",
    ),
    "distance_summary": (
        distance_summary,
        f"""WITH {DIMS}, m AS (SELECT vec_id % 2 AS h, label, dim, avg(x) AS mean, greatest(var_pop(x), 1e-4) AS var FROM dims GROUP BY ALL),
d AS (SELECT a.label, sum(pow(a.mean - b.mean, 2) / ((a.var + b.var) / 2) / 8 + 0.5 * ln((a.var + b.var) / 2 / sqrt(a.var * b.var))) AS d FROM m a JOIN m b USING (label, dim) WHERE a.h = 0 AND b.h = 1 GROUP BY a.label)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS highest, round(min(d), 6) AS lowest, round(stddev_pop(d), 6) AS std FROM d""",
    ),
    "most_different_states": (
        most_different_states,
        f"""WITH {DIMS}, m AS (SELECT vec_id % 2 AS h, label, dim, avg(x) AS mean, greatest(var_pop(x), 1e-4) AS var FROM dims GROUP BY ALL)
SELECT a.label AS label, round(sqrt(sum(pow(a.mean - b.mean, 2) / ((a.var + b.var) / 2))), 6) AS mahalanobis FROM m a JOIN m b USING (label, dim) WHERE a.h = 0 AND b.h = 1 GROUP BY a.label ORDER BY 2 DESC, 1 LIMIT 3""",
    ),
    "model_comparison": (
        model_comparison,
        """SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'only left' WHEN vec_id % 5 = 1 THEN 'differs' WHEN vec_id % 5 = 2 THEN 'close' ELSE 'equal' END AS verdict FROM embeddings
UNION ALL SELECT -vec_id - 1, 'only right' FROM embeddings WHERE vec_id % 11 = 0""",
    ),
    "first_config_difference": (
        first_config_difference,
        """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(arg_max(event_id, event_id) % 3 AS VARCHAR) AS v FROM events WHERE event_type = 'click' GROUP BY user_id),
b AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(arg_max(event_id, event_id) % 3 AS VARCHAR) AS v FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'remove' ELSE 'replace' END AS op, b.v AS value
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.v <> b.v ORDER BY 1 LIMIT 1""",
    ),
    "project_problems": (
        project_problems,
        f"""WITH {LEX}, t AS (SELECT unnest({WORDS.format('text')}) AS w FROM documents), au AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE -doc_id - 1 END AS doc_id FROM labels),
p AS (SELECT DISTINCT word, unnest(string_split(word, '')) AS phone FROM lex)
SELECT 'unknown word' AS problem, w AS item, count(*) AS n FROM t WHERE w NOT IN (SELECT word FROM lex) GROUP BY w
UNION ALL SELECT 'unknown phone', phone, count(*) FROM p WHERE phone IN ('q', 'x') GROUP BY phone
UNION ALL SELECT DISTINCT 'no audio', CAST(doc_id AS VARCHAR), 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM au)
UNION ALL SELECT 'no transcript', CAST(doc_id AS VARCHAR), 1 FROM au WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    ),
}
