"""Queries on the events: a user's events in time order are a sequence, the type is the phone, the value c0."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..sources import sinks

SEQ = """seq AS (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, event_id, ts, event_type, value
  FROM events
)"""


def _seq(spark, sf_dir):
    return S.number(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")


def _out(df, value, name="y", digits=6):
    return df.select("user_id", "frame", F.round(value, digits).alias(name))


def delta_features(spark, sf_dir):
    return _out(_seq(spark, sf_dir), S.delta("value", "user_id"))


def delta_delta(spark, sf_dir):
    return _out(_seq(spark, sf_dir), S.delta_delta("value", "user_id"))


def long_delta(spark, sf_dir):
    return _out(_seq(spark, sf_dir), S.delta("value", "user_id", 4))


def frame_stack(spark, sf_dir):
    out = _seq(spark, sf_dir).select("user_id", "frame", S.stacked("value", "user_id", 1).alias("v"))
    return out.select("user_id", "frame", *[F.get("v", F.lit(n)).alias(f"v{n}") for n in range(3)])


def preemphasis(spark, sf_dir):
    return _out(_seq(spark, sf_dir), S.preemphasis("value", "user_id"))


def batch_cmn(spark, sf_dir):
    # Values are positive; 100 below makes some of them negative.
    low = _seq(spark, sf_dir).withColumn("value", F.col("value") - 10)
    return _out(low, S.batch_mean_normalised("value", "user_id", "value"))


def variance_normalise(spark, sf_dir):
    low = _seq(spark, sf_dir).withColumn("value", F.col("value") - 10).withColumn("x2", F.col("value") * F.col("value"))
    return _out(low, S.variance_normalised("value", "user_id", "value"), digits=5)


def live_cmn(spark, sf_dir):
    low = _seq(spark, sf_dir).withColumn("value", F.col("value") - 10)
    out = S.live_mean_normalised(low, "user_id", "value", start=5.0, window=10, most=20)
    return out.select("user_id", "frame", F.round("y", 5).alias("y"))


def agc_max(spark, sf_dir):
    return _out(_seq(spark, sf_dir), S.agc_max("value", "user_id"))


def agc_noise(spark, sf_dir):
    return _out(S.agc_noise(_seq(spark, sf_dir), "user_id", "value"), F.col("agc"))


def transition_counts(spark, sf_dir):
    return S.transitions(_seq(spark, sf_dir), "user_id", "event_type")


def transition_matrix(spark, sf_dir):
    p = S.normalise_rows(S.transitions(_seq(spark, sf_dir), "user_id", "event_type"), "i", "n")
    return p.select("i", "j", F.round("p", 6).alias("p"))


def _triphones(spark, sf_dir):
    return S.contexts(_seq(spark, sf_dir), "user_id", "event_type", fillers=("error",)).groupBy(
        F.col("event_type").alias("base"), "left", "right"
    ).agg(F.count(F.lit(1)).alias("n"))


def triphone_counts(spark, sf_dir):
    return _triphones(spark, sf_dir)


def count_of_counts(spark, sf_dir):
    return _triphones(spark, sf_dir).groupBy(F.least("n", F.lit(100)).alias("n")).agg(F.count(F.lit(1)).alias("triphones"))


def min_count_threshold(spark, sf_dir):
    """The least count at which at most 30 triphones are left."""
    counts = _triphones(spark, sf_dir)
    down = Window.orderBy(F.desc("n"))  # one row a distinct count
    kept = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).withColumn("kept", F.sum("c").over(down))
    return kept.filter("kept <= 30").agg(F.min("n").alias("threshold"), F.max("kept").alias("kept"))


def triphone_inventory_ids(spark, sf_dir):
    line = Window.orderBy("base", "left", "right")  # one row a triphone of the inventory
    return _triphones(spark, sf_dir).select("base", "left", "right", (F.row_number().over(line) - 1).alias("id"))


def triphone_backoff_lookup(spark, sf_dir):
    """Triphones seen at least 60 times are modelled; others fall back to (left, base) and then to base."""
    counts = _triphones(spark, sf_dir)
    model = counts.filter("n >= 60").select("base", "left", "right", F.lit("triphone").alias("full"))
    half = counts.groupBy("base", "left").agg(F.sum("n").alias("m")).filter("m >= 250").select("base", "left", F.lit("left").alias("half"))
    looked = counts.join(model, ["base", "left", "right"], "left").join(half, ["base", "left"], "left")
    return looked.select("base", "left", "right", F.coalesce("full", "half", F.lit("base")).alias("found"))


def segment_runs(spark, sf_dir):
    return S.segments(_seq(spark, sf_dir), "user_id", "event_type")


def segment_counts(spark, sf_dir):
    runs = S.segments(_seq(spark, sf_dir), "user_id", "event_type")
    return runs.groupBy("event_type").agg(F.count(F.lit(1)).alias("segments"), F.sum("frames").alias("frames"), F.max("frames").alias("longest"))


def segment_gather(spark, sf_dir):
    seq = _seq(spark, sf_dir)
    of = S.frames_of_segments(S.segments(seq, "user_id", "event_type"), "user_id", "event_type")
    joined = of.join(seq.select("user_id", "frame", "value"), ["user_id", "frame"])
    return joined.groupBy("user_id", "seq", "event_type").agg(F.round(F.sum("value"), 4).alias("total"))


def frame_to_segment_join(spark, sf_dir):
    of = S.frames_of_segments(S.segments(_seq(spark, sf_dir), "user_id", "event_type"), "user_id", "event_type")
    return of.select("user_id", "frame", "seq", "event_type")


def _intervals(spark, sf_dir):
    """Every event as an interval of a second, with gaps of none, one or two seconds between them."""
    seq = _seq(spark, sf_dir)
    begin = F.col("frame") * 2.0 + F.col("frame") % 2
    return seq.select("user_id", begin.alias("begin"), (begin + 1.0).alias("end"), F.col("event_type").alias("label"), (begin + 2.0).alias("xmax"))


def interval_gap_fill(spark, sf_dir):
    return S.fill_gaps(_intervals(spark, sf_dir), "user_id", "begin", "end", "label", F.col("xmax"))


def ctm_lines(spark, sf_dir):
    """Runs of one event type as CTM lines, a frame being a second."""
    runs = S.segments(_seq(spark, sf_dir), "user_id", "event_type")
    return sinks.ctm_lines(runs.select(F.col("user_id").cast("string").alias("utt_id"), "start_frame", "end_frame", F.col("event_type").alias("name")), 1.0)


def parameter_counts_with_zeros(spark, sf_dir):
    seq = _seq(spark, sf_dir)
    domain = seq.select("event_type").distinct().crossJoin(seq.select((F.col("user_id") % 7).alias("grp")).distinct())
    counts = seq.filter("value > 60").groupBy("event_type", (F.col("user_id") % 7).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, ["event_type", "grp"], "left").select("event_type", "grp", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def duplicate_ids(spark, sf_dir):
    per = _seq(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.filter("n > 15")


def mixw_interpolate(spark, sf_dir):
    """Weights of a user's types, 0.7 of their own and 0.3 of the overall ones."""
    seq = _seq(spark, sf_dir)
    own = S.normalise_rows(seq.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")), "user_id", "n", "own")
    whole = seq.count()
    total = seq.groupBy("event_type").agg((F.count(F.lit(1)) / F.lit(whole)).alias("si"))
    return own.join(total, "event_type").select("user_id", "event_type", F.round(0.7 * F.col("own") + 0.3 * F.col("si"), 6).alias("w"))


def row_normalize(spark, sf_dir):
    counts = _seq(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return S.normalise_rows(counts, "user_id", "v").select("user_id", "event_type", F.round("p", 6).alias("p"))


def deleted_interp_step(spark, sf_dir):
    """One EM step for the weight of the specific against the general distribution, on the odd frames."""
    seq = _seq(spark, sf_dir)
    even, odd = seq.filter("frame % 2 = 0"), seq.filter("frame % 2 = 1")
    cd = S.normalise_rows(even.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")), "user_id", "n", "cd").drop("n")
    n_even = even.count()
    ci = even.groupBy("event_type").agg((F.count(F.lit(1)) / F.lit(n_even)).alias("ci"))
    held = odd.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    both = held.join(ci, "event_type").join(cd, ["user_id", "event_type"], "left").withColumn("cd", F.coalesce("cd", F.lit(0.0)))
    post = 0.5 * F.col("cd") / (0.5 * F.col("cd") + 0.5 * F.col("ci"))
    return both.groupBy("user_id").agg(F.round(F.sum(F.col("c") * post) / F.sum("c"), 6).alias("weight"))


def timing_rollup(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cpu = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value") / 2)
    out = e.groupBy("event_type").agg(F.sum("value").alias("wall"), F.sum(cpu).alias("cpu"), F.count(F.lit(1)).alias("runs"))
    return out.select("event_type", "runs", F.round("wall", 4).alias("wall"), F.round("cpu", 4).alias("cpu"), F.round(F.coalesce(F.try_divide("cpu", "wall"), F.lit(0.0)), 6).alias("ratio"))


def staleness(spark, sf_dir):
    """A user is stale when the newest click is at or after the oldest purchase, or there is none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    per = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("i"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("o"))
    return per.select("user_id", (F.col("o").isNull() | F.coalesce(F.col("i") >= F.col("o"), F.lit(False))).alias("stale"))


def skip_accounting(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    reason = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 5, "short")
    whole = e.count()
    out = e.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("too_many", F.col("n") > 0.1 * whole)


def speech_hangover(spark, sf_dir):
    seq = _seq(spark, sf_dir).withColumn("speech", F.col("value") > 20)
    return S.hangover(seq, "user_id", "speech", 2, 2).select("user_id", "frame", "in_speech")


def tree_entropy(spark, sf_dir):
    """Entropy in bits of the types of each user, p below 1e-8 left out."""
    p = S.normalise_rows(_seq(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")), "user_id", "n")
    return p.filter("p > 1e-8").groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))


def best_question(spark, sf_dir):
    """Of the questions "is the left context x", the one whose split of the types gains most entropy by count."""
    from ..operators.trees import best_question as best

    rows = S.contexts(_seq(spark, sf_dir), "user_id", "event_type", fillers=("error",))
    counts = rows.groupBy("left", "event_type").agg(F.count(F.lit(1)).alias("n"))
    questions = counts.select(F.col("left").alias("question"), F.col("left").alias("member")).distinct()
    return best(counts, "left", "event_type", "n", questions).select("question", F.round("gain", 4).alias("gain"))


DELTA = """{a} - {b}"""
EDGE = "first_value(value) OVER w2"


def _shift(by: int) -> str:
    move, edge = ("lead", "last_value") if by > 0 else ("lag", "first_value")
    return f"coalesce({move}(value, {abs(by)}) OVER w, {edge}(value) OVER w2)"


WINDOWS = """WINDOW w AS (PARTITION BY user_id ORDER BY frame),
w2 AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
TRIPHONES = f"""{SEQ}, near AS (
  SELECT event_type AS base,
    CASE WHEN coalesce(lag(event_type) OVER w, 'error') = 'error' THEN 'SIL' ELSE lag(event_type) OVER w END AS left_,
    CASE WHEN coalesce(lead(event_type) OVER w, 'error') = 'error' THEN 'SIL' ELSE lead(event_type) OVER w END AS right_
  FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY frame)
), tri AS (SELECT base, left_, right_, count(*) AS n FROM near WHERE base <> 'error' GROUP BY ALL)"""
RUNS = f"""{SEQ}, ch AS (
  SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY frame) = event_type THEN 0 ELSE 1 END AS change FROM seq
), rn AS (SELECT *, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY frame) - 1 AS INTEGER) AS seq_ FROM ch),
runs AS (SELECT user_id, seq_ AS seq, event_type, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS frames FROM rn GROUP BY ALL)"""
LOW = "low AS (SELECT user_id, frame, value - 10 AS value FROM seq)"
INTERVALS = f"""{SEQ}, iv AS (
  SELECT user_id, frame * 2.0::DOUBLE + frame % 2 AS "begin", frame * 2.0::DOUBLE + frame % 2 + 1 AS "end", event_type AS label, frame * 2.0::DOUBLE + frame % 2 + 2 AS xmax FROM seq
)"""

QUERIES = {
    "delta_features": (delta_features, f"WITH {SEQ} SELECT user_id, frame, round({_shift(2)} - {_shift(-2)}, 6) AS y FROM seq {WINDOWS}"),
    "delta_delta": (
        delta_delta,
        f"WITH {SEQ} SELECT user_id, frame, round(({_shift(3)} - {_shift(-1)}) - ({_shift(1)} - {_shift(-3)}), 6) AS y FROM seq {WINDOWS}",
    ),
    "long_delta": (long_delta, f"WITH {SEQ} SELECT user_id, frame, round({_shift(4)} - {_shift(-4)}, 6) AS y FROM seq {WINDOWS}"),
    "frame_stack": (frame_stack, f"WITH {SEQ} SELECT user_id, frame, {_shift(-1)} AS v0, value AS v1, {_shift(1)} AS v2 FROM seq {WINDOWS}"),
    "preemphasis": (
        preemphasis,
        f"WITH {SEQ} SELECT user_id, frame, round(value - 0.97::DOUBLE * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY frame), 0), 6) AS y FROM seq",
    ),
    "batch_cmn": (
        batch_cmn,
        f"WITH {SEQ}, {LOW} SELECT user_id, frame, round(value - avg(CASE WHEN value >= 0 THEN value END) OVER (PARTITION BY user_id), 6) AS y FROM low",
    ),
    "variance_normalise": (
        variance_normalise,
        f"""WITH {SEQ}, {LOW}, m AS (SELECT *, avg(CASE WHEN value >= 0 THEN value END) OVER (PARTITION BY user_id) AS mean FROM low)
SELECT user_id, frame, round((value - mean) / sqrt(avg((value - mean) * (value - mean)) OVER (PARTITION BY user_id)), 5) AS y FROM m""",
    ),
    "live_cmn": (
        live_cmn,
        f"""WITH RECURSIVE {SEQ}, {LOW}, f AS (
  SELECT user_id, -1 AS frame, 5.0::DOUBLE AS mean, 50.0::DOUBLE AS total, 10.0::DOUBLE AS n, NULL::DOUBLE AS y FROM (SELECT DISTINCT user_id FROM low)
  UNION ALL
  SELECT user_id, frame, CASE WHEN c > 20 THEN t / c ELSE mean END, CASE WHEN c > 20 THEN t / c * 10 ELSE t END, CASE WHEN c > 20 THEN 10.0 ELSE c END, y
  FROM (
    SELECT low.user_id, low.frame, f.mean, f.total + CASE WHEN low.value >= 0 THEN low.value ELSE 0 END AS t,
      f.n + CASE WHEN low.value >= 0 THEN 1 ELSE 0 END AS c, low.value - CASE WHEN low.value >= 0 THEN f.mean ELSE 0 END AS y
    FROM f JOIN low ON low.user_id = f.user_id AND low.frame = f.frame + 1
  )
) SELECT user_id, CAST(frame AS INTEGER) AS frame, round(y, 5) AS y FROM f WHERE frame >= 0""",
    ),
    "agc_max": (agc_max, f"WITH {SEQ} SELECT user_id, frame, round(value - max(value) OVER (PARTITION BY user_id), 6) AS y FROM seq"),
    "agc_noise": (
        agc_noise,
        f"""WITH {SEQ}, m AS (SELECT *, min(value) OVER (PARTITION BY user_id) + 2 AS low FROM seq)
SELECT user_id, frame, round(value - coalesce(avg(CASE WHEN value < low THEN value END) OVER (PARTITION BY user_id), 0), 6) AS y FROM m""",
    ),
    "transition_counts": (
        transition_counts,
        f"""WITH {SEQ}, t AS (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS j FROM seq)
SELECT i, j, count(*) AS n FROM t WHERE j IS NOT NULL GROUP BY i, j""",
    ),
    "transition_matrix": (
        transition_matrix,
        f"""WITH {SEQ}, t AS (SELECT event_type AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY frame) AS j FROM seq),
c AS (SELECT i, j, count(*) AS n FROM t WHERE j IS NOT NULL GROUP BY i, j) SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 6) AS p FROM c""",
    ),
    "triphone_counts": (triphone_counts, f'WITH {TRIPHONES} SELECT base, left_ AS "left", right_ AS "right", n FROM tri'),
    "count_of_counts": (count_of_counts, f"WITH {TRIPHONES} SELECT least(n, 100) AS n, count(*) AS triphones FROM tri GROUP BY ALL"),
    "min_count_threshold": (
        min_count_threshold,
        f"""WITH {TRIPHONES}, c AS (SELECT n, count(*) AS c FROM tri GROUP BY n), k AS (SELECT n, sum(c) OVER (ORDER BY n DESC) AS kept FROM c)
SELECT min(n) AS threshold, CAST(max(kept) AS BIGINT) AS kept FROM k WHERE kept <= 30""",
    ),
    "triphone_inventory_ids": (
        triphone_inventory_ids,
        f'WITH {TRIPHONES} SELECT base, left_ AS "left", right_ AS "right", CAST(row_number() OVER (ORDER BY base, left_, right_) - 1 AS INTEGER) AS id FROM tri',
    ),
    "triphone_backoff_lookup": (
        triphone_backoff_lookup,
        f"""WITH {TRIPHONES}, h AS (SELECT base, left_, sum(n) AS m FROM tri GROUP BY ALL)
SELECT t.base, t.left_ AS "left", t.right_ AS "right", CASE WHEN t.n >= 60 THEN 'triphone' WHEN h.m >= 250 THEN 'left' ELSE 'base' END AS found
FROM tri t JOIN h ON t.base = h.base AND t.left_ = h.left_""",
    ),
    "segment_runs": (segment_runs, f"WITH {RUNS} SELECT * FROM runs"),
    "segment_counts": (
        segment_counts,
        f"WITH {RUNS} SELECT event_type, count(*) AS segments, CAST(sum(frames) AS BIGINT) AS frames, max(frames) AS longest FROM runs GROUP BY event_type",
    ),
    "segment_gather": (segment_gather, f"WITH {RUNS} SELECT user_id, seq_ AS seq, event_type, round(sum(value), 4) AS total FROM rn GROUP BY ALL"),
    "frame_to_segment_join": (
        frame_to_segment_join,
        f"WITH {RUNS} SELECT s.user_id, s.frame, r.seq, r.event_type FROM seq s JOIN runs r ON s.user_id = r.user_id AND s.frame BETWEEN r.start_frame AND r.end_frame",
    ),
    "interval_gap_fill": (
        interval_gap_fill,
        f"""WITH {INTERVALS}, g AS (
  SELECT user_id, coalesce(lag("end") OVER (PARTITION BY user_id ORDER BY "begin"), 0) AS a, "begin" AS b FROM iv
  UNION ALL SELECT user_id, max("end"), max(xmax) FROM iv GROUP BY user_id
) SELECT user_id, "begin", "end", label FROM iv UNION ALL SELECT user_id, a, b, '' FROM g WHERE b > a""",
    ),
    "ctm_lines": (
        ctm_lines,
        f"WITH {RUNS} SELECT concat(user_id, ' 1 ', start_frame, '.00 ', frames, '.00 ', event_type) AS line FROM runs",
    ),
    "parameter_counts_with_zeros": (
        parameter_counts_with_zeros,
        """WITH d AS (SELECT * FROM (SELECT DISTINCT event_type FROM events), (SELECT DISTINCT user_id % 7 AS grp FROM events))
SELECT d.event_type, d.grp, count(e.user_id) AS n FROM d LEFT JOIN events e ON e.event_type = d.event_type AND e.user_id % 7 = d.grp AND e.value > 60 GROUP BY ALL""",
    ),
    "duplicate_ids": (duplicate_ids, "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 15"),
    "mixw_interpolate": (
        mixw_interpolate,
        """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS si FROM events GROUP BY ALL)
SELECT user_id, event_type, round(0.7 * (n / sum(n) OVER (PARTITION BY user_id)) + 0.3 * si, 6) AS w FROM c JOIN t USING (event_type)""",
    ),
    "row_normalize": (
        row_normalize,
        """WITH c AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL)
SELECT user_id, event_type, round(v / sum(v) OVER (PARTITION BY user_id), 6) AS p FROM c""",
    ),
    "deleted_interp_step": (
        deleted_interp_step,
        f"""WITH {SEQ}, e AS (SELECT * FROM seq WHERE frame % 2 = 0), o AS (SELECT user_id, event_type, count(*) AS c FROM seq WHERE frame % 2 = 1 GROUP BY ALL),
n AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL), cd AS (SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id) AS cd FROM n),
ci AS (SELECT event_type, count(*) / (SELECT count(*) FROM e) AS ci FROM e GROUP BY ALL),
b AS (SELECT o.user_id, o.c, coalesce(cd.cd, 0) AS cd, ci.ci FROM o JOIN ci ON o.event_type = ci.event_type LEFT JOIN cd ON cd.user_id = o.user_id AND cd.event_type = o.event_type)
SELECT user_id, round(sum(c * (0.5 * cd / (0.5 * cd + 0.5 * ci))) / sum(c), 6) AS weight FROM b GROUP BY user_id""",
    ),
    "timing_rollup": (
        timing_rollup,
        """SELECT event_type, count(*) AS runs, round(sum(value), 4) AS wall, round(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value / 2 END), 4) AS cpu,
round(coalesce(sum(CASE WHEN event_type = 'error' THEN 0 ELSE value / 2 END) / nullif(sum(value), 0), 0), 6) AS ratio FROM events GROUP BY event_type""",
    ),
    "staleness": (
        staleness,
        """WITH p AS (SELECT user_id, max(ts) FILTER (event_type = 'click') AS i, min(ts) FILTER (event_type = 'purchase') AS o FROM events GROUP BY user_id)
SELECT user_id, o IS NULL OR coalesce(i >= o, FALSE) AS stale FROM p""",
    ),
    "skip_accounting": (
        skip_accounting,
        """WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 5 THEN 'short' END AS reason FROM events)
SELECT reason, count(*) AS n, count(*) > 0.1 * (SELECT count(*) FROM events) AS too_many FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    ),
    "speech_hangover": (
        speech_hangover,
        f"""WITH {SEQ}, s AS (SELECT user_id, frame, value > 20 AS sp FROM seq),
w AS (SELECT user_id, frame, CASE WHEN sum(CASE WHEN sp THEN 1 ELSE 0 END) OVER l = 2 THEN TRUE WHEN sum(CASE WHEN sp THEN 0 ELSE 1 END) OVER l = 2 THEN FALSE END AS sw
  FROM s WINDOW l AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT user_id, frame, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS in_speech FROM w""",
    ),
    "tree_entropy": (
        tree_entropy,
        """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(-sum(p * log2(p)), 6) AS bits FROM p WHERE p > 1e-8 GROUP BY user_id""",
    ),
    "best_question": (
        best_question,
        f"""WITH {TRIPHONES}, c AS (SELECT left_, base, sum(n) AS n FROM tri GROUP BY ALL), q AS (SELECT DISTINCT left_ AS question FROM c),
s AS (SELECT question, left_ = question AS yes, base, sum(n) AS n FROM q, c GROUP BY ALL),
h AS (SELECT question, yes, -sum(n / t * log2(n / t)) * any_value(t) AS h, any_value(t) AS t FROM (SELECT *, sum(n) OVER (PARTITION BY question, yes) AS t FROM s) GROUP BY question, yes),
whole AS (SELECT -sum(n / t * log2(n / t)) * any_value(t) AS h FROM (SELECT base, sum(n) AS n, sum(sum(n)) OVER () AS t FROM c GROUP BY base)),
g AS (SELECT question, (SELECT h FROM whole) - sum(h) AS gain FROM h GROUP BY question HAVING count(*) = 2)
SELECT question, round(gain, 4) AS gain FROM g ORDER BY gain DESC, question LIMIT 1""",
    ),
}
