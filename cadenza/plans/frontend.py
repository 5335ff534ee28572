"""Queries of the front end: a supplier's lines are its samples, a user's events its frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontend as FE
from .texts import _t

FRONT = FE.FrontEnd(rate=8000.0, frame_rate=250.0, window=0.008, fft=64, filters=12, low=200.0, high=3600.0, cepstra=8, lifter=22, dither=False, remove_noise=False)


def _audio(spark, sf_dir):
    """Each supplier's line quantities, in the order of orders, as a signal."""
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("long") * 600 - 15000).alias("x"))
    audio = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(at)).alias("s"))
    return audio.select("l_suppkey", F.col("s.x").alias("x"))


def mfcc_features(spark, sf_dir):
    rows = FE.cepstra(_audio(spark, sf_dir), "l_suppkey", "x", FRONT)
    return rows.select("l_suppkey", "frame", *[F.round(F.get("vec", F.lit(n)), 4).alias(f"c{n}") for n in range(FRONT.cepstra)])


def denoised_spectra(spark, sf_dir):
    """Speech flags and log spectra with the noise taken out."""
    front = FE.FrontEnd(**{**FRONT.__dict__, "remove_noise": True, "output": "raw", "speech_ratio": 0.9})
    rows = FE.cepstra(_audio(spark, sf_dir), "l_suppkey", "x", front)
    return rows.select("l_suppkey", "frame", "speech", F.concat_ws(" ", F.transform("vec", lambda v: F.format_string("%.3f", v))).alias("bands"))


def pitch_periods(spark, sf_dir):
    rows = FE.pitch(_audio(spark, sf_dir), "l_suppkey", "x", 8000.0, 64, 32, 0.6, 0.2, 2)
    return rows.select("l_suppkey", "frame", "period", F.round("difference", 6).alias("difference"), F.round("hertz", 4).alias("hertz"))


def endpointed_frames(spark, sf_dir):
    """Each user's events in order as frames, those above the user's mean value as speech."""
    e = _t(spark, sf_dir, "events").filter("value IS NOT NULL")
    at = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    each = e.groupBy("user_id").agg(at.alias("s"), F.expr("percentile(value, 0.4)").alias("level"))
    frames = each.select("user_id", "level", F.posexplode("s").alias("frame", "x")).select("user_id", "frame", (F.col("x.value") > F.col("level")).alias("speech"))
    return FE.endpointed(frames, "user_id", "speech", 2, 2, 3)


MEL = """s AS (SELECT l_suppkey, l_quantity::BIGINT * 600 - 15000 AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, lag(l_quantity::BIGINT * 600 - 15000, 1, 0) OVER w AS y
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)),
f AS (SELECT l_suppkey, n, unnest(range(CASE WHEN n >= 64 THEN (n - 64) // 32 + 2 ELSE 1 END)) AS frame FROM (SELECT DISTINCT l_suppkey, n FROM s)),
p AS (SELECT f.l_suppkey, frame, i - 32 * frame AS k, x - 0.97::DOUBLE * y AS v FROM f JOIN s ON s.l_suppkey = f.l_suppkey AND i BETWEEN 32 * frame AND 32 * frame + 63),
c AS (SELECT *, sum(v) OVER (PARTITION BY l_suppkey, frame) / 64 AS mean FROM p),
-- Where the frame is padded, the mean is taken from its zeros, too.
z AS (SELECT l_suppkey, frame, unnest(range(64)) AS k, mean FROM (SELECT DISTINCT l_suppkey, frame, mean FROM c)),
w AS (SELECT z.l_suppkey, z.frame, z.k, (coalesce(v, 0) - z.mean) * (0.54 - 0.46 * cos(2 * pi() * CASE WHEN z.k < 32 THEN z.k ELSE 63 - z.k END / 63)) AS v FROM z LEFT JOIN c USING (l_suppkey, frame, k)),
d AS (SELECT l_suppkey, frame, b, sum(v * cos(2 * pi() * b * k / 64)) ** 2 + sum(v * sin(2 * pi() * b * k / 64)) ** 2 AS power FROM w, range(0, 32) r(b) GROUP BY ALL),
m AS (SELECT m, floor(700 * (10 ** ((2595 * log10(1 + 200 / 700) + (m + j) * (2595 * log10(1 + 3600 / 700) - 2595 * log10(1 + 200 / 700)) / 13) / 2595) - 1) / 125 + 0.5) * 125 AS hz, j FROM range(0, 12) a(m), range(0, 3) c(j)),
e AS (SELECT m, max(hz) FILTER (j = 0) AS l, max(hz) FILTER (j = 1) AS t, max(hz) FILTER (j = 2) AS r FROM m GROUP BY m),
g AS (SELECT m, b, 2 / (r - l) * CASE WHEN t = l THEN (r - b * 125) / (r - t) WHEN r = t THEN (b * 125 - l) / (t - l) ELSE least((b * 125 - l) / (t - l), (r - b * 125) / (r - t)) END AS weight FROM e, range(0, 32) q(b) WHERE b * 125 BETWEEN l AND r),
q AS (SELECT l_suppkey, frame, m, sum(power * weight) AS e, ln(sum(power * weight) + 1e-4) AS v FROM d JOIN g USING (b) GROUP BY ALL)"""
MFCC_SQL = f"""WITH {MEL},
o AS (SELECT l_suppkey, frame, c, round(sum(v * cos(pi() / 12 * c * (m + 0.5))) * sqrt(CASE c WHEN 0 THEN 1 ELSE 2 END / 12) * (1 + 11 * sin(c * pi() / 22)), 4) AS v FROM q, range(0, 8) x(c) GROUP BY l_suppkey, frame, c)
SELECT l_suppkey, CAST(frame AS INTEGER) AS frame, """ + ", ".join(f"max(v) FILTER (c = {n}) AS c{n}" for n in range(8)) + " FROM o GROUP BY l_suppkey, frame"

#: The recursion of the estimates, one row a frame with a list for each of them.
DENOISED_SQL = f"""WITH RECURSIVE {MEL}, v AS (SELECT l_suppkey, frame, list(e ORDER BY m) AS e FROM q GROUP BY ALL),
a AS (SELECT l_suppkey, frame, e, e AS power, list_transform(e, lambda x: x / 20) AS noise, list_transform(e, lambda x: x / 20) AS low, list_transform(e, lambda x: 0.0::DOUBLE) AS peak, 0.0::DOUBLE AS loud, [0.0::DOUBLE] AS masked, false AS speech, -1 AS pos FROM v WHERE frame = 0
  UNION ALL
  SELECT l_suppkey, frame, e, power, noise, list_transform(range(1, 13), lambda k: CASE WHEN signal[k] >= low[k] THEN 0.995 * low[k] + 0.005 * signal[k] ELSE 0.5 * (low[k] + signal[k]) END),
    list_transform(range(1, 13), lambda k: greatest(0.85 * peak[k], signal[k])), now,
    list_transform(range(1, 13), lambda k: greatest(CASE WHEN signal[k] < 0.85 * 0.85 * peak[k] THEN 0.85 * peak[k] * 0.2 ELSE signal[k] END, CASE WHEN signal[k] >= low[k] THEN 0.995 * low[k] + 0.005 * signal[k] ELSE 0.5 * (low[k] + signal[k]) END)),
    list_max(list_transform(range(1, 13), lambda k: ln(power[k] / noise[k]))) >= 0.9 AND now - 8 <= ln(list_sum(signal)), frame
  FROM (SELECT *, CASE WHEN ln(list_sum(signal)) > loud THEN 0.9 ELSE 0.9995 END * loud + (1 - CASE WHEN ln(list_sum(signal)) > loud THEN 0.9 ELSE 0.9995 END) * ln(list_sum(signal)) AS now
    FROM (SELECT *, list_transform(range(1, 13), lambda k: greatest(power[k] - noise[k], 1.0)) AS signal
      FROM (SELECT l_suppkey, frame, e, power, low, peak, loud, list_transform(range(1, 13), lambda k: CASE WHEN power[k] >= noise[k] THEN 0.995 * noise[k] + 0.005 * power[k] ELSE 0.5 * (noise[k] + power[k]) END) AS noise
        FROM (SELECT v.l_suppkey, v.frame, v.e, list_transform(range(1, 13), lambda k: 0.7 * a.power[k] + 0.3 * v.e[k]) AS power, noise, low, peak, loud FROM a JOIN v ON v.l_suppkey = a.l_suppkey AND v.frame = a.pos + 1))))),
y AS (SELECT l_suppkey, pos, speech, e, list_transform(range(1, 13), lambda k: greatest(least(CASE WHEN masked[k] < 20 * power[k] THEN masked[k] / power[k] ELSE 20 END, 20), 0.05)) AS gain FROM a WHERE pos >= 0)
SELECT l_suppkey, CAST(pos AS INTEGER) AS frame, speech, array_to_string(list_transform(range(1, 13), lambda k: printf('%.3f', ln(e[k] * list_avg(list_slice(gain, greatest(k - 4, 1), least(k + 4, 12))) + 1e-4))), ' ') AS bands FROM y"""

PITCH_SQL = """WITH s AS (SELECT l_suppkey, l_quantity::BIGINT * 600 - 15000 AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
a AS (SELECT l_suppkey, list(x::DOUBLE ORDER BY i) AS x FROM s GROUP BY l_suppkey HAVING count(*) >= 64),
f AS (SELECT l_suppkey, x, unnest(range(1 + (len(x) - 64) // 32)) AS frame FROM a),
d AS (SELECT l_suppkey, frame, list_transform(range(32), lambda t: list_sum(list_transform(range(1, 33), lambda j: (x[32 * frame + j] - x[32 * frame + j + t]) ** 2))) AS d FROM f),
n AS (SELECT l_suppkey, frame, list_transform(range(32), lambda t: CASE WHEN t = 0 OR list_sum(d[1:t + 1]) = 0 THEN 1.0 ELSE d[t + 1] * t / list_sum(d[1:t + 1]) END) AS n FROM d),
o AS (SELECT *, coalesce(list_min(list_filter(range(32), lambda t: n[t + 1] < 0.6)), list_position(n, list_min(n)) - 1) AS p FROM n),
b AS (SELECT c.l_suppkey, c.frame, c.n, c.p, w.p AS near, w.n[w.p + 1] AS v FROM o c JOIN o w ON w.l_suppkey = c.l_suppkey AND w.frame BETWEEN c.frame - 2 AND c.frame + 2
  QUALIFY row_number() OVER (PARTITION BY c.l_suppkey, c.frame ORDER BY w.n[w.p + 1], w.frame <> c.frame, w.frame) = 1),
r AS (SELECT *, greatest(near - greatest(near * 2 // 10, 1), 0) AS lo, least(near + greatest(near * 2 // 10, 1), 32) AS hi FROM b),
z AS (SELECT l_suppkey, frame, CASE WHEN near = p THEN p ELSE coalesce(list_min(list_filter(range(lo, hi), lambda t: n[t + 1] < 0.6)), lo + list_position(n[lo + 1:hi], list_min(n[lo + 1:hi])) - 1) END AS period, near = p AS own, v, n FROM r)
SELECT l_suppkey, CAST(frame AS INTEGER) AS frame, CAST(period AS INTEGER) AS period, round(CASE WHEN own THEN v ELSE least(1.0, n[period + 1]) END, 6) AS difference,
  CASE WHEN period > 0 AND CASE WHEN own THEN v ELSE n[period + 1] END < 0.6 THEN round(8000 / period, 4) END AS hertz FROM z"""

ENDPOINTS_SQL = """WITH RECURSIVE l AS (SELECT user_id, quantile_cont(value, 0.4) AS level FROM events WHERE value IS NOT NULL GROUP BY user_id),
f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, value) - 1 AS INTEGER) AS frame, value > level AS speech FROM events JOIN l USING (user_id) WHERE value IS NOT NULL),
s AS (SELECT user_id, -1 AS frame, false AS talking, 0 AS before, 0 AS after, -1 AS segment, -1 AS silent, NULL::INTEGER AS began FROM l
  UNION ALL
  SELECT s.user_id, f.frame, CASE WHEN talking THEN NOT (NOT speech AND after + 1 >= 2) ELSE speech AND before + 1 >= 2 END, CASE WHEN talking OR NOT speech OR before + 1 >= 2 THEN 0 ELSE before + 1 END,
    CASE WHEN talking AND NOT speech AND after + 1 < 2 THEN after + 1 ELSE 0 END, CASE WHEN NOT talking AND speech AND before + 1 >= 2 THEN segment + 1 ELSE segment END,
    CASE WHEN talking AND NOT speech AND after + 1 >= 2 THEN f.frame ELSE silent END, CASE WHEN NOT talking AND speech AND before + 1 >= 2 THEN f.frame END
  FROM s JOIN f ON f.user_id = s.user_id AND f.frame = s.frame + 1)
SELECT user_id, frame, segment FROM s WHERE talking
UNION ALL SELECT user_id, CAST(unnest(range(greatest(began - 2, silent + 1, 0), began)) AS INTEGER), segment FROM s WHERE began IS NOT NULL"""

QUERIES = {
    "mfcc_features": (mfcc_features, MFCC_SQL),
    "denoised_spectra": (denoised_spectra, DENOISED_SQL),
    "pitch_periods": (pitch_periods, PITCH_SQL),
    "endpointed_frames": (endpointed_frames, ENDPOINTS_SQL),
}
