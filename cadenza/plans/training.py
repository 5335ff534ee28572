"""Queries of training from transcripts: orders are utterances, their lines the frames, status and priority the words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import training as R
from .texts import _t

LETTERS = "fop12345"


def _model():
    """One state a phone; x shares the tied state of silence. Two densities of two dimensions each."""
    s, m = np.meshgrid(np.arange(len(LETTERS) + 1), np.arange(2), indexing="ij")
    mean = np.stack([1 + (s * 7 % 5) * 0.9 + m * 0.5, 2 + (s * 3 % 7) - m * 1.5], axis=2)
    return {
        "states": {R.SILENCE: [0], "x": [0]} | {c: [n] for n, c in enumerate(LETTERS, 1)},
        "tmat": {R.SILENCE: 0, "x": 1} | dict.fromkeys(LETTERS, 1),
        "move": np.array([[[0.5, 0.5]], [[0.6, 0.4]]]),
        "weight": np.where(m == 0, 0.6, 0.4),
        "mean": mean,
        "var": np.repeat((1.5 + 0.25 * ((s + m) % 3))[:, :, None], 2, axis=2),
    }


def _said(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    words = F.array(F.lower("o_orderstatus"), F.substring("o_orderpriority", 1, 1))
    said = orders.select(F.col("o_orderkey").alias("key"), words.alias("words"))
    # A status may also be said with x behind it.
    known = said.select(F.explode("words").alias("word")).distinct()
    more = F.when(F.col("word").rlike("[a-z]"), F.array(F.array("word"), F.array("word", F.lit("x")))).otherwise(F.array(F.array("word")))
    lexicon = known.select("word", F.posexplode(more).alias("variant", "phones"))
    line = F.array(F.col("l_quantity").cast("double") / 10, F.col("l_discount").cast("double") * 100)
    frames = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("frame"), line.alias("vec"))
    return R.utterances(said, lexicon, frames, "key")


def transcript_statistics(spark, sf_dir):
    """One pass of forward-backward over all orders, orders without a path skipped."""
    rows = R.expectation(_said(spark, sf_dir), _model())
    of = lambda c, d: F.round(F.get(c, F.lit(d)), 3).alias({"sums": "s", "squares": "q"}[c] + str(d))
    return rows.select("kind", "a", "b", "c", F.round("n", 3).alias("n"), of("sums", 0), of("sums", 1), of("squares", 0), of("squares", 1))


def transcript_alignment(spark, sf_dir):
    """Forced alignment of all orders that have a path."""
    return R.align(_said(spark, sf_dir), "key", _model()).filter("seq IS NOT NULL").withColumn("score", F.round("score", 4))


GRAPH = f"""said AS (
  SELECT o_orderkey AS k, strpos('{LETTERS}', lower(o_orderstatus)) AS w1, strpos('{LETTERS}', substr(o_orderpriority, 1, 1)) AS w2, lower(o_orderstatus) AS p1, substr(o_orderpriority, 1, 1) AS p2 FROM orders
), fr AS (
  SELECT k, x0, x1, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, x0, x1) AS t, count(*) OVER (PARTITION BY k) AS nt
  FROM (SELECT l_orderkey AS k, l_linenumber, CAST(l_quantity AS DOUBLE) / 10 AS x0, CAST(l_discount AS DOUBLE) * 100 AS x1 FROM lineitem)
), arcs(src, dst, p) AS (
  VALUES (1, 1, 0.5::DOUBLE), (1, 2, 0.25), (1, 3, 0.25), (2, 2, 0.6), (2, 5, 0.4), (3, 3, 0.6), (3, 4, 0.4), (4, 4, 0.6), (4, 5, 0.4), (5, 5, 0.6), (5, 6, 0.2), (6, 6, 0.5)
), fin(slot, p) AS (VALUES (5, 0.2::DOUBLE), (6, 0.5)), places(slot) AS (VALUES (1), (2), (3), (4), (5), (6)),
dens AS (
  SELECT fr.k, t, nt, slot, s, m, x0, x1,
    CASE m WHEN 0 THEN 0.6 ELSE 0.4 END * exp(-0.5 * ((x0 - (1 + (s * 7 % 5) * 0.9 + m * 0.5)) ** 2 + (x1 - (2 + (s * 3 % 7) - m * 1.5)) ** 2) / (1.5 + 0.25 * ((s + m) % 3))) / (2 * pi() * (1.5 + 0.25 * ((s + m) % 3))) AS d
  FROM fr JOIN said USING (k), places, (VALUES (0), (1)) v(m), LATERAL (SELECT CASE slot WHEN 2 THEN w1 WHEN 3 THEN w1 WHEN 5 THEN w2 ELSE 0 END AS s)
), b AS MATERIALIZED (SELECT k, t, nt, slot, sum(d) AS b FROM dens GROUP BY ALL)"""

STATISTICS_SQL = f"""WITH RECURSIVE {GRAPH},
al AS (
  SELECT k, t, nt, slot, b AS v FROM b WHERE t = 1 AND slot = 1
  UNION ALL
  SELECT al.k, al.t + 1, al.nt, dst, sum(v * p) * any_value(b.b) FROM al JOIN arcs ON src = al.slot JOIN b ON b.k = al.k AND b.t = al.t + 1 AND b.slot = dst GROUP BY al.k, al.t, al.nt, dst
), be AS (
  SELECT k, t, slot, p AS v FROM b JOIN fin USING (slot) WHERE t = nt
  UNION ALL
  SELECT be.k, be.t - 1, src, sum(v * p * b.b) FROM be JOIN arcs ON dst = be.slot JOIN b ON b.k = be.k AND b.t = be.t AND b.slot = be.slot WHERE be.t > 1 GROUP BY be.k, be.t, src
), whole AS (SELECT k, nt, sum(v * p) AS z FROM al JOIN fin USING (slot) WHERE t = nt GROUP BY k, nt HAVING sum(v * p) > 0),
ga AS (SELECT al.k, al.t, al.slot, al.v * be.v / z AS g FROM al JOIN be USING (k, t, slot) JOIN whole USING (k)),
counts AS (
  SELECT 'density' AS kind, s AS a, m AS b, sum(g * d / b.b) AS n, sum(g * d / b.b * x0) AS s0, sum(g * d / b.b * x1) AS s1, sum(g * d / b.b * x0 * x0) AS q0, sum(g * d / b.b * x1 * x1) AS q1, 0 AS c
  FROM ga JOIN dens USING (k, t, slot) JOIN b USING (k, t, slot) GROUP BY s, m
  UNION ALL
  SELECT 'move', tm, 0, sum(n), NULL, NULL, NULL, NULL, c FROM (
    SELECT CASE WHEN src IN (1, 6) THEN 0 ELSE 1 END AS tm, CASE WHEN src = dst THEN 0 ELSE 1 END AS c, al.v * p * b.b * be.v / z AS n
    FROM al JOIN arcs ON src = al.slot JOIN be ON be.k = al.k AND be.t = al.t + 1 AND be.slot = dst JOIN b ON b.k = be.k AND b.t = be.t AND b.slot = dst JOIN whole ON whole.k = al.k
    UNION ALL
    SELECT CASE slot WHEN 6 THEN 0 ELSE 1 END, 1, g FROM ga JOIN whole USING (k) JOIN fin USING (slot) WHERE t = nt
  ) GROUP BY tm, c
  UNION ALL SELECT 'total', 0, 0, sum(ln(z)), NULL, NULL, NULL, NULL, 0 FROM whole
  UNION ALL SELECT 'total', 1, 0, sum(nt), NULL, NULL, NULL, NULL, 0 FROM whole
  UNION ALL SELECT 'total', 2, 0, count(*), NULL, NULL, NULL, NULL, 0 FROM whole
  UNION ALL SELECT 'total', 3, 0, (SELECT count(DISTINCT k) FROM fr JOIN said USING (k)) - count(*), NULL, NULL, NULL, NULL, 0 FROM whole
  UNION ALL SELECT 'total', 4, 0, (SELECT count(*) FROM said) - count(*), NULL, NULL, NULL, NULL, 0 FROM whole
)
SELECT kind, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, round(CAST(n AS DOUBLE), 3) AS n, round(s0, 3) AS s0, round(s1, 3) AS s1, round(q0, 3) AS q0, round(q1, 3) AS q1
FROM counts WHERE n > 0 OR kind <> 'total' OR a = 0"""

ALIGNMENT_SQL = f"""WITH RECURSIVE {GRAPH},
vi AS (
  SELECT k, t, nt, slot, ln(b) AS v, [slot] AS path FROM b WHERE t = 1 AND slot = 1
  UNION ALL
  SELECT vi.k, vi.t + 1, vi.nt, dst, max(v + ln(p)) + ln(any_value(b.b)), list_append(arg_max(path, v + ln(p)), dst) FROM vi JOIN arcs ON src = vi.slot JOIN b ON b.k = vi.k AND b.t = vi.t + 1 AND b.slot = dst GROUP BY vi.k, vi.t, vi.nt, dst
), best AS (SELECT k, max(v + ln(p)) AS score, arg_max(path, v + ln(p)) AS path FROM vi JOIN fin USING (slot) WHERE t = nt GROUP BY k),
frames AS (SELECT k, score, unnest(path) AS slot, unnest(range(len(path))) AS t FROM best),
segs AS (SELECT k, score, slot, min(t) AS s, max(t) AS e FROM frames GROUP BY ALL)
SELECT k AS key, CAST(row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS INTEGER) AS seq, CAST(CASE WHEN slot IN (1, 6) THEN NULL WHEN slot = 5 THEN 1 ELSE 0 END AS INTEGER) AS word,
  CASE WHEN slot IN (1, 6) THEN 'SIL' WHEN slot IN (2, 3) THEN p1 WHEN slot = 4 THEN 'x' ELSE p2 END AS phone, CAST(s AS INTEGER) AS start_frame, CAST(e AS INTEGER) AS end_frame, round(score, 4) AS score
FROM segs JOIN said USING (k)"""

QUERIES = {
    "transcript_statistics": (transcript_statistics, STATISTICS_SQL),
    "transcript_alignment": (transcript_alignment, ALIGNMENT_SQL),
}
