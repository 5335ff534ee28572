"""Queries of the checking joins, the language model and further signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as G
from ..functions import text as T
from ..operators import corpus as C
from ..operators import language as L
from ..operators import validation as V
from .texts import LEX, TREE, WORDS, _lexicon, _t


def transcript_feature_join(spark, sf_dir):
    return V.with_reason(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


def skip_reasons(spark, sf_dir):
    rows = V.with_reason(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def exclusion_schedule(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    schedule = e.filter("event_type = 'error'").select(F.when(F.col("user_id") % 2 == 0, "*").otherwise("ci").alias("pass"), "user_id").filter("user_id % 3 = 0")
    return V.apply_exclusions(e.select("event_id", "user_id"), schedule, "user_id", "cd")


def artifact_coverage(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id")
    labels = _t(spark, sf_dir, "labels")
    parts = {"good": labels.filter("quality = 1"), "toxic": labels.filter("toxic = 1")}
    return V.coverage(d, parts, "doc_id")


def keyed_agreement(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("kind"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"))
    return V.keyed_agreement(first, last, ["user_id"], "kind")


def matched_pairs(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    per = lambda part: e.groupBy("user_id").agg(F.count(F.lit(1)).alias("ref_words"), F.sum(F.when(F.col("event_id") % 2 == part, 1).otherwise(0)).alias("errors"))
    return V.matched_pairs(per(0), per(1), "user_id", "ref_words")


def split_validation(spark, sf_dir):
    """A split of all documents in which every tenth id is moved back and every hundredth is unknown."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"))
    wrong = F.when(F.col("doc_id") % 100 == 7, -F.col("doc_id") - 1).when(F.col("doc_id") % 10 == 3, F.floor(F.col("doc_id") / 2)).otherwise(F.col("doc_id"))
    return V.split_problems(d, d.select(wrong.alias("doc_id"), "pos"), "doc_id", "pos")


def pronunciation_adjacency(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir)
    words = C.tokens(_t(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "pos", F.lower("token").alias("word"))
    return V.adjacency(words, lexicon, "item_id")


def all_triphones(spark, sf_dir):
    return V.reachable_triphones(_lexicon(spark, sf_dir))


def segmentation_check(spark, sf_dir):
    """Items whose words, joined, spell their text without white space: all of them must."""
    b = _t(spark, sf_dir, "benchmark")
    own = F.array_join(T.words(F.col("text")), "") == F.regexp_replace("text", r"\s+", "")
    return b.select("item_id", own.alias("agrees"))


def telemetry_gate(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    passes = e.groupBy((F.col("event_id") % 20).alias("pass")).agg(
        F.round(F.sum("value"), 4).alias("total_ll"), F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("event_type") != "error", 1)).alias("used"), F.count(F.when((F.col("event_type") == "error") & (F.col("event_id") % 20 != 7), 1)).alias("skipped"),
    )
    return V.telemetry_gate(passes, "pass")


def stale_outputs(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return V.stale(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase' AND value > 100"), "user_id", "ts")


def config_changes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    last = lambda kind: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max_by((F.col("event_id") % 3).cast("string"), "event_id").alias("value"))
    return V.changes(last("click"), last("view"))


def config_fingerprint(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return V.fingerprint(e.select(F.col("user_id").cast("string").alias("path"), (F.col("user_id") % 3).cast("string").alias("value")).distinct())


def language_model(spark, sf_dir):
    lm = L.model(_t(spark, sf_dir, "benchmark"), "text", 2)
    return lm.select("gram_order", "context", "word", F.round("log10p", 5).alias("log10p"))


def mel_scale(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.round(G.mel(F.col("value") * 10), 6).alias("mel"), F.round(G.hertz(G.mel(F.col("value") * 10)), 6).alias("hertz"))


def log_add_scores(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.round(G.log_add(-F.col("value"), -F.col("value") / 2), 6).alias("total"))


BIGRAMS = """s AS (SELECT list_concat(list_concat(['<s>'], {w}), ['</s>']) AS w FROM benchmark),
u AS (SELECT '' AS context, unnest(w) AS word FROM s), b AS (SELECT unnest(w[1:len(w) - 1]) AS context, unnest(w[2:]) AS word FROM s),
g AS (SELECT 1 AS gram_order, context, word, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT 2, context, word, count(*) FROM b GROUP BY ALL)""".format(
    w=WORDS.format("lower(text)")
)

QUERIES = {
    "transcript_feature_join": (
        transcript_feature_join,
        """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'no transcript' WHEN l.doc_id IS NULL THEN 'no features' ELSE 'ok' END AS reason
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
    ),
    "skip_reasons": (
        skip_reasons,
        """WITH r AS (SELECT CASE WHEN d.doc_id IS NULL THEN 'no transcript' WHEN l.doc_id IS NULL THEN 'no features' ELSE 'ok' END AS reason
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    ),
    "exclusion_schedule": (
        exclusion_schedule,
        """SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0 AND user_id % 2 = 0)""",
    ),
    "artifact_coverage": (
        artifact_coverage,
        """WITH p AS (SELECT doc_id, 'good' AS part FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
c AS (SELECT doc_id, count(*) AS times, string_agg(part, ',' ORDER BY part) AS parts FROM p GROUP BY doc_id)
SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, coalesce(times, 0) AS times, coalesce(parts, '') AS parts FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN c ON d.doc_id = c.doc_id
WHERE coalesce(times, 0) <> 1 OR d.doc_id IS NULL""",
    ),
    "keyed_agreement": (
        keyed_agreement,
        """WITH u AS (SELECT user_id, arg_min(event_type, event_id) AS a, arg_max(event_type, event_id) AS b FROM events GROUP BY user_id)
SELECT count(*) AS both, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM u""",
    ),
    "matched_pairs": (
        matched_pairs,
        """SELECT user_id, count(*) AS ref_words, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors,
CAST(sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS other_errors FROM events GROUP BY user_id""",
    ),
    "split_validation": (
        split_validation,
        """WITH s AS (SELECT CASE WHEN doc_id % 100 = 7 THEN -doc_id - 1 WHEN doc_id % 10 = 3 THEN doc_id // 2 ELSE doc_id END AS doc_id, doc_id AS pos FROM documents),
o AS (SELECT s.pos, d.doc_id AS place, lag(d.doc_id) OVER (ORDER BY s.pos) AS b FROM s JOIN documents d ON d.doc_id = s.doc_id),
p AS (SELECT 'repeated' AS problem FROM s GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'unknown' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'order' FROM o WHERE place < b)
SELECT problem, count(*) AS n FROM p GROUP BY problem""",
    ),
    "pronunciation_adjacency": (
        pronunciation_adjacency,
        f"""WITH b AS (SELECT item_id, {WORDS.format('lower(text)')} AS w FROM benchmark), t AS (SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM b)
SELECT a.item_id, CAST(a.pos AS INTEGER) AS pos, right(a.word, 1) AS phone, left(n.word, 1) AS next_phone FROM t a JOIN t n ON a.item_id = n.item_id AND n.pos = a.pos + 1""",
    ),
    "all_triphones": (
        all_triphones,
        f"""WITH {LEX}, s AS (SELECT word, string_split(word, '') AS p, length(word) AS size FROM lex),
e AS (SELECT p, size, unnest(range(size)) AS i FROM s),
o AS (SELECT DISTINCT p[i + 1] AS base, CASE WHEN i > 0 THEN p[i] END AS l, CASE WHEN i < size - 1 THEN p[i + 2] END AS r, CASE WHEN size = 1 THEN 's' WHEN i = 0 THEN 'b' WHEN i = size - 1 THEN 'e' ELSE 'i' END AS wpos FROM e),
ls AS (SELECT DISTINCT right(word, 1) AS ph FROM s UNION SELECT 'SIL'), fs AS (SELECT DISTINCT left(word, 1) AS ph FROM s UNION SELECT 'SIL')
SELECT DISTINCT base, coalesce(l, ls.ph) AS "left", coalesce(r, fs.ph) AS "right", wpos FROM o LEFT JOIN ls ON l IS NULL LEFT JOIN fs ON r IS NULL""",
    ),
    "segmentation_check": (segmentation_check, "SELECT item_id, TRUE AS agrees FROM benchmark"),
    "telemetry_gate": (
        telemetry_gate,
        """WITH p AS (SELECT event_id % 20 AS pass, round(sum(value), 4) AS total_ll, count(*) AS total, count(*) FILTER (event_type <> 'error') AS used,
count(*) FILTER (event_type = 'error' AND event_id % 20 <> 7) AS skipped FROM events GROUP BY ALL),
f AS (SELECT *, coalesce(total_ll < lag(total_ll) OVER (ORDER BY pass), FALSE) AS falls, used + skipped <> total AS uneven FROM p) SELECT * FROM f WHERE falls OR uneven""",
    ),
    "stale_outputs": (
        stale_outputs,
        """WITH i AS (SELECT user_id, max(ts) AS i FROM events WHERE event_type = 'click' GROUP BY user_id), o AS (SELECT user_id, min(ts) AS o FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY user_id)
SELECT coalesce(i.user_id, o.user_id) AS user_id, o IS NULL OR coalesce(i >= o, FALSE) AS stale FROM i FULL JOIN o ON i.user_id = o.user_id""",
    ),
    "config_changes": (
        config_changes,
        """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(arg_max(event_id, event_id) % 3 AS VARCHAR) AS v FROM events WHERE event_type = 'click' GROUP BY user_id),
b AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(arg_max(event_id, event_id) % 3 AS VARCHAR) AS v FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'remove' ELSE 'replace' END AS op, b.v AS value
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.v <> b.v""",
    ),
    "config_fingerprint": (
        config_fingerprint,
        f"WITH f0 AS (SELECT DISTINCT user_id || '=' || user_id % 3 AS line FROM events), {TREE}",
    ),
    "language_model": (
        language_model,
        f"""WITH {BIGRAMS}, t AS (SELECT *, sum(n) OVER (PARTITION BY gram_order, context) AS total, count(*) OVER (PARTITION BY gram_order, context) AS types FROM g)
SELECT gram_order, context, word, round(log10(n / (total + types)), 5) AS log10p FROM t""",
    ),
    "mel_scale": (
        mel_scale,
        "SELECT event_id, round(2595.0 * log10(1 + value * 10 / 700.0), 6) AS mel, round(700.0 * (pow(10.0, 2595.0 * log10(1 + value * 10 / 700.0) / 2595.0) - 1), 6) AS hertz FROM events",
    ),
    "log_add_scores": (
        log_add_scores,
        "SELECT event_id, round(-value / 2 + ln(1 + exp(-value / 2)), 6) AS total FROM events",
    ),
}

