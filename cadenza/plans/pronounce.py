"""Queries of grapheme to phoneme: the words of all documents, with phones that a few spelling rules give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pronounce as P
from ..operators.lineage import cut
from .texts import _t

SIZES = {(1, 1): 0.5, (1, 0): 0.2, (2, 1): 0.2, (1, 2): 0.1}


def _entries(spark, sf_dir):
    """word, letters, phones: th and ch are one phone, x is two, a last e is silent, doubled letters are said once."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))).alias("word")
    lexicon = _t(spark, sf_dir, "documents").select(words).distinct()
    said = F.col("word")
    for pattern, new in (("th", "T"), ("ch", "C"), ("([a-z])\\1", "$1"), ("x", "ks"), ("(?<=.)e$", "")):
        said = F.regexp_replace(said, pattern, new)
    split = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return lexicon.select("word", split(F.col("word")).alias("letters"), split(said).alias("phones"))


def unit_expectations(spark, sf_dir):
    """Expected units of one pass, from chances by size."""
    found = P.expectation(_entries(spark, sf_dir), None, SIZES)
    return found.select("letters", "phones", F.round("n", 4).alias("n"))


def pronunciations(spark, sf_dir):
    """Phone errors of words that training didn't see: one word in five by its hash."""
    entries = cut(_entries(spark, sf_dir)).withColumn("held", F.crc32(F.col("word").cast("binary")) % 5 == 0)
    seen = entries.filter(~F.col("held"))
    chance = P.train(seen, 3)
    model = P.joint_model(P.joint_counts(P.aligned(seen, "word", chance), 3), 3)
    got = P.pronounced(entries.filter("held"), "word", model, 10).withColumnRenamed("phones", "said")
    both = entries.join(got, "word").select("word", F.array_join("phones", "").alias("want"), F.array_join(F.coalesce("said", F.array().cast("array<string>")), "").alias("said"))
    return both.withColumn("errors", F.levenshtein("want", "said"))


SQL = """WITH RECURSIVE w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS word FROM documents),
d AS (SELECT word, replace(replace(word, 'th', 'T'), 'ch', 'C') AS s FROM w),
e AS (SELECT word, regexp_replace(replace(list_reduce(list_prepend(s, string_split('abcdefghijklmnopqrstuvwxyz', '')), lambda a, c: replace(a, c || c, c)), 'x', 'ks'), '(.)e$', '\\1') AS said FROM d),
f AS (SELECT word, length(word) AS n, said, length(said) AS m FROM e),
al AS (SELECT word, n, m, 0 AS i, list_transform(range(m + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0 END) AS a, list_transform(range(m + 1), lambda j: 0.0::DOUBLE) AS b FROM f
  UNION ALL SELECT word, n, m, i + 1, list_transform(range(1, m + 2), lambda j: 0.2 * a[j] + CASE WHEN j > 1 THEN 0.5 * a[j - 1] + 0.2 * b[j - 1] ELSE 0 END + CASE WHEN j > 2 THEN 0.1 * a[j - 2] ELSE 0 END), a FROM al WHERE i < n),
be AS (SELECT word, n, m, n AS i, list_transform(range(m + 1), lambda j: CASE WHEN j = m THEN 1.0::DOUBLE ELSE 0 END) AS a, list_transform(range(m + 1), lambda j: 0.0::DOUBLE) AS b FROM f
  UNION ALL SELECT word, n, m, i - 1, list_transform(range(1, m + 2), lambda j: 0.2 * a[j] + CASE WHEN j <= m THEN 0.5 * a[j + 1] + 0.2 * b[j + 1] ELSE 0 END + CASE WHEN j < m THEN 0.1 * a[j + 2] ELSE 0 END), a FROM be WHERE i > 0),
z AS (SELECT word, a[m + 1] AS z FROM al WHERE i = n),
u AS (SELECT substr(f.word, CAST(al.i + 1 AS INTEGER), CAST(da AS INTEGER)) AS x, substr(said, CAST(j AS INTEGER), CAST(db AS INTEGER)) AS y, al.a[j] * p * be.a[j + db] / z AS c
  FROM f JOIN z USING (word) JOIN al USING (word), (VALUES (1, 1, 0.5), (1, 0, 0.2), (2, 1, 0.2), (1, 2, 0.1)) v(da, db, p), LATERAL (SELECT unnest(range(1, f.m + 2)) AS j) t JOIN be ON be.word = f.word AND be.i = al.i + da
  WHERE al.i + da <= f.n AND j + db <= f.m + 1 AND z > 0)
SELECT CASE WHEN length(x) = 2 THEN x[1] || '+' || x[2] ELSE x END AS letters, CASE length(y) WHEN 0 THEN '_' WHEN 2 THEN y[1] || '+' || y[2] ELSE y END AS phones, round(sum(c), 4) AS n FROM u WHERE c > 0 GROUP BY x, y
UNION ALL SELECT NULL, NULL, count(*)::DOUBLE FROM f LEFT JOIN z USING (word) WHERE coalesce(z, 0) = 0 HAVING count(*) > 0"""

QUERIES = {
    "unit_expectations": (unit_expectations, SQL),
    # EM, a joint model and a beam are beyond SQL: the tests hold each against enumeration.
    "pronunciations": (pronunciations, None),
}
