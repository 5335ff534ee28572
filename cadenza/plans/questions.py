"""Queries of question generation, leaf classes and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as Q
from .texts import _t

DEPTH = 3


def _order_statistics(spark, sf_dir):
    """Each priority's orders by status: counts, means and variances of two figures."""
    o = _t(spark, sf_dir, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("phone"), (F.col("o_totalprice").cast("double") / 1e5).alias("x"), (F.col("o_custkey") / 1000).alias("y"))
    each = o.groupBy(F.col("o_orderstatus").alias("state"), "phone").agg(F.count(F.lit(1)).cast("double").alias("n"), *[f(c).alias(f"{k}{c}") for k, f in (("m", F.avg), ("v", F.var_pop)) for c in "xy"])
    return each.select("state", "phone", "n", F.array("mx", "my").alias("mean"), F.array("vx", "vy").alias("var"))


def phone_trees(spark, sf_dir):
    """Trees of priorities by status, all bipartitions tried at every node."""
    trees = Q.phone_trees(_order_statistics(spark, sf_dir), "state", "phone")
    return trees.select("state", "depth", F.concat_ws(" ", "phones").alias("phones"), F.round("gain", 3).alias("gain"))


def question_sets(spark, sf_dir):
    """Sets of labels from trees by third of the vectors: more phones than clusters, so they are merged first."""
    e = _t(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("state"), "label", "embedding")
    width = e.select(F.max(F.size("embedding"))).first()[0]
    stats = e.groupBy("state", "label").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.avg(F.get("embedding", F.lit(d)).cast("double")) for d in range(width)]).alias("mean"),
        F.array(*[F.var_pop(F.get("embedding", F.lit(d)).cast("double")) for d in range(width)]).alias("var"),
    )
    return Q.question_sets(Q.phone_trees(stats, "state", "label"), "state")


def _outcomes(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("value IS NOT NULL")
    return e.select("event_type", "user_id", (F.col("event_id") % 2).cast("int").alias("state"), F.floor(F.log2(F.col("value") + 1)).cast("int").alias("outcome"))


def leaf_classes(spark, sf_dir):
    """Two classes of the five leaves of each event type."""
    counts = _outcomes(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 5).cast("int").alias("leaf"), "state", "outcome").agg(F.count(F.lit(1)).alias("n"))
    best = Q.two_classes(counts, "event_type", "leaf", "state", "outcome", "n", {0: 1.0, 1: 0.5})
    return best.select("event_type", F.concat_ws(" ", F.transform("leaves", lambda x: x.cast("string"))).alias("leaves"), F.round("gain", 4).alias("gain"))


def pruned_leaves(spark, sf_dir):
    """Events in the leaves of trees that ask for the bits of the user, pruned to 24 leaves in all."""
    e = _outcomes(spark, sf_dir)
    bit = lambda d: F.shiftright("user_id", d).bitwiseAND(F.lit(1).cast("long"))
    nodes = [F.lit(0).cast("long")]
    for d in range(DEPTH):
        nodes.append(nodes[-1] * 2 + 1 + bit(d))
    counted = e.select("event_type", "outcome", nodes[-1].alias("finest"), F.explode(F.array(*nodes)).alias("node")).groupBy("event_type", "node", "finest", "outcome").agg(F.count(F.lit(1)).alias("n"))
    n = counted.groupBy("event_type", "node", "outcome").agg(F.sum("n").alias("n"))
    total = n.groupBy("event_type", "node").agg(F.sum("n").alias("t"))
    mass = n.join(total, ["event_type", "node"]).groupBy("event_type", "node").agg((-F.sum(F.col("n") * F.log2(F.col("n") / F.col("t")))).alias("h"))
    below = mass.filter("node > 0").groupBy("event_type", F.floor((F.col("node") - 1) / 2).alias("node")).agg(F.sum("h").alias("below"), F.count(F.lit(1)).alias("sides")).filter("sides = 2")
    splits = mass.join(below, ["event_type", "node"]).select("event_type", "node", (F.col("h") - F.col("below")).alias("gain"))
    kept = Q.pruned(splits, "event_type", 24).filter(~F.col("removed")).groupBy("event_type").agg(F.collect_set("node").alias("splits"))
    finest = counted.filter(F.col("node") == F.col("finest")).groupBy("event_type", "finest").agg(F.sum("n").alias("n"))
    tied = finest.join(kept, "event_type", "left").withColumn("splits", F.coalesce("splits", F.array().cast("array<bigint>")))
    return tied.groupBy("event_type", Q.leaf_of(F.col("finest"), F.col("splits")).alias("leaf")).agg(F.sum("n").alias("n"))


MASS = "0.5 * n * (ln(greatest(xx / n - (x / n) ** 2, 1e-4)) + ln(greatest(yy / n - (y / n) ** 2, 1e-4)))"
OUTCOMES = "o AS (SELECT event_type, user_id, event_id % 2 AS state, CAST(floor(log2(value + 1)) AS INTEGER) AS outcome FROM events WHERE value IS NOT NULL)"

QUERIES = {
    "phone_trees": (
        phone_trees,
        f"""WITH RECURSIVE s AS (SELECT o_orderstatus AS state, substr(o_orderpriority, 1, 1) AS phone, CAST(count(*) AS DOUBLE) AS n, sum(x) AS x, sum(x * x) AS xx, sum(y) AS y, sum(y * y) AS yy
  FROM (SELECT *, CAST(o_totalprice AS DOUBLE) / 1e5 AS x, o_custkey / 1000 AS y FROM orders) GROUP BY ALL),
p AS (SELECT *, 1 << (row_number() OVER (PARTITION BY state ORDER BY phone) - 1) AS bit FROM s),
m AS (SELECT state, mask, string_agg(phone, ' ' ORDER BY phone) AS phones, count(*) AS size, sum(n) AS n, sum(x) AS x, sum(xx) AS xx, sum(y) AS y, sum(yy) AS yy FROM p, range(1, 32) r(mask) WHERE mask & bit > 0 GROUP BY state, mask HAVING sum(bit) = mask),
k AS (SELECT state, mask, phones, size, {MASS} AS mass FROM m),
b AS (SELECT a.state, a.mask, l.mask AS left_, r.mask AS right_, a.mass - l.mass - r.mass AS gain
  FROM k a JOIN k l ON l.state = a.state AND l.mask & a.mask = l.mask AND l.mask < a.mask JOIN k r ON r.state = a.state AND r.mask = a.mask - l.mask AND r.mask > l.mask
  QUALIFY row_number() OVER (PARTITION BY a.state, a.mask ORDER BY gain DESC) = 1),
t AS (SELECT state, max(mask) AS mask, 0 AS depth FROM k GROUP BY state
  UNION ALL SELECT t.state, unnest([left_, right_]), depth + 1 FROM t JOIN b USING (state, mask))
SELECT state, depth, phones, round(gain, 3) AS gain FROM t JOIN k USING (state, mask) LEFT JOIN b USING (state, mask)""",
    ),
    # Merging phones first is beyond short SQL: the tests hold it against plain loops.
    "question_sets": (question_sets, None),
    "leaf_classes": (
        leaf_classes,
        f"""WITH {OUTCOMES}, c AS (SELECT event_type, user_id % 5 AS leaf, state, outcome, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT mask, event_type, state, CASE WHEN mask = 0 THEN 0 WHEN mask & (1 << leaf) > 0 THEN 1 ELSE 2 END AS side, outcome, sum(n) AS n FROM c, range(0, 16) r(mask) GROUP BY ALL),
h AS (SELECT *, sum(n) OVER (PARTITION BY mask, event_type, state, side) AS t FROM g),
e AS (SELECT mask, event_type, sum(-n * log2(n / t) * CASE state WHEN 0 THEN 1.0 ELSE 0.5 END) AS h FROM h GROUP BY ALL),
b AS (SELECT a.event_type, a.mask, w.h - a.h AS gain FROM e a JOIN e w ON w.event_type = a.event_type AND w.mask = 0 WHERE a.mask > 0 QUALIFY row_number() OVER (PARTITION BY a.event_type ORDER BY gain DESC) = 1)
SELECT event_type, array_to_string(list_filter(range(5), lambda l: mask & (1 << l) > 0), ' ') AS leaves, round(gain, 4) AS gain FROM b""",
    ),
    "pruned_leaves": (
        pruned_leaves,
        f"""WITH {OUTCOMES}, f AS (SELECT event_type, outcome, 1 + (user_id & 1) AS n1, 3 + 2 * (user_id & 1) + ((user_id >> 1) & 1) AS n2, 7 + 4 * (user_id & 1) + 2 * ((user_id >> 1) & 1) + ((user_id >> 2) & 1) AS n3 FROM o),
c AS (SELECT event_type, unnest([0, n1, n2, n3]) AS node, outcome FROM f), g AS (SELECT event_type, node, outcome, count(*) AS n FROM c GROUP BY ALL),
m AS (SELECT event_type, node, sum(-n * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY event_type, node) AS t FROM g) GROUP BY ALL),
s AS (SELECT a.event_type, a.node, a.h - l.h - r.h AS gain FROM m a JOIN m l ON l.event_type = a.event_type AND l.node = 2 * a.node + 1 JOIN m r ON r.event_type = a.event_type AND r.node = 2 * a.node + 2),
q AS (SELECT s.event_type, s.node, max(b.gain) AS key FROM s JOIN s b ON b.event_type = s.event_type AND (b.node = s.node OR (b.node - 1) // 2 = s.node AND b.node > 0 OR (b.node > 2 AND ((b.node - 1) // 2 - 1) // 2 = s.node)) GROUP BY ALL),
k AS (SELECT * FROM q QUALIFY row_number() OVER (ORDER BY key, event_type, floor(log2(node + 1)) DESC, node) > count(*) OVER () + (SELECT count(DISTINCT event_type) FROM s) - 24)
SELECT event_type, CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.event_type = f.event_type AND node = 0) THEN 0 WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.event_type = f.event_type AND node = n1) THEN n1
  WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.event_type = f.event_type AND node = n2) THEN n2 ELSE n3 END AS leaf, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL""",
    ),
}
