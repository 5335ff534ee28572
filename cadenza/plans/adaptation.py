"""Queries of class-based adaptation: suppliers' lines are Gaussians of three streams, odd and even lines two speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptation as A
from .texts import _t

FIGURES = ("quantity", "discount", "tax")


def _sums(spark, sf_dir):
    """l_suppkey, stream, even, n, s, q."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("stream"), (F.col(f"l_{c}").cast("double") * (1 if c == "quantity" else 100)).alias("x")) for k, c in enumerate(FIGURES)]))
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 2 == 0).alias("even"), each.alias("v"))
    return rows.groupBy("l_suppkey", "v.stream", "even").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("v.x").alias("s"), F.sum(F.col("v.x") * F.col("v.x")).alias("q"))


def _accumulators(spark, sf_dir):
    """Gaussians of the odd lines in four classes, with the even lines as adaptation data."""
    sums = _sums(spark, sf_dir)
    odd = sums.filter("NOT even").select("l_suppkey", "stream", "n", (F.col("s") / F.col("n")).alias("m"), (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("v"))
    whole = odd.groupBy("l_suppkey").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("stream", "m"))), lambda x: x["m"]).alias("mean"))
    classes = A.regression_classes(whole, ["l_suppkey"], 2).select("l_suppkey", "class")
    even = sums.filter("even").select("l_suppkey", "stream", "n", F.array("s").alias("sums"))
    model = odd.select("l_suppkey", "stream", F.array("m").alias("mean"), F.array("v").alias("var"))
    return model.join(classes, "l_suppkey").join(even, ["l_suppkey", "stream"])


def class_transforms(spark, sf_dir):
    found = A.transforms(_accumulators(spark, sf_dir))
    return found.select("class", "stream", F.round(F.col("a")[0][0], 5).alias("slope"), F.round(F.col("b")[0], 4).alias("shift"))


def adapted_means(spark, sf_dir):
    """Means moved by their classes' transforms, and back by the inverse ones."""
    rows = _accumulators(spark, sf_dir)
    found = A.transforms(rows)
    there = A.adapted(rows.select("l_suppkey", "class", "stream", "mean", F.col("mean").alias("first")), found)
    back = A.adapted(there, A.inverse(found)).select("l_suppkey", "stream", F.round(F.abs(F.col("mean")[0] - F.col("first")[0]), 6).alias("off"))
    return there.join(back, ["l_suppkey", "stream"]).select("l_suppkey", "class", "stream", F.round(F.col("mean")[0], 4).alias("moved"), "off")


def averaged_sources(spark, sf_dir):
    """Two tied states for each three suppliers, of the suppliers' sums."""
    values = _sums(spark, sf_dir).filter("even").select(F.col("l_suppkey").alias("state"), F.col("stream").alias("place"), (F.col("s") / F.col("n")).alias("value"))
    supplier = _t(spark, sf_dir, "supplier")
    mapping = supplier.select(F.col("s_suppkey").alias("src"), F.explode(F.array(F.floor(F.col("s_suppkey") / 3), F.floor(F.col("s_suppkey") / 3) + 100000)).alias("dst"))
    return A.averaged_sources(values, mapping, "state").withColumn("value", F.round("value", 5))


CLASSES = """x AS (SELECT l_suppkey, l_orderkey % 2 = 0 AS even, stream, CASE stream WHEN 0 THEN l_quantity::DOUBLE WHEN 1 THEN l_discount::DOUBLE * 100 ELSE l_tax::DOUBLE * 100 END AS x FROM lineitem, range(3) t(stream)),
s AS (SELECT l_suppkey, stream, even, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL),
o AS (SELECT l_suppkey, stream, n, s / n AS m, q / n - (s / n) ** 2 AS v FROM s WHERE NOT even), w AS (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS k FROM o),
v1 AS (SELECT stream, sum(k * m) / sum(k) AS border, sum(k * m * m) / sum(k) - (sum(k * m) / sum(k)) ** 2 AS spread FROM w GROUP BY stream QUALIFY row_number() OVER (ORDER BY spread DESC, stream) = 1),
c1 AS (SELECT w.l_suppkey, CASE WHEN m > border THEN 1 ELSE 0 END AS c FROM w JOIN v1 USING (stream)),
v2 AS (SELECT c, stream, sum(k * m) / sum(k) AS border, sum(k * m * m) / sum(k) - (sum(k * m) / sum(k)) ** 2 AS spread FROM w JOIN c1 USING (l_suppkey) GROUP BY c, stream QUALIFY row_number() OVER (PARTITION BY c ORDER BY spread DESC, stream) = 1),
cl AS (SELECT w.l_suppkey, 2 * c + CASE WHEN m > border THEN 1 ELSE 0 END AS class FROM w JOIN c1 USING (l_suppkey) JOIN v2 USING (c, stream)),
ac AS (SELECT class, o.l_suppkey, o.stream, o.m, e.n / greatest(o.v, 1e-5) AS g, e.s / greatest(o.v, 1e-5) AS y FROM o JOIN cl USING (l_suppkey) JOIN s e ON e.l_suppkey = o.l_suppkey AND e.stream = o.stream AND e.even),
t AS (SELECT class, stream, (sum(g) * sum(y * m) - sum(g * m) * sum(y)) / (sum(g) * sum(g * m * m) - sum(g * m) ** 2) AS slope, (sum(g * m * m) * sum(y) - sum(g * m) * sum(y * m)) / (sum(g) * sum(g * m * m) - sum(g * m) ** 2) AS shift FROM ac GROUP BY ALL)"""

QUERIES = {
    "class_transforms": (class_transforms, f"WITH {CLASSES} SELECT class, CAST(stream AS INTEGER) AS stream, round(slope, 5) AS slope, round(shift, 4) AS shift FROM t"),
    "adapted_means": (
        adapted_means,
        f"WITH {CLASSES} SELECT l_suppkey, class, CAST(stream AS INTEGER) AS stream, round(slope * m + shift, 4) AS moved, CAST(0 AS DOUBLE) AS off FROM ac JOIN t USING (class, stream)",
    ),
    "averaged_sources": (
        averaged_sources,
        """WITH x AS (SELECT l_suppkey, stream AS place, avg(CASE stream WHEN 0 THEN l_quantity::DOUBLE WHEN 1 THEN l_discount::DOUBLE * 100 ELSE l_tax::DOUBLE * 100 END) AS v FROM lineitem, range(3) t(stream) WHERE l_orderkey % 2 = 0 GROUP BY ALL)
SELECT d.dst AS state, CAST(place AS INTEGER) AS place, round(avg(v), 5) AS value FROM x JOIN (SELECT s_suppkey, unnest([s_suppkey // 3, s_suppkey // 3 + 100000]) AS dst FROM supplier) d ON d.s_suppkey = x.l_suppkey GROUP BY ALL""",
    ),
}
