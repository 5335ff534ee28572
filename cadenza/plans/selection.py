"""Queries of Gaussian selection: classes of order lines are densities, lines the frames, line numbers the codebooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from .texts import _t


def _lines(spark, sf_dir):
    q, d, t = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100, F.col("l_tax").cast("double") * 100
    density = (F.floor(q / 5) * 4 + F.floor(d / 3)).cast("int")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 3).alias("cb"), density.alias("density"), F.array(q, d, t).alias("vec"))


def _densities(lines):
    of = lambda f, n: f(F.get("vec", F.lit(n)))
    return lines.groupBy("cb", "density").agg(F.array(*[of(F.avg, n) for n in range(3)]).alias("mean"), F.array(*[of(F.var_pop, n) for n in range(3)]).alias("var"))


def selected_densities(spark, sf_dir):
    """Each codebook's densities by how often they are the best of their leaf."""
    lines = _lines(spark, sf_dir)
    densities = _densities(lines)
    trees = S.box_trees(densities, "cb", 0.2, 2, floor=0.25)
    best = S.selected_densities(lines, densities, trees, "cb", ["l_orderkey", "l_linenumber", "l_partkey"], 1, 0.25)
    return best.groupBy("cb", "density").agg(F.count(F.lit(1)).alias("n"), F.sum("scored").alias("scored"), F.round(F.sum("score"), 2).alias("score"))


SQL = """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 3 AS cb, CAST(floor(l_quantity::DOUBLE / 5) * 4 + floor(l_discount::DOUBLE * 100 / 3) AS INTEGER) AS density, l_quantity::DOUBLE AS x0, l_discount::DOUBLE * 100 AS x1, l_tax::DOUBLE * 100 AS x2 FROM lineitem),
m AS (SELECT cb, density, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, greatest(var_pop(x0), 0.25) AS v0, greatest(var_pop(x1), 0.25) AS v1, greatest(var_pop(x2), 0.25) AS v2 FROM x GROUP BY ALL),
e AS (SELECT cb, density, 0 AS d, m0 - sqrt(-2 * v0 * ln(0.2)) AS a, m0 + sqrt(-2 * v0 * ln(0.2)) AS b FROM m UNION ALL SELECT cb, density, 1, m1 - sqrt(-2 * v1 * ln(0.2)), m1 + sqrt(-2 * v1 * ln(0.2)) FROM m UNION ALL SELECT cb, density, 2, m2 - sqrt(-2 * v2 * ln(0.2)), m2 + sqrt(-2 * v2 * ln(0.2)) FROM m),
p AS (SELECT cb, d, list_sort(list_concat(list(a), list(b)))[count(*) + 1] AS plane FROM e GROUP BY cb, d),
c AS (SELECT cb, d, plane FROM e JOIN p USING (cb, d) GROUP BY cb, d, plane QUALIFY row_number() OVER (PARTITION BY cb ORDER BY count(*) FILTER (a < plane AND b > plane), d) = 1),
l AS (SELECT cb, density, a <= plane AS low, b >= plane AS high FROM e JOIN c USING (cb, d)),
f AS (SELECT x.*, CASE d WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END >= plane AS up FROM x JOIN c USING (cb)),
s AS (SELECT f.cb, l_orderkey, l_linenumber, l_partkey, x0, x1, x2, m.density, -0.5 * (ln(2 * pi() * v0) + ln(2 * pi() * v1) + ln(2 * pi() * v2) + (x0 - m0) ** 2 / v0 + (x1 - m1) ** 2 / v1 + (x2 - m2) ** 2 / v2) AS ll,
  count(*) OVER w AS scored FROM f JOIN l ON l.cb = f.cb AND CASE WHEN up THEN high ELSE low END JOIN m ON m.cb = l.cb AND m.density = l.density
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, x0, x1, x2) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, x0, x1, x2 ORDER BY ll DESC, m.density) = 1)
SELECT cb, density, count(*) AS n, CAST(sum(scored) AS BIGINT) AS scored, round(sum(ll), 2) AS score FROM s GROUP BY cb, density"""

QUERIES = {"selected_densities": (selected_densities, SQL)}
