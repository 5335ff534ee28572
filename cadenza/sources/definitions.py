"""Definition and topology files: which tied states and transitions each phone in context has, and which moves a model allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import lines, models

#: The version line, and what the counts of the header are called, in their order.
VERSION = "0.3"
COUNTS = ("n_base", "n_tri", "n_state_map", "n_tied_state", "n_tied_ci_state", "n_tied_tmat")


def _counted(definition: DataFrame) -> DataFrame:
    """One row of COUNTS: base phones, triphones, states with the final one of each model, tied states, those of base phones, transitions."""
    tied = definition.select(F.col("left").isNull().alias("ci"), F.explode("states").alias("s"))
    ids = tied.agg(F.countDistinct("s").alias("n_tied_state"), F.countDistinct(F.when(F.col("ci"), F.col("s"))).alias("n_tied_ci_state"))
    rows = definition.agg(
        F.count(F.when(F.col("left").isNull(), 1)).alias("n_base"), F.count("left").alias("n_tri"),
        F.coalesce(F.sum(F.size("states") + 1), F.lit(0)).alias("n_state_map"), F.countDistinct("tmat").alias("n_tied_tmat"),
    )
    return rows.crossJoin(ids).select(*COUNTS)


def definition_lines(definition: DataFrame) -> DataFrame:
    """line_no, line of a definition file: version, counts, then base phones before triphones, each in the order of id.

    definition: id, base, left, right, pos, attrib (null: n/a), tmat, states; base phones have null contexts. line_no
    ascends, with gaps between the partitions of the sort.
    """
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    states = F.array_join(F.transform("states", lambda s: F.format_string(" %6d", s)), "")
    text = F.concat(
        F.format_string("%5s %3s %3s %1s", F.col("base"), dash("left"), dash("right"), dash("pos")), F.format_string(" %6s", F.coalesce("attrib", F.lit("n/a"))),
        F.format_string(" %4d", F.col("tmat")), states, F.lit(" N"),
    )
    counts = _counted(definition)
    stack = F.array(F.lit(VERSION), *[F.concat_ws(" ", F.col(c).cast("string"), F.lit(c)) for c in COUNTS], F.lit("# base lft rt p attrib tmat states"))
    head = counts.select(F.posexplode(stack).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")
    body = definition.select(F.struct(F.col("left").isNotNull().alias("tri"), "id").alias("at"), text.alias("line"))
    places = body.orderBy("at").withColumn("n", F.monotonically_increasing_id())
    return head.unionByName(places.select((F.col("n") + len(COUNTS) + 2).alias("line_no"), "line"))


def checked_models(spark: SparkSession, path: str) -> DataFrame:
    """models of a definition file whose version and counts are right; otherwise an error that names the first wrong count."""
    found = models(spark, path)
    part = F.split(F.trim("line"), r"\s+", 2)
    told = lines(spark, path).select(part.alias("p")).filter(F.get("p", F.lit(1)).isin(*COUNTS)).agg(*[F.max(F.when(F.get("p", F.lit(1)) == c, F.get("p", F.lit(0)).try_cast("long"))).alias(f"told_{c}") for c in COUNTS])
    version = lines(spark, path).agg(F.max(F.when(F.trim("line") == VERSION, True)).alias("version"))
    own = lambda c: F.when(F.col(c) != "-", F.col(c))
    counts = _counted(found.select(F.lit(0).alias("id"), "base", own("lft").alias("left"), own("rt").alias("right"), "tmat", "states"))
    row = told.crossJoin(version).crossJoin(counts).first()  # one row of counts
    if not row["version"]:
        raise ValueError(f"no definition file of version {VERSION}")
    for c in COUNTS:
        if row[f"told_{c}"] != row[c]:
            raise ValueError(f"{c} is {row[c]}, the header has {row[f'told_{c}']}")
    return found


def topology(spark: SparkSession, path: str) -> DataFrame:
    """i, j, p of a topology file (version, number of states, a row of weights for each state but the last), rows made to sum to 1.

    A wrong version, fewer than two states, other than (n - 1) * n weights or a row without weight are errors.
    """
    words = [w for r in lines(spark, path).select("line").collect() for w in r["line"].split("#")[0].split()]  # a few numbers
    if not words or words[0] != "0.1":
        raise ValueError("no topology file of version 0.1")
    n = int(words[1]) if len(words) > 1 and words[1].isdigit() else 0
    if n < 2 or len(words) != 2 + (n - 1) * n:
        raise ValueError("not the weights of a topology of two states or more")
    rows = [[float(w) for w in words[2 + i * n : 2 + (i + 1) * n]] for i in range(n - 1)]
    if not all(sum(r) > 0 for r in rows):
        raise ValueError("a state without a way on")
    return spark.createDataFrame([(i, j, w / sum(r)) for i, r in enumerate(rows) for j, w in enumerate(r)], "i int, j int, p double")


def phone_name(base: Column, left: Column, right: Column, pos: Column) -> Column:
    """base, or base left right position with blanks between."""
    return F.when(left.isNull(), base).otherwise(F.concat_ws(" ", base, left, right, pos))
