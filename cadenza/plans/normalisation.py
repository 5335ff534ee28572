"""Query of codeword normalisation: a supplier's lines are its frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import normalisation as N
from .texts import _t

CODEBOOK = {
    "prob": np.array([0.1, 0.3, 0.3, 0.3]),
    "mean": np.array([[-4.0, 0.0, 0.0], [1.0, 0.5, -0.5], [3.0, -0.5, 0.5], [5.0, 0.0, 0.0]]),
    "var": np.array([[1.0, 0.5, 0.5], [0.8, 0.3, 0.3], [0.8, 0.3, 0.3], [0.8, 0.3, 0.3]]),
}


def codeword_normalisation(spark, sf_dir):
    """Noise and tilt of each supplier's lines, and the sums of its clean frames."""
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", F.array(F.col("l_quantity").cast("double") / 10, F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10).alias("v"))
    said = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(at)).alias("s")).select("l_suppkey", F.col("s.v").alias("frames"))
    rows = N.codeword_normalised(said, "l_suppkey", CODEBOOK)
    names = [F.round(F.first(F.get(c, F.lit(n))), 4).alias(f"{c}{n}") for c in ("noise", "tilt") for n in range(3)]
    return rows.groupBy("l_suppkey").agg(*names, F.round(F.first("likelihood"), 5).alias("likelihood"), *[F.round(F.sum(F.get("vec", F.lit(n))), 3).alias(f"sum{n}") for n in range(3)])


# The EM runs until each utterance's likelihood falls: beyond short SQL, the tests hold it against plain loops.
QUERIES = {"codeword_normalisation": (codeword_normalisation, None)}
