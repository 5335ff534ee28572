"""Cutting the lineage of tables that iterations build on, and spreading rows that cost much each."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Partitions of gathered for each that spread would give.
SMALLER = 8


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir; where that is unset, a local master takes a temporary folder, a cluster its warehouse."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            local = sc.master == "local" or sc.master.startswith("local[")
            named = tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores at least: rows of few bytes that cost much time would else be coalesced into one task."""
    return df.repartition(_parts(df))


def gathered(df: DataFrame, key: str) -> DataFrame:
    """df, the rows of a key in one partition, over all cores at least; grouping by the key shuffles nothing more.

    Partitions are smaller than those of a grouping, SMALLER times as many, so that what a task collects needn't be spilled.
    """
    return df.repartition(SMALLER * _parts(df), key)


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
