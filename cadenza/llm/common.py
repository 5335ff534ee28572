"""Helpers shared by the corpus operators: reading, checkpoints, folds, id filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word and its complement: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a batch that a Python worker holds; texts may be long.
BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; only where it is unset choose one.

    A local master gets a temporary folder; a cluster gets a folder in the (shared) warehouse.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master.startswith("local[") or sc.master == "local":
            named = tempfile.mkdtemp(prefix="checkpoints-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder: survives lost executors and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, after bounding the rows that the session hands to a Python worker at once; a smaller setting stays."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return docs


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def drop_rows(docs: DataFrame, rows: DataFrame, key: dict[str, Column]) -> DataFrame:
    """docs without the rows whose key (column of rows: expression over docs) is in rows; null equals null."""
    fresh = {c: f"k_{uuid.uuid4().hex}" for c in key}
    rows = rows.select(*[F.col(c).alias(k) for c, k in fresh.items()])
    same = [e.eqNullSafe(F.col(fresh[c])) for c, e in key.items()]
    return docs.join(rows, same, "left_anti")
