"""Exact dedup with a heavy-hitter split.

Misra-Gries counters (the frequent-item summary behind ``DataFrame.stat.freqItems``) name the digests
that may be frequent; an exact count verifies them, and the verified winners, at most 1/support rows,
are broadcast, so that the copies of a frequent text never meet in one task. The remaining digests,
none of them frequent, take an ordinary shuffle. Texts themselves are read once and not shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, drop_rows, text_or_empty

#: Share of all rows from which a digest counts as frequent. Misra-Gries then holds 1/SUPPORT counters.
SUPPORT = 0.0005


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32 bytes of SHA-256 of each text; null counts as the empty text."""
    return docs.select("doc_id", F.unhex(F.sha2(text_or_empty(F.col("text")), 256)).alias("digest"))


def frequent_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """digest, keep_id, group_size of the digests with at least support of all rows, at most 1/support rows.

    freqItems returns every digest above the support (and may return others); the exact count over
    the candidates decides. Copies are combined before the shuffle, so a hot digest costs one row a task.
    """
    # As text: the counters compare keys by equals(), which byte arrays don't have.
    named = rows.select(F.hex("digest").alias("hex")).stat.freqItems(["hex"], support)
    candidates = named.select(F.explode("hex_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    counted = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    floor = rows.count() * support
    return counted.filter(F.col("group_size") >= floor)


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; of equal texts the row with the largest doc_id stays. A null text
    counts as empty. A null doc_id loses against any other. Rows that repeat both doc_id and text each
    count in group_size and share one verdict. An empty table gives an empty result. Only doc_id and
    text are read, so other columns of any name do no harm.
    """
    rows = checkpoint(digests(docs))
    winners = checkpoint(frequent_winners(rows, support))
    # The size of winners is bounded by 1/support (2,000 rows of 48 bytes at the default).
    hot = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest",
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return hot.select(rest.columns).unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """docs with one row of each text, that of the largest doc_id; every column stays.

    Rows are told apart by doc_id and text, so rows that share an id only don't share a verdict. Of rows
    that repeat both any one stays.
    """
    verdicts = checkpoint(exact_dedup(docs, support))
    digest = F.sha2(text_or_empty(docs["text"]), 256)
    key = {"doc_id": docs["doc_id"], "text_sha256": digest}
    dropped = verdicts.filter(~F.col("kept"))
    repeated = checkpoint(verdicts.filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if repeated.isEmpty():
        return drop_rows(docs, dropped, key)
    single = drop_rows(docs, dropped.select("doc_id", "text_sha256").union(repeated.select("doc_id", "text_sha256")), key)
    k_id, k_sha, k_digest = (f"k_{uuid.uuid4().hex}" for _ in range(3))
    named = repeated.select(F.col("doc_id").alias(k_id), F.col("text_sha256").alias(k_sha))
    same = docs["doc_id"].eqNullSafe(F.col(k_id)) & (digest == F.col(k_sha))
    # A null text and an empty one are equal, so the digest, not the text, tells repeats.
    one = docs.join(named, same, "left_semi").withColumn(k_digest, digest).dropDuplicates(["doc_id", k_digest]).drop(k_digest)
    return single.unionByName(one)


SQL = """
WITH d AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents
)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       text_sha256
FROM d
WINDOW g AS (PARTITION BY text_sha256)
"""
