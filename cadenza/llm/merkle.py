"""Merkle manifest of documents: a tree per language, one over their roots, a proof and a checked fold per row.

Leaves are digests of rows. A global sort numbers them inside their language; aligned blocks of 2**BITS
neighbours are reduced in tasks to one digest each, and blocks of blocks again while there are more than TOP of
them. The small tree above is built on the driver, which broadcasts the suffix path of every top node; going
down again, the tasks of each block add the inner part of the path and fold it row by row.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Levels of a block (4,096 neighbours at most) and nodes that the driver may hold.
BITS, TOP = 12, 16384

NODES = "tree long, n long, idx long, digest string"
PATHS = "tree long, idx long, path array<string>, apex string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(digests: list[str], height: int) -> list[list[str]]:
    """The nodes of height + 1 levels; pairs become the hash of both, a last node alone the hash of itself."""
    levels = [digests]
    for _ in range(height):
        last = levels[-1]
        levels.append([_hash("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def _height(n: int) -> int:
    """Levels until n nodes are one."""
    return max(0, n - 1).bit_length()


def _siblings(levels: list[list[str]], place: int) -> list[str]:
    """The path of one node to the top of levels: < or > (the sibling's side) and its digest, or an empty text where there is none."""
    path = []
    for level in levels[:-1]:
        other = place ^ 1
        path.append(("<" if other < place else ">") + level[other] if other < len(level) else "")
        place >>= 1
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        leaf = _hash(step[1:] + leaf if step[:1] == "<" else leaf + step[1:])
    return leaf


def proof_digest(path: list[str]) -> str:
    return _hash("".join(step[1:] for step in path))


def _block_levels(rows: pd.DataFrame, bits: int) -> list[list[str]]:
    """rows: one block by idx. A tree of one block ends where a single node remains."""
    return _levels(rows["digest"].tolist(), min(bits, _height(int(rows["n"].iloc[0]))))


def reduced(nodes: DataFrame, bits: int) -> DataFrame:
    """The nodes bits levels above: one for each block of 2**bits neighbours."""

    def reduce_(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        tree, n, idx = int(rows["tree"].iloc[0]), int(rows["n"].iloc[0]), int(rows["idx"].iloc[0])
        return pd.DataFrame({"tree": [tree], "n": [-(-n >> bits)], "idx": [idx >> bits], "digest": _block_levels(rows, bits)[-1]})

    return nodes.groupBy("tree", F.shiftright("idx", bits).alias("block")).applyInPandas(reduce_, NODES)


def paths_up(nodes: DataFrame, bits: int = BITS, top: int = TOP) -> DataFrame:
    """tree, idx, path, apex: the path of each node to the apex of its tree.

    At most top nodes are taken to the driver, and their paths are marked for a broadcast; more are reduced
    in blocks first. Where more than top trees are left, of one node each, the paths are empty.
    """
    spark = nodes.sparkSession
    if len(nodes.select(F.lit(1)).take(top + 1)) <= top:
        trees: dict[int, list] = {}
        for r in nodes.collect():
            trees.setdefault(r["tree"], []).append((r["idx"], r["digest"]))
        rows = []
        for tree, found in trees.items():
            levels = _levels([d for _, d in sorted(found)], _height(len(found)))
            rows += [(tree, i, _siblings(levels, i), levels[-1][0]) for i in range(len(found))]
        return F.broadcast(spark.createDataFrame(rows, PATHS))
    if not nodes.filter("n > 1").take(1):
        return nodes.select("tree", "idx", F.array().cast("array<string>").alias("path"), F.col("digest").alias("apex"))
    above = paths_up(checkpoint(reduced(nodes, bits)), bits, top)

    def extend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        levels, suffix = _block_levels(rows, bits), list(rows["path"].iloc[0])
        paths = [_siblings(levels, i) + suffix for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "path": paths, "apex": rows["apex"]})

    up = above.select("tree", F.col("idx").alias("block"), "path", "apex")
    blocks = nodes.withColumn("block", F.shiftright("idx", bits)).join(up, ["tree", "block"])
    return checkpoint(blocks.groupBy("tree", "block").applyInPandas(extend, PATHS))


def _item(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(_item(F.col("doc_id")), _item(F.col("source")), _item(F.col("lang")), _item(n_chars), _item(F.col("text"))), 256)


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves with tree (a number of the language, in the order of languages), n (its leaves) and idx.

    One global sort by language, doc_id and digest; places come from the sorted partitions and a table of one row
    for each language and partition that meet. A language of many rows is spread over partitions.
    """
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), "digest", "no"]
    at = leaves.withColumn("no", F.monotonically_increasing_id()).orderBy(*order).drop("no")
    at = checkpoint(at.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}))
    runs = at.groupBy("part", "lang").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("lang")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("run_part"), F.col("lang").alias("run_lang"), F.min("first").over(whole).alias("tree"), F.sum("size").over(whole).alias("n"),
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    same = (F.col("part") == F.col("run_part")) & F.col("lang").eqNullSafe(F.col("run_lang"))
    return at.join(runs, same).select("doc_id", "tree", "n", (F.col("at") + F.col("shift")).alias("idx"), "digest", "tampered")


def manifest(docs: DataFrame, bits: int = BITS, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    subroot: the root of the row's language (null is one, the first). Where 7 divides the CRC-32 of doc_id, the
    folded leaf has n_chars + 1; verified tells whether the fold gives the root. Whole texts are hashed. A
    null doc_id is never tampered with, a null n_chars stays null, so that such rows verify. Rows that repeat a
    doc_id lie by digest, equal rows in any order. An empty table gives an empty result. Other columns are not read.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    named = docs.select("doc_id", "source", "lang", "n_chars", "text")
    leaves = named.select("doc_id", "lang", _leaf(F.col("n_chars")).alias("digest"), F.when(crc % 7 == 0, _leaf(F.col("n_chars") + 1)).alias("tampered"))
    rows = checkpoint(numbered(leaves))
    blocks = checkpoint(reduced(rows.select("tree", "n", "idx", "digest"), bits))
    up = paths_up(blocks, bits, top)
    # The subroots, in the order of languages, are the leaves of the last tree.
    subroots = checkpoint(up.filter("idx = 0").select("tree", "apex").orderBy("tree").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    sizes = subroots.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    line = Window.orderBy("part")  # one row a partition
    shift = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")
    sizes = sizes.select("part", shift.alias("shift"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("n"))
    last = subroots.join(sizes, "part").select("tree", "n", (F.col("at") + F.col("shift")).alias("idx"), F.col("apex").alias("digest"))
    tops = last.select(F.lit(0).cast("long").alias("tree"), "n", "idx", "digest")
    over = paths_up(tops, bits, top).select("idx", F.col("path").alias("rest"), F.col("apex").alias("root"))
    suffix = up.join(last.select("tree", F.col("idx").alias("place")), "tree").join(over.withColumnRenamed("idx", "place"), "place")
    suffix = checkpoint(suffix.select("tree", F.col("idx").alias("block"), F.concat("path", "rest").alias("suffix"), F.col("apex").alias("subroot"), "root"))
    if len(suffix.select(F.lit(1)).take(top + 1)) <= top:
        suffix = F.broadcast(suffix)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        levels, above, root = _block_levels(rows, bits), list(rows["suffix"].iloc[0]), rows["root"].iloc[0]
        paths = [_siblings(levels, i) + above for i in range(len(rows))]
        folded = [fold(d if t is None else t, p) for d, t, p in zip(rows["digest"], rows["tampered"], paths, strict=True)]
        known = {"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": rows["subroot"], "root": root}
        return pd.DataFrame(known | {"proof_sha256": [proof_digest(p) for p in paths], "folded_root": folded, "verified": [f == root for f in folded]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    placed = rows.withColumn("block", F.shiftright("idx", bits)).join(suffix, ["tree", "block"])
    return placed.groupBy("tree", "block").applyInPandas(finish, schema)


SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS no, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, doc_id, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
  FROM documents
), c AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda p: CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(p AS INTEGER), 1)) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))
    ), 4294967295) AS crc
  FROM d
), l AS (
  SELECT no, tree, doc_id,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND crc % 7 = 0 THEN sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || tail) END AS tampered
  FROM c
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM p
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), subroots AS (
  SELECT tree, digest FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, tree - 1 AS idx, count(*) OVER () AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 2, n
), steps AS (
  SELECT p.no, k.level, CASE WHEN s.digest IS NULL THEN '' WHEN s.idx < k.idx THEN '<' || s.digest ELSE '>' || s.digest END AS step
  FROM p JOIN nodes k ON k.tree = p.tree AND k.idx = p.idx >> k.level AND k.n > 1
  LEFT JOIN nodes s ON s.tree = k.tree AND s.level = k.level AND s.idx = xor(k.idx, 1)
  UNION ALL
  SELECT p.no, 1000 + k.level, CASE WHEN s.digest IS NULL THEN '' WHEN s.idx < k.idx THEN '<' || s.digest ELSE '>' || s.digest END
  FROM p JOIN upper k ON k.idx = (p.tree - 1) >> k.level AND k.n > 1
  LEFT JOIN upper s ON s.level = k.level AND s.idx = xor(k.idx, 1)
), proofs AS (
  SELECT no, list(step ORDER BY level) AS path FROM steps GROUP BY no
), f AS (
  SELECT p.doc_id, p.leaf, s.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
    sha256(array_to_string(list_transform(coalesce(path, []), lambda x: substr(x, 2)), '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])), lambda a, x: sha256(CASE WHEN x LIKE '<%' THEN substr(x, 2) || a ELSE a || substr(x, 2) END)) AS folded_root
  FROM p JOIN subroots s ON s.tree = p.tree LEFT JOIN proofs USING (no)
)
SELECT *, folded_root = root AS verified FROM f
"""
