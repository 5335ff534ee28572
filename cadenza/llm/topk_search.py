"""Exact top-k search by inner product: one KD-tree per shard of the vectors.

Vectors are dealt to shards by a hash of their id. Each shard becomes one row of an index table: a
balanced KD-tree (median splits on the widest dimension, leaves of LEAF points) with the tight box of
every node. Queries form blocks. Inside a shard the tree is walked best-first: every query holds a
frontier of nodes with the bounds of their boxes, sum(max(q*lo, q*hi)), takes the best one, opens it
or scores its points if it is a leaf, and stops once no bound reaches its kth score.

The kth score is propagated: each block first searches one home shard; the others follow in groups of
GROUP shards, one group a task at a time, in which every shard starts from the kth scores of those before it
and of the home shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Points of a leaf, vectors of a shard, queries of a block and shards of a group.
LEAF, SHARD, BLOCK, GROUP = 128, 16384, 2048, 8
#: The score of an absent place.
NONE = np.iinfo(np.int64).min

INDEX = "dim int, shard long, ids binary, nos binary, points binary, starts binary, lo binary, hi binary"
FOUND = "dim int, block long, query_no long, query_id long, no long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, no, dim, x: each component as floor(scale * component), in 64 bits; no numbers the rows.

    Vectors that are null or hold a null, infinite or NaN component take no part, nor do rows without
    vec_id. The numbers hold once this is checkpointed.
    """
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (
        vectors.select("vec_id", "embedding")
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & whole)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("x"))
        .withColumns({"dim": F.size("x"), "no": F.monotonically_increasing_id()})
    )


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dim)


def _build(ids: np.ndarray, nos: np.ndarray, points: np.ndarray) -> dict[str, bytes]:
    """A balanced tree in heap order: node n has the children 2n+1 and 2n+2; the last level are the leaves."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
    order = np.lexsort((nos, ids))
    spans, starts = [(0, len(ids))], [0]
    lows, highs = [], []
    for level in range(depth + 1):
        below = []
        for a, b in spans:
            part = points[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            lows.append(low)
            highs.append(high)
            if level < depth:
                middle = (b - a) // 2
                if points.shape[1]:
                    widest = int(np.argmax(high.astype(float) - low))
                    order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
                below += [(a, a + middle), (a + middle, b)]
        if level < depth:
            spans = below
    starts = [a for a, _ in spans] + [len(ids)]
    return {
        "ids": ids[order].astype("<i8").tobytes(),
        "nos": nos[order].astype("<i8").tobytes(),
        "points": points[order].astype("<i8").tobytes(),
        "starts": np.array(starts, dtype="<i8").tobytes(),
        "lo": np.array(lows, dtype="<i8").tobytes(),
        "hi": np.array(highs, dtype="<i8").tobytes(),
    }


def build_index(vectors: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """One row per shard; sizes: the number of vectors by dimension, which sets the number of shards."""
    shards = {dim: -(-n // SHARD) for dim, n in sizes.items()}

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        dim, shard = int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0])
        ids, nos = rows["vec_id"].to_numpy(np.int64), rows["no"].to_numpy(np.int64)
        return pd.DataFrame([{"dim": dim, "shard": shard} | _build(ids, nos, _matrix(rows["x"], dim))])

    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in shards.items()])
    return (
        vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "no"), count))
        .groupBy("dim", "shard")
        .applyInPandas(build, INDEX)
    )


def query_blocks(queries: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """dim, block, qids, qnos, q: about BLOCK queries as one row."""
    blocks = {dim: -(-n // BLOCK) for dim, n in sizes.items()}

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(rows["dim"].iloc[0]), int(rows["block"].iloc[0])
        rows = rows.sort_values(["vec_id", "no"])
        q = _matrix(rows["x"], dim).astype("<i8").tobytes()
        names = {"qids": rows["vec_id"].to_numpy("<i8").tobytes(), "qnos": rows["no"].to_numpy("<i8").tobytes()}
        return pd.DataFrame([{"dim": dim, "block": block} | names | {"q": q}])

    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in blocks.items()])
    return (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "no"), count))
        .groupBy("dim", "block")
        .applyInPandas(pack, "dim int, block long, qids binary, qnos binary, q binary")
    )


class Best:
    """The best k so far of every query of a block: scores, ids and row numbers; absent places have the score NONE."""

    def __init__(self, row: dict, k: int):
        read = lambda name: np.frombuffer(row[name], dtype="<i8")
        self.dim, self.block, self.ids, self.nos = int(row["dim"]), int(row["block"]), read("qids"), read("qnos")
        self.q = read("q").reshape(len(self.ids), self.dim)
        self.top = np.full((len(self.ids), k), NONE, dtype=np.int64)
        self.who, self.row = np.zeros_like(self.top), np.zeros_like(self.top)
        self.kth = self.top[:, -1].copy()
        if row.get("kth") is not None:
            self.kth = read("kth").copy()

    def take(self, sel: np.ndarray, score: np.ndarray, ids: np.ndarray, nos: np.ndarray) -> None:
        """Scores of the points (ids, nos) for the queries sel, ties to the smaller id, then row number."""
        score = np.where(self.nos[sel][:, None] == nos[None, :], NONE, score)
        some = (score >= self.kth[sel][:, None]).any(axis=1)
        sel, score = sel[some], score[some]
        if not len(sel):
            return
        wide = lambda x: np.broadcast_to(x, score.shape)
        top, who, row = (np.concatenate(x, axis=1) for x in ((self.top[sel], score), (self.who[sel], wide(ids)), (self.row[sel], wide(nos))))
        # The bitwise complement reverses the order without overflow.
        best = np.lexsort((row, who, ~top), axis=1)[:, : self.top.shape[1]]
        self.top[sel], self.who[sel], self.row[sel] = (np.take_along_axis(x, best, axis=1) for x in (top, who, row))
        self.kth[sel] = np.maximum(self.kth[sel], self.top[sel, -1])

    def found(self) -> pd.DataFrame:
        there, k = self.top != NONE, self.top.shape[1]
        of = lambda x: np.repeat(x, k)[there.ravel()]
        named = {"query_no": of(self.nos), "query_id": of(self.ids), "no": self.row[there], "vec_id": self.who[there], "score": self.top[there]}
        return pd.DataFrame({"dim": np.int32(self.dim), "block": self.block} | named)


def search(best: Best, shard: dict) -> None:
    """Take the points of one shard into best: best-first by the bounds of boxes, all queries of the block side by side."""
    read = lambda name: np.frombuffer(shard[name], dtype="<i8")
    ids, nos, starts, dim = read("ids"), read("nos"), read("starts"), best.dim
    q, points = best.q, read("points").reshape(len(ids), dim)
    lo, hi = read("lo").reshape(-1, dim), read("hi").reshape(-1, dim)
    largest = max([1.0, *(float(np.abs(x.astype(float)).max()) for x in (q, points) if x.size)])
    kind = np.float64 if largest * largest * max(1, dim) < 2**53 else np.int64  # exact either way
    q, points, lo, hi = (x.astype(kind) for x in (q, points, lo, hi))
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    inner = len(lo) - (len(starts) - 1)  # nodes before the leaves
    bound = lambda sel, nodes: ((plus[sel] * hi[nodes]).sum(axis=1) + (minus[sel] * lo[nodes]).sum(axis=1)).astype(np.int64)
    frontier = np.full((len(q), len(lo)), NONE, dtype=np.int64)
    everyone = np.arange(len(q))
    frontier[:, 0] = bound(everyone, np.zeros(len(q), dtype=np.int64))
    going = everyone
    while len(going):
        node = frontier[going].argmax(axis=1)
        reach = frontier[going, node]
        open_ = (reach != NONE) & (reach >= best.kth[going])
        going, node = going[open_], node[open_]
        frontier[going, node] = NONE
        inside = node < inner
        for child in (1, 2):
            sel, nodes = going[inside], 2 * node[inside] + child
            frontier[sel, nodes] = bound(sel, nodes)
        leaf, at = going[~inside], node[~inside] - inner
        for n in np.unique(at):
            sel = leaf[at == n]
            part = slice(starts[n], starts[n + 1])
            best.take(sel, (q[sel] @ points[part].T).astype(np.int64), ids[part], nos[part])


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller id.

    is_query: a condition on vec_id. A query's candidates are the vectors of its dimension in all rows but its
    own; rows that repeat a vec_id are queries and candidates of their own. Fewer than k candidates give fewer
    rows, none give none. Results are exact. An empty table gives an empty result. Only vec_id and embedding
    are read. Null or non-finite vectors take no part.
    """
    spark = vectors.sparkSession
    rows = checkpoint(whole_vectors(vectors, scale))
    asked = rows.filter(is_query)
    # One number per distinct vector length, not per row.
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    asking = {r["dim"]: r["n"] for r in asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = checkpoint(build_index(rows, sizes))
    blocks = checkpoint(query_blocks(asked, asking))
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // SHARD))) for d, n in sizes.items()]).cast("long")

    def some_shards(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard").to_dict("records")
        best = Best(part[0], k)
        for row in part:
            search(best, row)
        return best.found()

    home = blocks.withColumn("shard", F.pmod(F.col("block"), shards))
    first = checkpoint(home.join(index, ["dim", "shard"]).groupBy("dim", "block").applyInPandas(some_shards, FOUND))
    # The kth score of each query of a block, in the block's order; NONE where fewer than k were found.
    kth = first.groupBy("dim", "block", "query_id", "query_no").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(NONE).alias("s"))
    kth = kth.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("query_id", "query_no", "s"))).alias("ks"))

    def with_kth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                best = Best(row | {"kth": None}, k)
                known = {x["query_no"]: x["s"] for x in (row["ks"] if row["ks"] is not None else [])}
                out.append(np.array([known.get(no, NONE) for no in best.nos.tolist()], dtype="<i8").tobytes())
            yield batch.drop(columns="ks").assign(kth=out)

    known = blocks.join(kth, ["dim", "block"], "left").mapInPandas(with_kth, "dim int, block long, qids binary, qnos binary, q binary, kth binary")
    others = F.filter(F.sequence(F.lit(0).cast("long"), shards - 1), lambda n: n != F.pmod(F.col("block"), shards))
    pairs = known.withColumn("shard", F.explode(others)).join(index, ["dim", "shard"])
    rest = pairs.groupBy("dim", "block", F.floor(F.col("shard") / GROUP).alias("part")).applyInPandas(some_shards, FOUND)
    ordered = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("no"))
    return (
        first.unionByName(rest)
        .withColumn("rank", F.row_number().over(ordered))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.no AS no, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.no <> c.no
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
