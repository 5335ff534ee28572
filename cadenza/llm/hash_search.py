"""Approximate nearest neighbours by cosine: multi-index hashing of learned, rotated binary codes.

A rotation learned on a bounded sample (iterative quantisation after a principal component projection) turns
each vector into a code of at most CODE bits, one sign a dimension. Codes are split into substrings of at most
PIECE bits; each shard of the vectors holds, for every substring, its values in order with the rows that
have them. A query probes the values near its own: by the pigeonhole principle a code within a Hamming radius
has at least one substring within its share of that radius, so every code within the radius is retrieved,
checked, and its vector ranked by the exact cosine.

The radius comes from the data: PROBES vectors are compared with all others exactly, and the least radius is
taken within which TARGET of their nearest neighbours lie. Queries that find fewer than k vectors within it are asked
again without a limit. Queries in blocks meet every shard; what a task holds is one block and one shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Bits of a code and of a substring at most; vectors of the sample, turns of the fit, vectors that set the radius, share of their neighbours within it.
CODE, PIECE, SAMPLE, TURNS, PROBES, TARGET = 64, 16, 4096, 30, 256, 0.96
#: Vectors of a shard, queries of a block, queries that are scored side by side.
SHARD, BLOCK, SIDE = 32768, 4096, 256

SHARDS = "dim int, shard long, ids binary, nos binary, points binary, codes binary"
BLOCKS = "dim int, block long, qids binary, qnos binary, q binary, codes binary"
FOUND = "dim int, query_no long, query_id long, no long, vec_id long, score double, distance int"


def real_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, no, dim, x (double) of the vectors that take part; no numbers the rows, once this is checkpointed."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        vectors.select("vec_id", "embedding")
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & whole)
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("x"))
        .withColumns({"dim": F.size("x"), "no": F.monotonically_increasing_id()})
    )


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that squares neither overflow nor vanish; cosines stay the same to the bit."""
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -e[:, None])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def learned_rotation(sample: np.ndarray, bits: int = CODE, turns: int = TURNS, seed: int = 7) -> np.ndarray:
    """A (dim, bits) projection whose signs are the code: principal components, turned so that they lie close to the signs."""
    x = _units(_scaled(sample))
    bits = min(bits, x.shape[1])
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    low = x @ axes
    for _ in range(turns):
        signs = np.where(low @ rotation > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ low)
        rotation = (u @ v).T
    return axes @ rotation


def binary_codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as substrings (rows, pieces) of 16 bits; bits beyond the projection are 0."""
    signs = (x @ projection > 0).astype(np.uint8)
    pieces = -(-signs.shape[1] // PIECE)
    padded = np.zeros((len(x), pieces * PIECE), dtype=np.uint8)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1).view(">u2").astype("<u2")


def piece_radii(radius: int, pieces: int) -> list[int]:
    """The radius of each substring, -1 for none: a code within radius is within at least one of them.

    If the first r % pieces + 1 substrings differ in more than r // pieces bits and the others in more than one fewer,
    the code differs in more than r bits.
    """
    share, more = divmod(radius, pieces)
    return [share if n <= more else share - 1 for n in range(pieces)]


class CodeIndex:
    """Substring tables over the codes of a shard."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for piece in codes.T:
            order = np.argsort(piece, kind="stable")
            values, starts = np.unique(piece[order], return_index=True)
            self.tables.append((order, values, np.append(starts, len(piece))))

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (ascending) whose codes lie within radius of code, and their distances."""
        if radius >= 16 * len(self.tables):
            rows = np.arange(len(self.codes))
        else:
            met = np.zeros(len(self.codes), dtype=bool)
            for (order, values, starts), own, limit in zip(self.tables, code, piece_radii(radius, len(self.tables)), strict=True):
                near = np.flatnonzero(np.bitwise_count(values ^ own) <= limit) if limit >= 0 else ()
                for n in near if len(near) < 64 else ():
                    met[order[starts[n] : starts[n + 1]]] = True
                if len(near) >= 64:
                    picked = np.zeros(len(values), dtype=bool)
                    picked[near] = True
                    met[order[np.repeat(picked, np.diff(starts))]] = True
            rows = np.flatnonzero(met)
        off = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1)
        return rows[off <= radius], off[off <= radius]


def _cosines(q: np.ndarray, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines of one query with rows x: every row is summed alone and in one order, so that equal rows have equal ones."""
    return (x * q).sum(axis=1) / (np.sqrt((q * q).sum()) * norms)


def nearest_in_shard(block: dict, shard: dict, k: int, radius: int) -> pd.DataFrame:
    """The k nearest of the shard's codes within radius, for each query of the block, by cosine, then id, then row."""
    dim = int(block["dim"])
    read = lambda row, name, kind="<i8": np.frombuffer(row[name], dtype=kind)
    ids, nos, x = read(shard, "ids"), read(shard, "nos"), _scaled(read(shard, "points", "<f8").reshape(-1, dim))
    qids, qnos, q = read(block, "qids"), read(block, "qnos"), _scaled(read(block, "q", "<f8").reshape(-1, dim))
    index, asked = CodeIndex(read(shard, "codes", "<u2").reshape(len(ids), -1)), read(block, "codes", "<u2").reshape(len(qids), -1)
    norms = np.sqrt((x * x).sum(axis=1))
    out = []
    for first in range(0, len(q), SIDE):
        # Rough cosines leave few rows for the exact ones; the margin is far above their rounding.
        rough = (_units(q[first : first + SIDE]) @ (x / norms[:, None]).T)
        for n, near in enumerate(rough, first):
            rows, off = index.within(asked[n], radius)
            other = nos[rows] != qnos[n]
            rows, off = rows[other], off[other]
            if len(rows) > k:
                bound = np.partition(near[rows], len(rows) - k)[len(rows) - k] - 1e-9
                rows, off = rows[near[rows] >= bound], off[near[rows] >= bound]
            score = _cosines(q[n], x[rows], norms[rows])
            best = np.lexsort((nos[rows], ids[rows], -score))[:k]
            named = {"query_no": qnos[n], "query_id": qids[n], "no": nos[rows[best]], "vec_id": ids[rows[best]], "score": score[best], "distance": off[best].astype(np.int32)}
            out.append(pd.DataFrame({"dim": np.int32(dim)} | named))
    return pd.concat(out)


def _dealt(rows: DataFrame, sizes: dict[int, int], most: int, name: str) -> DataFrame:
    """rows with name: their shard or block, of about most rows of one dimension."""
    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // most))) for d, n in sizes.items()])
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "no"), count))


def _sizes(rows: DataFrame) -> dict[int, int]:
    """Rows by dimension: one number for each distinct vector length."""
    return {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}


def coded(rows: DataFrame, projections: dict[int, np.ndarray], sizes: dict[int, int], most: int, name: str) -> DataFrame:
    """One row per shard (or block): ids, row numbers, vectors and codes."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["vec_id", "no"])
        dim = int(part["dim"].iloc[0])
        x = np.array(part["x"].tolist(), dtype=np.float64).reshape(len(part), dim)
        codes = binary_codes(_scaled(x), projections[dim])
        made = [part["vec_id"].to_numpy("<i8"), part["no"].to_numpy("<i8"), x.astype("<f8"), codes]
        return pd.DataFrame([[dim, int(part[name].iloc[0]), *(np.ascontiguousarray(y).tobytes() for y in made)]])

    schema = SHARDS if name == "shard" else BLOCKS
    return _dealt(rows, sizes, most, name).groupBy("dim", name).applyInPandas(pack, schema)


def _search(blocks: DataFrame, index: DataFrame, shards: dict[int, int], radii: dict[int, int], k: int) -> DataFrame:
    """FOUND rows of every block with every shard of its dimension."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        block = {"dim": row["dim"], "qids": row["qids"], "qnos": row["qnos"], "q": row["q"], "codes": row["asked"]}
        return nearest_in_shard(block, row.to_dict(), k, radii[int(row["dim"])])

    count = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // SHARD))) for d, n in shards.items()]).cast("long")
    pairs = blocks.withColumnRenamed("codes", "asked").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return pairs.join(index, ["dim", "shard"]).groupBy("dim", "block", "shard").applyInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    ordered = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("no"))
    return found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)


def _sample(rows: DataFrame, sizes: dict[int, int], most: int, seed: int) -> DataFrame:
    """About most rows of each dimension, the same ones in each run, picked by a hash of id and row."""
    share = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(1.0, most / n))) for d, n in sizes.items()])
    return rows.filter(F.pmod(F.xxhash64("vec_id", "no", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))


def fitted(rows: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The projection of each dimension, from a sample of about SAMPLE vectors; only samples come to the driver."""
    parts: dict[int, list] = {d: [] for d in sizes}
    for r in _sample(rows, sizes, SAMPLE, 1).select("dim", "vec_id", "no", "x").orderBy("vec_id", "no").collect():
        parts[r["dim"]].append(r["x"])
    return {d: learned_rotation(np.array(x) if x else np.eye(d)) for d, x in parts.items()}


def neighbours(vectors: DataFrame, is_query, k: int = 5, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest vectors found for each query, ties to the smaller id.

    is_query: a condition on vec_id. A query's candidates are the vectors of its dimension in all rows but its own;
    rows that repeat a vec_id are queries and candidates of their own. Every row is indexed; all codes within
    the radius are retrieved. Fewer than k candidates give all of them, none give no row. Vectors that are null,
    zero or hold null or non-finite components, and rows without vec_id, take no part. An empty table
    gives an empty result. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    rows = checkpoint(real_vectors(vectors))
    sizes = _sizes(rows)
    asked = rows.filter(is_query)
    asking = _sizes(asked)
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    projections = fitted(rows, sizes)
    index = checkpoint(coded(rows, projections, sizes, SHARD, "shard"))
    radii = _radii(rows, index, projections, sizes, k, target)
    blocks = checkpoint(coded(asked, projections, asking, BLOCK, "block"))
    first = checkpoint(_best(_search(blocks, index, sizes, radii, k), k).select("dim", "query_no", "query_id", "no", "vec_id", "score"))
    most = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(k, n - 1))) for d, n in sizes.items()])
    full = first.groupBy("query_no", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select(F.col("query_no").alias("no"))
    short = checkpoint(asked.join(full, "no", "left_anti").select("vec_id", "x", "dim", "no"))
    left = _sizes(short)
    if left:
        everything = {d: CODE for d in sizes}
        again = _best(_search(coded(short, projections, left, BLOCK, "block"), index, sizes, everything, k), k)
        done = first.join(short.select(F.col("no").alias("query_no")), "query_no", "left_anti")
        first = done.unionByName(again.select(*done.columns))
    return _best(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _radii(rows: DataFrame, index: DataFrame, projections: dict[int, np.ndarray], sizes: dict[int, int], k: int, target: float) -> dict[int, int]:
    """The radius of each dimension within which the share target of the nearest vectors of about PROBES sampled ones lie."""
    probes = _sample(rows, sizes, PROBES, 2)
    known = _sizes(probes)
    if not known:
        return {d: CODE for d in sizes}
    everything = {d: CODE for d in sizes}
    near = _best(_search(coded(probes, projections, known, BLOCK, "block"), index, sizes, everything, k), k)
    # At most PROBES * k rows a dimension, counted by distance.
    counts = near.groupBy("dim", "distance").agg(F.count(F.lit(1)).alias("n")).collect()
    radii = {}
    for d in sizes:
        own = sorted((r["distance"], r["n"]) for r in counts if r["dim"] == d)
        total, sum_ = sum(n for _, n in own), 0
        radii[d] = CODE
        for distance, n in own:
            sum_ += n
            if sum_ >= target * total:
                radii[d] = distance
                break
    return radii
