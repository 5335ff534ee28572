"""Gaussian selection by trees of bounding boxes: a leaf lists the densities whose boxes reach into it, and frames score only those.

Trees are built by codebook from a model's densities. Frames are dealt to blocks of their codebook, so that a codebook
with most of the frames is spread over tasks, and each block meets its codebook's tree and densities once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Frames of a block, blocks of a partition.
BLOCK, BLOCKS = 16384, 32


def boxes(mean: np.ndarray, var: np.ndarray, threshold: float, absolute: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper edges of each density: where one dimension alone brings it to threshold times its peak, or, absolute, to the log density threshold."""
    if absolute:
        whole = 0.5 * (mean.shape[1] * np.log(2 * np.pi) + np.log(var).sum(axis=1, keepdims=True))
        reach = np.sqrt(np.maximum(-2 * var * (threshold + whole), 0))
    else:
        reach = np.sqrt(-2 * var * np.log(threshold))
    return mean - reach, mean + reach


def _tree(low: np.ndarray, high: np.ndarray, levels: int) -> list[tuple]:
    """(node, dim, plane, members) in heap order: each node is cut at the median of its boxes' edges, in the dimension that cuts the fewest boxes."""
    out, open_ = [], [(0, low.min(axis=0), high.max(axis=0), levels)]
    while open_:
        node, lower, upper, left = open_.pop()
        members = np.flatnonzero(((low <= upper) & (high >= lower)).all(axis=1))
        if left == 1 or not len(members):
            out.append((node, None, None, members.tolist()))
            continue
        a, b = low[members], high[members]
        planes = np.sort(np.concatenate([a, b]), axis=0)[len(members)]
        cut = ((a < planes) & (b > planes)).sum(axis=0)
        dim = int(cut.argmin())
        out.append((node, dim, float(planes[dim]), members.tolist()))
        inner, outer = upper.copy(), lower.copy()
        inner[dim], outer[dim] = planes[dim], planes[dim]
        open_ += [(2 * node + 1, lower, inner, left - 1), (2 * node + 2, outer, upper, left - 1)]
    return sorted(out)


def box_trees(densities: DataFrame, codebook: str, threshold: float = 0.2, levels: int = 6, absolute: bool = False, floor: float = 1e-4) -> DataFrame:
    """codebook, node, dim, plane, densities: the nodes of each codebook's tree (children 2 n + 1 below the plane, 2 n + 2 from it on; dim null for leaves).

    densities: codebook, density, mean, var (arrays; not below floor). A relative threshold lies above 0, at most 1.
    """
    if not absolute and not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0, at most 1")
    kinds = {c: densities.schema[c].dataType.simpleString() for c in (codebook, "density")}

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("density")
        mean, var = (np.array(rows[c].tolist(), dtype=float) for c in ("mean", "var"))
        names = rows["density"].tolist()
        found = _tree(*boxes(mean, np.maximum(var, floor), threshold, absolute), levels)
        made = [(rows[codebook].iloc[0], n, d, p, [names[m] for m in members]) for n, d, p, members in found]
        return pd.DataFrame(made, columns=[codebook, "node", "dim", "plane", "densities"], dtype=object)

    named = densities.select(codebook, "density", "mean", "var")
    return named.groupBy(codebook).applyInPandas(build, f"{codebook} {kinds[codebook]}, node int, dim int, plane double, densities array<{kinds['density']}>")


def leaves_of(x: np.ndarray, nodes: dict[int, tuple]) -> np.ndarray:
    """The leaf of each frame; nodes: number to (dim, plane), dim None for leaves."""
    at = np.zeros(len(x), dtype=int)
    moving = np.arange(len(x))
    while len(moving):
        here = at[moving]
        go = []
        for n in np.unique(here):
            dim, plane = nodes[int(n)]
            if dim is None or dim != dim:  # nulls among numbers arrive as NaN
                continue
            who = moving[here == n]
            at[who] = 2 * n + 1 + (x[who, int(dim)] >= plane)
            go.append(who)
        moving = np.concatenate(go) if go else np.zeros(0, dtype=int)
    return at


def selected_densities(frames: DataFrame, densities: DataFrame, trees: DataFrame, codebook: str, keys: list[str], top: int = 1, floor: float = 1e-4, block: int = BLOCK) -> DataFrame:
    """keys, codebook, rank, density, score, scored: the top densities of each frame among those of its leaf; scored is their number.

    frames: keys, codebook, vec. Ties go to the lower density. A frame whose leaf is empty, or whose codebook has no
    tree, has no row. score is the log density.
    """
    kind = lambda c: frames.schema[c].dataType.simpleString()
    density_kind = densities.schema["density"].dataType.simpleString()
    blocks = cut(frames.groupBy(codebook).agg(F.count(F.lit(1)).alias("frames")).select(codebook, F.ceil(F.col("frames") / block).alias("blocks")))
    # Partitions grow with the frames, so that no task reads more of them in a larger table.
    parts = max(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(blocks.agg(F.sum("blocks")).first()[0] or 0) // BLOCKS))
    dealt = frames.select(*keys, codebook, "vec").join(blocks, codebook).withColumn("block", F.pmod(F.xxhash64(*keys), F.col("blocks"))).drop("blocks")
    model = densities.groupBy(codebook).agg(F.array_sort(F.collect_list(F.struct("density", "mean", "var"))).alias("g"))
    nodes = trees.groupBy(codebook).agg(F.collect_list(F.struct("node", "dim", "plane", "densities")).alias("t"))
    known = blocks.join(model, codebook).join(nodes, codebook).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    known = known.select(F.col(codebook).alias("own_codebook"), F.col("block").alias("own_block"), "g", "t")
    columns = [*keys, codebook, "rank", "density", "score", "scored"]

    def score(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return pd.DataFrame(columns=columns)
        g, tree = own["g"].iloc[0], own["t"].iloc[0]
        names = [d["density"] for d in g]
        place = {d: n for n, d in enumerate(names)}
        mean, var = (np.array([list(d[c]) for d in g], dtype=float) for c in ("mean", "var"))
        var = np.maximum(var, floor)
        x = np.array(rows["vec"].tolist(), dtype=float)
        leaf = leaves_of(x, {t["node"]: (t["dim"], t["plane"]) for t in tree})
        members = {t["node"]: np.array([place[d] for d in t["densities"]], dtype=int) for t in tree}
        out = []
        for n in np.unique(leaf):
            some, at = members[int(n)], np.flatnonzero(leaf == n)
            if not len(some):
                continue
            ll = np.stack([-0.5 * (np.log(2 * np.pi * var[m]).sum() + ((x[at] - mean[m]) ** 2 / var[m]).sum(axis=1)) for m in some], axis=1)
            best = np.argsort(-ll, axis=1, kind="stable")[:, :top]
            taken = rows.iloc[np.repeat(at, best.shape[1])][[*keys, codebook]].reset_index(drop=True)
            taken["rank"] = np.tile(np.arange(1, best.shape[1] + 1), len(at))
            taken["density"] = [names[m] for m in some[best].ravel()]
            taken["score"], taken["scored"] = np.take_along_axis(ll, best, axis=1).ravel(), len(some)
            out.append(taken)
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    schema = ", ".join(f"{c} {kind(c)}" for c in [*keys, codebook]) + f", rank int, density {density_kind}, score double, scored int"
    dealt, known = dealt.repartition(parts, codebook, "block"), known.repartition(parts, "own_codebook", "own_block")
    return dealt.groupBy(codebook, "block").cogroup(known.groupBy("own_codebook", "own_block")).applyInPandas(score, schema)
