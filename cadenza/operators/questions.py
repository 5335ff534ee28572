"""Questions made from data: sets of phones from Gaussians, two classes of leaves as a compound question, pruned trees.

Statistics come from DataFrame aggregates and have one row for each phone or leaf of a state; every state (or tree) is
a group of its own, as large as the phone set or the leaves of one tree, never as the data.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 1e-4
#: Clusters whose bipartitions are all tried, and leaves whose subsets are: 2 ** (n - 1) - 1 of them.
CLUSTERS, LEAVES = 8, 16


def _bipartitions(n: int) -> np.ndarray:
    """All (2 ** (n - 1) - 1, n) ways to put n items into two classes, both used; the last item is in class 0."""
    masks = np.arange(1, 1 << (n - 1), dtype=np.int64)
    return (masks[:, None] >> np.arange(n) & 1).astype(float)


def _mass(n: np.ndarray, first: np.ndarray, second: np.ndarray, floor: float) -> np.ndarray:
    """Half the count-weighted sum of log variances of pooled Gaussians, from counts and sums of x and x * x."""
    mean = first / n[..., None]
    return 0.5 * n * np.log(np.maximum(second / n[..., None] - mean * mean, floor)).sum(axis=-1)


def _clusters(n: np.ndarray, first: np.ndarray, second: np.ndarray, most: int, floor: float) -> list[list[int]]:
    """Items merged two by two, least loss of likelihood first (ties: the first pair), until most clusters are left."""
    members = [[i] for i in range(len(n))]
    n, first, second = n.copy(), first.copy(), second.copy()
    while len(members) > most:
        own = _mass(n, first, second, floor)
        a, b = np.triu_indices(len(members), 1)
        loss = _mass(n[a] + n[b], first[a] + first[b], second[a] + second[b], floor) - own[a] - own[b]
        x, y = a[loss.argmin()], b[loss.argmin()]
        keep = [i for i in range(len(members)) if i not in (x, y)]
        members = [members[i] for i in keep] + [members[x] + members[y]]
        n, first, second = (np.concatenate([v[keep], [v[x] + v[y]]]) for v in (n, first, second))
    return members


def _split(items: list[int], n: np.ndarray, first: np.ndarray, second: np.ndarray, most: int, floor: float) -> tuple[list[int], list[int], float]:
    """The best bipartition of the items' clusters and its gain; ties go to the first one."""
    at = np.array(items)
    groups = _clusters(n[at], first[at], second[at], most, floor)
    pooled = [np.stack([v[at[g]].sum(axis=0) for g in groups]) for v in (n, first, second)]
    one = _bipartitions(len(groups))
    sides = [_mass(*(m @ v for v in pooled), floor) for m in (one, 1 - one)]
    gain = _mass(*(v.sum(axis=0) for v in pooled), floor) - sides[0] - sides[1]
    best = int(gain.argmax())
    left = [items[i] for g, c in zip(groups, one[best], strict=True) if c for i in g]
    right = [items[i] for g, c in zip(groups, one[best], strict=True) if not c for i in g]
    return left, right, float(gain[best])


def phone_trees(stats: DataFrame, state: str, phone: str, clusters: int = CLUSTERS, floor: float = FLOOR) -> DataFrame:
    """state, node, depth, phones (sorted), gain: a tree of phone sets for each state, by splitting in two down to single phones.

    stats: state, phone, n, mean, var (arrays). A node's phones are merged until clusters are left, all their
    bipartitions are tried, and both sides are split in turn. Nodes are numbered as in a heap: 2 n + 1 and 2 n + 2 below n
    (as texts, since the tree may be deep: 0 for left and 1 for right below the root r). gain is null for single phones. Phones without a count take no part.
    """
    kind = stats.schema[state].dataType.simpleString()

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(phone)
        n, mean, var = (np.array(rows[c].tolist(), dtype=float) for c in ("n", "mean", "var"))
        first, second = n[:, None] * mean, n[:, None] * (var + mean * mean)
        names, out, open_ = rows[phone].tolist(), [], [("r", list(range(len(rows))))]
        while open_:
            node, items = open_.pop()
            gain = None
            if len(items) > 1:
                left, right, gain = _split(items, n, first, second, clusters, floor)
                open_ += [(node + "0", left), (node + "1", right)]
            out.append((rows[state].iloc[0], node, len(node) - 1, sorted(str(names[i]) for i in items), gain))
        return pd.DataFrame(out, columns=[state, "node", "depth", "phones", "gain"])

    known = stats.filter(F.col("n") > 0).select(state, phone, "n", "mean", "var")
    return known.groupBy(state).applyInPandas(grow, f"{state} {kind}, node string, depth int, phones array<string>, gain double")


def question_sets(trees: DataFrame, state: str, single_depth: int = 3) -> DataFrame:
    """question, phones, states, best_gain: the distinct sets below the roots; single phones deeper than single_depth are left out.

    Questions are numbered by size, then phones; states is the number of trees that hold the set.
    """
    sets = trees.filter((F.col("depth") > 0) & ((F.size("phones") > 1) | (F.col("depth") <= single_depth)))
    found = sets.groupBy("phones").agg(F.countDistinct(state).alias("states"), F.max("gain").alias("best_gain"))
    # One row a set: few more than phones times states.
    number = F.row_number().over(Window.orderBy(F.size("phones"), "phones")) - 1
    return found.select(F.concat(F.lit("QUESTION"), number.cast("string")).alias("question"), "phones", "states", "best_gain")


def _entropies(counts: np.ndarray) -> np.ndarray:
    """Count-weighted entropy in bits of the last axis; shares up to 1e-8 add nothing."""
    total = counts.sum(axis=-1, keepdims=True)
    share = counts / np.where(total > 0, total, 1)
    return -(counts * np.log2(np.where(share > 1e-8, share, 1))).sum(axis=-1)


def two_classes(counts: DataFrame, tree: str, leaf: str, state: str, outcome: str, n: str, weights: dict | None = None) -> DataFrame:
    """tree, leaves (of the class without the last leaf), gain: the two classes of a tree's leaves of the highest gain.

    Every subset is tried. The gain is the entropy of all less those of both classes, summed over states by their
    weights (by default equal). counts: tree, leaf, state, outcome, n, of up to LEAVES leaves a tree, which simple trees are cut to
    before: more are an error. A tree of one leaf has no row; ties go to the first subset, leaves in their order.
    """
    kind, leaf_kind = (counts.schema[c].dataType.simpleString() for c in (tree, leaf))
    summed = counts.groupBy(tree, leaf, state, outcome).agg(F.sum(n).cast("double").alias("n"))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        leaves = sorted(rows[leaf].unique())
        if len(leaves) > LEAVES:
            raise ValueError(f"more than {LEAVES} leaves")
        states, outcomes = sorted(rows[state].unique()), sorted(rows[outcome].unique())
        table = np.zeros((len(leaves), len(states), len(outcomes)))
        at = [pd.Index(x).get_indexer(rows[c]) for x, c in ((leaves, leaf), (states, state), (outcomes, outcome))]
        np.add.at(table, tuple(at), rows["n"].to_numpy())
        if len(leaves) < 2:
            return pd.DataFrame(columns=[tree, "leaves", "gain"])
        one, weight = _bipartitions(len(leaves)), np.array([(weights or {}).get(s, 1.0) for s in states])
        sides = [_entropies(np.einsum("ml,lso->mso", m, table)) for m in (one, 1 - one)]
        gain = ((_entropies(table.sum(axis=0)) - sides[0] - sides[1]) * weight).sum(axis=1)
        pick = int(np.flatnonzero(gain >= gain.max() - 1e-9 * max(1.0, abs(gain.max())))[0])
        return pd.DataFrame([(rows[tree].iloc[0], [x for x, c in zip(leaves, one[pick], strict=True) if c], float(gain[pick]))], columns=[tree, "leaves", "gain"])

    return summed.groupBy(tree).applyInPandas(best, f"{tree} {kind}, leaves array<{leaf_kind}>, gain double")


# --- compound questions ------------------------------------------------------------------------------

#: A term is a set of (question, negated), all of which must hold; a compound question is a list of terms, any of which.
Term = frozenset


def simplified(terms: list[Term]) -> list[Term]:
    """An equivalent list: contradictions go, terms that differ in one sign lose that question, terms that hold another go.

    Repeated until nothing changes; the result is sorted, so that equal questions are written alike.
    """
    now = {t for t in terms if not any((q, not s) in t for q, s in t)}
    while True:
        # A question that another term has with the other sign is needless where the rest of that term holds, too.
        shorter = {Term(t - {p}) if (p := next((p for p in sorted(t) if any((p[0], not p[1]) in o and o - {(p[0], not p[1])} <= t - {p} for o in now)), None)) else t for t in now}
        kept = {t for t in shorter if not any(o < t for o in shorter)}
        if kept == now:
            return sorted(now, key=lambda t: (len(t), sorted(t)))
        now = kept


def leaf_terms(nodes: list[dict]) -> dict[int, Term]:
    """The path to each leaf of a tree of nodes (node, question, yes, no), from node 0."""
    by, out, open_ = {x["node"]: x for x in nodes}, {}, [(0, Term())]
    while open_:
        node, path = open_.pop()
        if node not in by:
            out[node] = path
            continue
        x = by[node]
        open_ += [(x["yes"], path | {(x["question"], False)}), (x["no"], path | {(x["question"], True)})]
    return out


def parsed(text: str) -> list[Term]:
    """A compound question as text: names, ! before a name, blanks between the parts of a term, terms in brackets, | between them.

    (A !B) | (C) means A and not B, or C. One term may stand without brackets. Anything else is an error.
    """
    name = r"!?[A-Za-z_][A-Za-z0-9_.-]*"
    term = rf"\s*{name}(?:\s+{name})*\s*"
    if not re.fullmatch(rf"{term}|\s*\({term}\)\s*(?:\|\s*\({term}\)\s*)*", text):
        raise ValueError(f"no compound question: {text}")
    each = re.findall(rf"\(({term})\)", text) or [text]
    return [Term((x.lstrip("!"), x.startswith("!")) for x in t.split()) for t in each]


def written(terms: list[Term]) -> str:
    """The text of a compound question, as parsed reads it."""
    return " | ".join("(" + " ".join(("!" if s else "") + q for q, s in sorted(t)) + ")" for t in terms)


def answered(terms: list[Term], questions: dict[str, tuple[str, list[str]]]) -> Column:
    """The question over rows; questions: the column and members of each name. No term: never; an empty term: always."""
    answer = F.lit(False)
    for term in terms:
        holds = F.lit(True)
        for name, negated in sorted(term):
            column, members = questions[name]
            own = F.coalesce(F.col(column).isin(*members), F.lit(False))
            holds = holds & (~own if negated else own)
        answer = answer | holds
    return answer


# --- pruning -----------------------------------------------------------------------------------------


def pruned(nodes: DataFrame, tree: str, leaves: int) -> DataFrame:
    """nodes with removed: splits taken back, the lowest gain first, until leaves are left over all trees.

    nodes: tree, node (a heap's number: 2 n + 1 and 2 n + 2 below n), gain, one row a split. Only a split both of whose sides are
    leaves can go, so a split goes right after the last one below it if its own gain is lower: the order is by
    the highest gain in the part of the tree below (itself included); equal ones by tree, deeper ones first, then by
    node. As many go as needed; trees stay. All is grouping and one sort of the splits.
    """
    # Each split lends its gain to all above it: as many rows as splits times their depth.
    above = F.sequence(F.lit(0), F.floor(F.log2(F.col("node") + 1)).cast("int"))
    ancestor = F.transform(above, lambda k: F.floor((F.col("node") + 1) / F.pow(F.lit(2), k)).cast("long") - 1)
    lent = nodes.select(tree, F.explode(ancestor).alias("node"), F.col("gain").alias("below"))
    highest = lent.groupBy(tree, "node").agg(F.max("below").alias("key"))
    known = nodes.join(highest, [tree, "node"])
    depth = F.floor(F.log2(F.col("node") + 1))
    splits = nodes.agg(F.count(F.lit(1)).alias("splits"), F.countDistinct(tree).alias("trees"))
    # One row a split of a model's trees, not of data.
    place = F.row_number().over(Window.orderBy("key", tree, F.desc(depth), "node"))
    excess = F.col("splits") + F.col("trees") - leaves
    return known.withColumn("place", place).crossJoin(F.broadcast(splits)).select(*nodes.columns, (F.col("place") <= excess).alias("removed"))


def leaf_of(node: Column, splits: Column) -> Column:
    """The leaf in which a finest leaf (a heap's number) lies, given the numbers of the splits kept in its tree: the highest node on its path that is no split."""
    depth = F.floor(F.log2(node + 1)).cast("int")
    path = F.transform(F.sequence(F.lit(0), depth), lambda k: F.floor((node + 1) / F.pow(F.lit(2), depth - k)).cast("long") - 1)
    return F.get(F.filter(path, lambda x: ~F.array_contains(splits, x)), F.lit(0))
