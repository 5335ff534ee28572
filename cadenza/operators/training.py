"""Training and alignment from transcripts: a graph of tied states per utterance, sparse forward-backward, Viterbi.

utterances: key, words (per word its pronunciations, each an array of phones) and frames. A graph strings the
phones' states together: the pronunciations of a word are alternatives, silence stands before the first word,
and may stand between words and after the last one. Utterances are rows, so Spark spreads them over tasks; those of a batch
that share their words and length are worked on at once. Each task adds the statistics of its utterances up before it
emits them, one row for each density that occurred.

A model is a dict of small arrays, shipped with the tasks: states (phone to the numbers of its tied states), tmat
(phone to the number of its transitions), move (tmat, state, next state; the last one leaves the phone), weight (tied
state, density), mean and var (tied state, density, dimension).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, spread

SILENCE = "SIL"
#: States are dropped below this share of a frame's best; a failed utterance is tried again with the wider one.
BEAM, WIDE = 1e-80, 1e-160
FLOOR = 1e-300
#: Graphs that a task remembers, and numbers of the arrays that it works on at once.
GRAPHS, CELLS = 4096, 4_000_000

STATISTICS = "kind string, a int, b int, c int, n double, sums array<double>, squares array<double>"


def utterances(transcripts: DataFrame, lexicon: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """key, words, frames of each transcript; words null where the lexicon lacks one of them, frames null without any.

    transcripts: key, words (array of words); lexicon: word, variant, phones; frames: key, frame, vec. Equal
    pronunciations of a word count once. A repeated word is looked up by each of its places.
    """
    said = transcripts.select(key, F.posexplode("words").alias("pos", "word"))
    known = lexicon.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("variant", "phones"))).alias("v"))
    known = known.select("word", F.array_distinct(F.transform("v", lambda x: x["phones"])).alias("variants"))
    slots = said.join(known, "word", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "variants"))).alias("s"))
    words = F.when(F.forall("s", lambda x: x["variants"].isNotNull()), F.transform("s", lambda x: x["variants"]))
    heard = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame", "vec"))).alias("f"))
    heard = heard.select(key, F.transform("f", lambda x: x["vec"]).alias("frames"))
    return transcripts.select(key).join(slots.select(key, words.alias("words")), key, "left").join(heard, key, "left")


class Graph:
    """Emitting states of an utterance (senone, tmat, state, slot) and the arcs between them; a slot is one phone in its place."""

    def __init__(self, words: list, model: dict, between: bool = False):
        phones, nexts, self.word = [SILENCE], [[]], [-1]
        open_ = [0]  # slots that lead to the next word
        for at, variants in enumerate(words):
            ends = []
            for variant in variants:
                before = list(open_)
                for phone in variant:
                    slot = len(phones)
                    phones.append(phone)
                    nexts.append([])
                    self.word.append(at)
                    for b in before:
                        nexts[b].append(slot)
                    before = [slot]
                ends += before
            open_ = list(dict.fromkeys(ends))
            if between or at == len(words) - 1:
                slot = len(phones)
                phones.append(SILENCE)
                nexts.append([])
                self.word.append(-1)
                for b in open_:
                    nexts[b].append(slot)
                open_ = [*open_, slot]
        self.phones = phones
        first = np.cumsum([0] + [len(model["states"][p]) for p in phones])
        self.senone = np.array([s for p in phones for s in model["states"][p]])
        self.slot = np.repeat(np.arange(len(phones)), np.diff(first))
        self.tmat = np.array([model["tmat"][p] for p in phones])[self.slot]
        self.state = np.arange(len(self.senone)) - first[self.slot]
        arcs, self.final = [], np.zeros(len(self.senone))
        for slot, phone in enumerate(phones):
            move, n = model["move"][model["tmat"][phone]], len(model["states"][phone])
            ways = len(nexts[slot]) + (slot in open_)  # each way on is as likely, the end among them
            for i in range(n):
                arcs += [(first[slot] + i, first[slot] + j, move[i, j], j) for j in range(n) if move[i, j] > 0]
                leave = move[i, -1]
                if leave > 0:
                    arcs += [(first[slot] + i, first[to], leave / ways, -1) for to in nexts[slot]]
                    self.final[first[slot] + i] = leave / ways if slot in open_ else 0.0
        arcs.sort()
        self.source, self.target = (np.array([a[n] for a in arcs], dtype=np.int64) for n in (0, 1))
        self.chance = np.array([a[2] for a in arcs])
        #: The next state in the transitions; -1, the last one, leaves the phone.
        self.step = np.array([a[3] for a in arcs], dtype=np.int64)
        self.begin = np.searchsorted(self.source, np.arange(len(self.senone) + 1))


def densities(x: np.ndarray, model: dict, senones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log scores (frames, senones) and shares of the densities in them (frames, senones, densities)."""
    mean, var = model["mean"][senones], model["var"][senones]
    inverse = 1 / var
    norm = np.log(np.maximum(model["weight"][senones], FLOOR)) - 0.5 * np.log(2 * np.pi * var).sum(axis=2)
    # Squares are taken about the mean itself: a difference of large products would lose digits.
    each = np.stack([norm[s] - 0.5 * ((x[:, None, :] - mean[s]) ** 2 * inverse[s]).sum(axis=2) for s in range(len(senones))], axis=1)
    top = each.max(axis=2)
    share = np.exp(each - top[:, :, None])
    whole = share.sum(axis=2)
    return top + np.log(whole), share / whole[:, :, None]


def _gathered(order: np.ndarray, firsts: np.ndarray, at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the arcs' values (rows, arcs) by state; order sorts the arcs by that state, firsts are its first places, at the states."""
    out = np.zeros((len(rows), size))
    out[:, at] = np.add.reduceat(rows[:, order], firsts, axis=1)
    return out


def forward_backward(graph: Graph, score: np.ndarray, beam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of utterances of one graph and length: which have a path, their log-likelihoods, occupancies (utterances, frames, states), expected uses of the arcs and of the final states.

    score: log scores (utterances, frames, states). States that fall below the beam send nothing on.
    """
    many, n, size = score.shape
    best = score.max(axis=2)
    b = np.exp(score - best[:, :, None])
    order = np.argsort(graph.target, kind="stable")
    targets, into = np.unique(graph.target[order], return_index=True)
    sources, out = np.unique(graph.source, return_index=True)  # arcs lie by source
    kept = np.arange(len(graph.source))
    alpha, scale, alive = np.zeros((many, n, size)), np.ones((many, n)), np.ones(many, dtype=bool)
    alpha[:, 0, 0] = b[:, 0, 0]
    for t in range(n):
        if t:
            came = alpha[:, t - 1][:, graph.source] * graph.chance
            alpha[:, t] = _gathered(order, into, targets, came, size) * b[:, t]
        now = alpha[:, t]
        now[now < beam * now.max(axis=1, keepdims=True)] = 0.0
        whole = now.sum(axis=1)
        alive &= whole > 0
        scale[:, t] = np.where(whole > 0, whole, 1.0)
        now /= scale[:, t, None]
    end = alpha[:, -1] @ graph.final
    alive &= end > 0
    beta, uses = graph.final / np.where(end > 0, end, 1.0)[:, None], np.zeros((many, len(graph.source)))
    last = alpha[:, -1] * beta
    gamma = np.zeros((many, n, size))
    gamma[:, -1] = last
    for t in range(n - 1, 0, -1):
        ahead = np.where(alpha[:, t] > 0, b[:, t] * beta, 0.0) / scale[:, t, None]
        flow = graph.chance * ahead[:, graph.target]
        uses += alpha[:, t - 1][:, graph.source] * flow
        beta = _gathered(kept, out, sources, flow, size)
        gamma[:, t - 1] = alpha[:, t - 1] * beta
    ll = np.log(scale).sum(axis=1) + best.sum(axis=1) + np.log(np.where(end > 0, end, 1.0))
    return alive, ll, gamma, uses, last


def best_path(graph: Graph, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of utterances of one graph and length (score: utterances, frames, states): which have a path, its log scores and states.

    Ties go to the arc of the lower source.
    """
    many, n, size = score.shape
    with np.errstate(divide="ignore"):
        chance, final = np.log(graph.chance), np.log(graph.final)
    now, back = np.full((many, size), -np.inf), np.zeros((many, n, size), dtype=np.int32)
    now[:, 0] = score[:, 0, 0]
    order = np.lexsort((graph.source, graph.target))
    sources = graph.source[order]
    targets, firsts = np.unique(graph.target[order], return_index=True)
    arcs, sizes = np.arange(len(order)), np.diff(np.append(firsts, len(order)))
    for t in range(1, n):
        way = (now[:, graph.source] + chance)[:, order]
        top = np.maximum.reduceat(way, firsts, axis=1)
        # The first arc that reaches the top of its target.
        hit = np.minimum.reduceat(np.where(way == np.repeat(top, sizes, axis=1), arcs, len(arcs) - 1), firsts, axis=1)
        back[:, t, targets] = sources[hit]
        now = np.full((many, size), -np.inf)
        now[:, targets] = top + score[:, t, targets]
    total = now + final
    state, each = total.argmax(axis=1), np.arange(many)
    found = total[each, state]
    path = np.zeros((many, n), dtype=np.int64)
    path[:, -1] = state
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[each, t, path[:, t]]
    return np.isfinite(found), found, path


def _flat(said: DataFrame, *more: str) -> DataFrame:
    """words as text, n (frames) and x, all numbers of the frames in one array: cheap to hand to Python."""
    return said.select(*more, F.to_json("words").alias("words"), F.coalesce(F.size("frames"), F.lit(0)).alias("n"), F.flatten("frames").cast("array<double>").alias("x"))


def _prepared(batch: pd.DataFrame, model: dict, between: bool, graphs: dict):
    """(rows, graph, frames, distinct senones, place of a state's senone, scores, shares) of utterances of one graph and length at a time.

    Rows that no graph fits, as a part of them is missing, come with None. graphs remembers the graphs of words.
    """
    dim = model["mean"].shape[2]
    for (words, n), some in batch.groupby(["words", "n"], dropna=False, sort=False).indices.items() if len(batch) else ():
        said = json.loads(words) if isinstance(words, str) else None
        if not said or not n > 0 or any(p not in model["states"] for variants in said for v in variants for p in v):
            yield some, *[None] * 6
            continue
        if words not in graphs:
            if len(graphs) >= GRAPHS:
                graphs.clear()
            graphs[words] = Graph(said, model, between)
        graph = graphs[words]
        senones, own = np.unique(graph.senone, return_inverse=True)
        step = max(1, CELLS // (int(n) * (len(graph.source) + len(senones) * model["mean"].shape[1] * dim)))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            x = np.concatenate([batch["x"].iloc[i] for i in part]).reshape(len(part) * int(n), dim)
            score, share = densities(x, model, senones)
            yield part, graph, x, senones, own, score[:, own].reshape(len(part), int(n), -1), share


def expectation(said: DataFrame, model: dict, beam: float = BEAM, wide: float = WIDE, between: bool = False) -> DataFrame:
    """Summed statistics of all utterances: kind, a, b, c, n, sums, squares.

    kind density: a tied state, b density, n occupancy and, by dimension, weighted sums and squares; kind move:
    a tmat, b state, c next state; kind total: n by a (0 log-likelihood, 1 frames, 2 utterances, 3 tried again, 4 skipped).
    An utterance that no path explains, even in the wider beam, or that lacks words or frames, only counts as skipped.
    """
    dim = model["mean"].shape[2]
    leave = model["move"].shape[2] - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(model["weight"].shape)
        sums, squares = np.zeros(model["mean"].shape), np.zeros(model["mean"].shape)
        moves, totals = np.zeros(model["move"].shape), np.zeros(5)
        graphs: dict = {}
        for batch in batches:
            for some, graph, x, senones, own, score, share in _prepared(batch, model, between, graphs):
                if graph is None:
                    totals[4] += len(some)
                    continue
                share = share.reshape(*score.shape[:2], *share.shape[1:])
                x = x.reshape(*score.shape[:2], dim)
                left = np.arange(len(some))
                for again, width in enumerate((beam, wide)):
                    alive, ll, gamma, uses, last = forward_backward(graph, score[left], width)
                    totals[3] += again * len(left)
                    who = left[alive]
                    totals[:3] += ll[alive].sum(), x.shape[1] * len(who), len(who)
                    tied = np.zeros((len(who), x.shape[1], len(senones)))
                    for state, place in enumerate(own):
                        tied[:, :, place] += gamma[alive][:, :, state]
                    part = tied[:, :, :, None] * share[who]
                    n[senones] += part.sum(axis=(0, 1))
                    sums[senones] += np.einsum("utsm,utd->smd", part, x[who])
                    squares[senones] += np.einsum("utsm,utd->smd", part, x[who] ** 2)
                    np.add.at(moves, (graph.tmat[graph.source], graph.state[graph.source], graph.step), uses[alive].sum(axis=0))
                    np.add.at(moves, (graph.tmat, graph.state, leave), last[alive].sum(axis=0))
                    left = left[~alive]
                    if not len(left):
                        break
                totals[4] += len(left)
        rows = [("density", s, m, 0, n[s, m], sums[s, m], squares[s, m]) for s, m in zip(*np.nonzero(n), strict=True)]
        rows += [("move", *at, moves[at], None, None) for at in zip(*map(np.ndarray.tolist, np.nonzero(moves)), strict=True)]
        rows += [("total", a, 0, 0, v, None, None) for a, v in enumerate(totals) if v]
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "c", "n", "sums", "squares"])

    each = spread(_flat(said)).mapInPandas(run, STATISTICS)
    added = lambda c: F.when(F.col("kind") == "density", F.array(*[F.sum(F.get(c, F.lit(d))) for d in range(dim)])).alias(c)
    return each.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"), added("sums"), added("squares"))


def maximisation(statistics: DataFrame, model: dict, floor: float = 1e-4, retain: bool = True) -> tuple[dict, dict]:
    """The model from summed statistics, and the pass's totals. Densities without occupancy keep their parameters, or get weight 0."""
    weight, moves = np.zeros(model["weight"].shape), np.zeros(model["move"].shape)
    mean, var, totals = model["mean"].copy(), model["var"].copy(), np.zeros(5)
    for r in statistics.collect():  # of the model's size
        if r["kind"] == "density":
            s, m, n = r["a"], r["b"], r["n"]
            weight[s, m] = n
            if n > 1e-10:
                mean[s, m] = np.array(r["sums"]) / n
                var[s, m] = np.maximum(floor, np.array(r["squares"]) / n - mean[s, m] ** 2)
        elif r["kind"] == "move":
            moves[r["a"], r["b"], r["c"]] = r["n"]
        else:
            totals[r["a"]] = r["n"]
    share = lambda x, old: np.where((whole := x.sum(axis=-1, keepdims=True)) > 0, x / np.where(whole > 0, whole, 1), old if retain else 0.0)
    new = model | {"weight": share(weight, model["weight"]), "move": share(moves, model["move"]), "mean": mean, "var": var}
    return new, dict(zip(("total_ll", "frames", "utterances", "retried", "skipped"), totals.tolist(), strict=True))


def train(said: DataFrame, model: dict, passes: int, least: int = 1, threshold: float = 0.0, **how) -> tuple[dict, list[dict]]:
    """Passes until the signed gain of the log-likelihood per frame is at most threshold, from the least-th on; the model and telemetry."""
    telemetry, before, said = [], None, cut(said.select("words", "frames"))
    for n in range(1, passes + 1):
        model, totals = maximisation(expectation(said, model, **how), model)
        now = totals["total_ll"] / totals["frames"] if totals["frames"] else 0.0
        telemetry.append({"pass": n, **totals})
        if n >= least and before is not None and now - before <= threshold:
            break
        before = now
    return model, telemetry


def align(said: DataFrame, key: str, model: dict, between: bool = False) -> DataFrame:
    """key, seq, word, phone, start_frame, end_frame (inclusive), score of the best path's phones; word is null for silence.

    Utterances that no path explains, or that lack words or frames, yield one row of nulls (seq, phone and so on).
    """
    columns = [key, "seq", "word", "phone", "start_frame", "end_frame", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graphs: dict = {}
        for batch in batches:
            names = batch[key]
            for some, graph, _, _, _, score, _ in _prepared(batch, model, between, graphs):
                found = np.zeros(len(some), dtype=bool)
                if graph is not None:
                    found, total, path = best_path(graph, score)
                    slot = graph.slot[path[found]]
                    # A slot is entered once; a word said twice has slots of its own.
                    new = np.ones(slot.shape, dtype=bool)
                    new[:, 1:] = slot[:, 1:] != slot[:, :-1]
                    who, start = np.nonzero(new)
                    if len(who):
                        end = np.append(np.where(who[1:] == who[:-1], start[1:] - 1, slot.shape[1] - 1), slot.shape[1] - 1)
                        here = slot[who, start]
                        words = np.array([w if w >= 0 else None for w in graph.word], dtype=object)
                        as_is = lambda values: pd.Series(values, dtype=object)
                        yield pd.DataFrame({
                            key: as_is(names.iloc[some[found][who]].to_numpy()), "seq": new.cumsum(axis=1)[who, start] - 1, "word": as_is(words[here]),
                            "phone": as_is(np.array(graph.phones, dtype=object)[here]), "start_frame": start, "end_frame": end, "score": total[found][who],
                        })
                if not found.all():
                    lost = names.iloc[some[~found]].to_numpy()
                    yield pd.DataFrame({c: pd.Series(lost if c == key else [None] * len(lost), dtype=object) for c in columns})

    kind = said.schema[key].dataType.simpleString()
    return spread(_flat(said, key)).mapInPandas(run, f"{key} {kind}, seq int, word int, phone string, start_frame int, end_frame int, score double")
