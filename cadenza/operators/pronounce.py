"""Grapheme to phoneme: alignment of letters and phones by EM, a joint n-gram model of aligned units, decoding with a beam.

A unit pairs a chunk of letters with a chunk of phones. Words are rows, so expectation, alignment and decoding are spread over
tasks; each task works on many words at once and adds their counts up before they are shuffled. A word that is too long for that is
worked on by itself, a row of its lattice at a time. Models are as large as the units that occur, and are shipped with the tasks up to
MODEL units.
"""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, spread

#: Letters and phones of a unit at most; a unit of one letter may have no phone.
LETTERS, PHONES = 2, 2
#: Units of a model that is shipped with tasks.
MODEL = 1_000_000
#: Histories and letters whose units a decoder keeps the chances of.
KEPT = 100_000
#: Totals below this, or above its inverse, are taken in logarithms: products of two of them still are exact.
SMALL = 1e-150
#: Places of units in words that are worked on at once; a word of more is worked on by rows.
ARCS = 1 << 21
#: What may stand for a unit without phones, and between the parts of a chunk, in texts.
NOTHING, JOIN = "_", "+"


def _units(letters: list, phones: list, i: int, j: int, most: tuple[int, int]):
    """(letters, phones, i, j after) of the units that may start at i and j: single ones and one-to-many, many-to-one."""
    for a, b in _sizes(most):
        if i + a <= len(letters) and j + b <= len(phones):
            yield JOIN.join(letters[i : i + a]), JOIN.join(phones[j : j + b]) if b else NOTHING, i + a, j + b


def _sizes(most: tuple[int, int]) -> list[tuple[int, int]]:
    """Letters and phones of the kinds of units, in their order."""
    return [(a, b) for a in range(1, most[0] + 1) for b in range(0 if a == 1 else 1, most[1] + 1) if a == 1 or b == 1]


class _Column:
    """Sequences of texts as numbers: the texts that occur, and the chunks of up to most of them."""

    def __init__(self, column: pa.Array, most: int):
        flat = column.flatten().dictionary_encode()
        if flat.null_count:
            raise ValueError("a letter or phone is null")
        self.sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        chunk, self.names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
        single, names, self.at = chunk, self.names, {1: chunk}
        # A chunk is numbered after all shorter ones; those that reach into the next sequence are made, too, and not used.
        for n in range(2, most + 1):
            pairs, found = pd.factorize(self.at[n - 1][:-1] * len(names) + single[n - 1 :])
            parts = [divmod(int(x), len(names)) for x in found]
            self.at[n] = pairs + len(self.names)
            self.names = self.names + [JOIN.join((self.names[x], names[y])) for x, y in parts]


def _alike(letters: _Column, phones: _Column, kinds: int, long: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of rows with as many letters and as many phones, few enough for about ARCS places at once; without long ones."""
    order = np.lexsort((phones.sizes, letters.sizes))
    order = order[~long[order]]
    n, m = letters.sizes[order], phones.sizes[order]
    edges = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (m[1:] != m[:-1]), True]) if len(order) else []
    for a, b in itertools.pairwise(edges):
        step = max(1, ARCS // int((n[a] + 1) * (m[a] + 1) * kinds))
        yield from (order[x : min(b, x + step)] for x in range(a, b, step))


class Lattices:
    """The units of many words at once: words of the same sizes are the last axis of every array."""

    def __init__(self, letters: pa.Array, phones: pa.Array, most: tuple[int, int]):
        self.letters, self.phones, self.kinds = _Column(letters, most[0]), _Column(phones, most[1]), _sizes(most)
        self.wide = len(self.phones.names) + 1
        self.long = (self.letters.sizes + 1) * (self.phones.sizes + 1) * len(self.kinds) > ARCS

    def unit(self, code: int) -> tuple[str, str]:
        x, y = divmod(int(code), self.wide)
        return self.letters.names[x], self.phones.names[y - 1] if y else NOTHING

    def groups(self) -> Iterator[tuple]:
        """rows, n, m, and for each kind of unit the codes at i, j (places in front of it) and word; None where it is too long."""
        for rows in _alike(self.letters, self.phones, len(self.kinds), self.long):
            n, m = int(self.letters.sizes[rows[0]]), int(self.phones.sizes[rows[0]])
            made = []
            for a, b in self.kinds:
                if n < a or m < b:
                    made.append(None)
                    continue
                x = self.letters.at[a][self.letters.begins[rows] + np.arange(n - a + 1)[:, None]]
                at = self.phones.begins[rows] + np.arange(m - b + 1)[:, None]
                y = self.phones.at[b][at] + 1 if b else np.zeros_like(at)
                made.append(x[:, None] * self.wide + y[None])
            yield rows, n, m, made


class _Rows:
    """The lattice of one word by rows (a row: a place in its letters), in logarithms, so it may be of any length.

    Of the rows only about two times the root of their number are held: the first ones of every block, and those of one block, which are
    made again on the way back.
    """

    def __init__(self, lattices: Lattices, row: int, chance: Callable[[str, str], float]):
        self.lattices, self.chance, self.kept, self.size = lattices, chance, {}, 0
        x, y = lattices.letters, lattices.phones
        self.n, self.m, self.at, self.back = int(x.sizes[row]), int(y.sizes[row]), int(x.begins[row]), max(a for a, _ in lattices.kinds)
        # The different chunks of phones by their size, and the place of each among them.
        self.phones = {0: (np.zeros(self.m + 1, dtype=np.int64), np.zeros(1, dtype=np.int64))}
        for b in {b for _, b in lattices.kinds if 0 < b <= self.m}:
            self.phones[b] = pd.factorize(y.at[b][y.begins[row] : y.begins[row] + self.m - b + 1] + 1)

    def chunk(self, i: int, a: int) -> int:
        return int(self.lattices.letters.at[a][self.at + i])

    def kinds(self, i: int) -> list[tuple[int, int, int]]:
        """Numbers and sizes of the kinds of units that may start at letter i."""
        return [(t, a, b) for t, (a, b) in enumerate(self.lattices.kinds) if i + a <= self.n and b <= self.m]

    def logs(self, i: int, a: int, b: int) -> np.ndarray:
        """The logarithms of the chances of the units of a letters from i and b phones, by the place of the phones."""
        x = self.chunk(i, a)
        if (found := self.kept.get((x, b))) is None:
            units = [self.lattices.unit(x * self.lattices.wide + y) for y in self.phones[b][1]]
            found = np.array([math.log(p) if (p := self.chance(*u)) > 0 else -math.inf for u in units])
            if self.size + len(found) > ARCS:
                self.kept, self.size = {}, 0
            self.kept[x, b], self.size = found, self.size + len(found)
        return found[self.phones[b][0]]

    def after(self, k: int, before: list, best: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Row k from those before it (the last one is row k - 1): of all paths, or of the best one with the kinds of its last units."""
        score = np.full(self.m + 1, -math.inf)
        kind = np.full(self.m + 1, -1, dtype=np.int16) if best else None
        # What starts earlier comes first, as in best_alignments.
        for t, (a, b) in sorted(enumerate(self.lattices.kinds), key=lambda x: (-x[1][0], -x[1][1])):
            if a > k or b > self.m:
                continue
            now = before[-a][: self.m + 1 - b] + self.logs(k - a, a, b)
            if best:
                better = now > score[b:]
                score[b:][better] = now[better]
                kind[b:][better] = t
            else:
                score[b:] = np.logaddexp(score[b:], now)
        return score, kind

    def blocks(self, best: bool = False) -> Iterator[tuple[int, list, list]]:
        """The first row's number, rows and their kinds of one block after the other, from the last one on."""
        step = max(math.isqrt(self.n), self.back) + 1
        first = np.full(self.m + 1, -math.inf)
        first[0] = 0.0
        heads, before = [], deque([first], self.back)
        for k in range(1, self.n + 1):
            if k % step == 1:
                heads.append((k, list(before)))
            before.append(self.after(k, before, best)[0])
        for start, held in reversed(heads):
            before, rows, kinds = deque(held, self.back), [], []
            for k in range(start, min(start + step, self.n + 1)):
                score, kind = self.after(k, before, best)
                before.append(score)
                rows.append(score)
                kinds.append(kind)
            yield start, rows, kinds
        yield 0, [first], [None]

    def counts(self) -> tuple[float, dict]:
        """The logarithm of the likelihood, and the expected number of each unit."""
        total, sums, size, counts = None, {}, 0, {}
        last = np.full(self.m + 1, -math.inf)
        last[self.m] = 0.0
        betas = deque([], self.back)  # of the rows i + 1, i + 2, ...

        def add_up() -> None:
            for (x, b), c in sums.items():
                for y in np.flatnonzero(c > 0):
                    u = self.lattices.unit(x * self.lattices.wide + int(self.phones[b][1][y]))
                    counts[u] = counts.get(u, 0.0) + float(c[y])
            sums.clear()

        for start, rows, _ in self.blocks():
            for i in range(start + len(rows) - 1, start - 1, -1):
                alpha = rows[i - start]
                if i == self.n:
                    total, beta = alpha[self.m], last
                    if total == -math.inf:
                        return total, {}
                else:
                    beta = np.full(self.m + 1, -math.inf)
                for _, a, b in self.kinds(i):
                    through = self.logs(i, a, b) + betas[a - 1][b:]
                    beta[: self.m + 1 - b] = np.logaddexp(beta[: self.m + 1 - b], through)
                    at, different = self.phones[b]
                    key = self.chunk(i, a), b
                    if key not in sums:
                        sums[key], size = np.zeros(len(different)), size + len(different)
                    sums[key] += np.bincount(at, np.exp(alpha[: self.m + 1 - b] + through - total), len(different))
                betas.appendleft(beta)
                if size > ARCS:
                    add_up()
                    size = 0
        add_up()
        return float(total), counts

    def path(self) -> list | None:
        """The units of the best path."""
        j, k, found = self.m, self.n, []
        for start, rows, kinds in self.blocks(best=True):
            if start + len(rows) > self.n and (rows[-1][self.m] == -math.inf or not self.n):
                return None
            while k and k >= start:
                a, b = self.lattices.kinds[kinds[k - start][j]]
                k, j = k - a, j - b
                x, y = self.lattices.unit(self.chunk(k, a) * self.lattices.wide + int(self.phones[b][1][self.phones[b][0][j]]))
                found.append({"letters": x, "phones": y})
        return found[::-1]


def _numbered(groups: list[tuple]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple]]:
    """The different codes of all groups, their numbers in a row, and the groups with numbers instead of codes."""
    flat = [c.ravel() for g in groups for c in g[3] if c is not None]
    numbers, codes = pd.factorize(np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64))

    def again() -> Iterator[tuple]:
        at = 0
        for rows, n, m, made in groups:
            out = []
            for c in made:
                out.append(None if c is None else numbers[at : at + c.size].reshape(c.shape))
                at += 0 if c is None else c.size
            yield rows, n, m, out

    return codes, numbers, again()


def _portions(groups: Iterator[tuple]) -> Iterator[list[tuple]]:
    """The groups in lists of about ARCS places."""
    held, size = [], 0
    for g in groups:
        held.append(g)
        size += sum(c.size for c in g[3] if c is not None)
        if size >= ARCS:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(letters: pa.Array, phones: pa.Array, chance, most: tuple[int, int] = (LETTERS, PHONES)) -> tuple[np.ndarray, dict]:
    """The logarithm of each word's likelihood (arrays of lists), and the expected number of each unit in all of them; chance: a unit's probability.

    A word without an alignment has -inf and adds nothing. Chances are multiplied; a word whose total is too large or too small for
    that is worked on by rows.
    """
    lattices = Lattices(letters, phones, most)
    likely, counts, by_rows = np.full(len(letters), -np.inf), {}, np.flatnonzero(lattices.long).tolist()
    for portion in _portions(lattices.groups()):
        codes, numbers, groups = _numbered(portion)
        units = [lattices.unit(c) for c in codes]
        p, shares = np.array([chance(*u) for u in units]), [np.zeros(0)]
        for rows, n, m, at in groups:
            alpha, beta = np.zeros((n + 1, m + 1, len(rows))), np.zeros((n + 1, m + 1, len(rows)))
            alpha[0, 0] = beta[n, m] = 1.0
            arcs = [(a, b, c, p[c]) for (a, b), c in zip(lattices.kinds, at, strict=True) if c is not None]
            with np.errstate(over="ignore", invalid="ignore"):  # of words that aren't good
                for i in range(n):  # every unit has a letter, so all places of a letter are taken at once
                    for a, b, _, q in arcs:
                        if i + a <= n:
                            alpha[i + a, b:] += alpha[i, : m + 1 - b] * q[i]
                for i in range(n - 1, -1, -1):
                    for a, b, _, q in arcs:
                        if i + a <= n:
                            beta[i, : m + 1 - b] += q[i] * beta[i + a, b:]
            total = alpha[n, m]
            good = (total > SMALL) & (total < 1 / SMALL)
            if not good.all():
                by_rows += rows[~good & _reached(n, m, [(a, b, q > 0) for a, b, _, q in arcs], len(rows))].tolist()
            likely[rows[good]] = np.log(total[good])
            for a, b, _, q in arcs:
                with np.errstate(over="ignore", invalid="ignore"):
                    through = alpha[: n + 1 - a, : m + 1 - b] * q * beta[a:, b:]
                shares.append(np.divide(through, total, out=np.zeros_like(through), where=good).ravel())
        for u, c in zip(units, np.bincount(numbers, np.concatenate(shares), len(units)).tolist(), strict=True):
            if c > 0:
                counts[u] = counts.get(u, 0.0) + c
    for row in by_rows:
        likely[row], more = _Rows(lattices, row, chance).counts()
        for u, c in more.items():
            counts[u] = counts.get(u, 0.0) + c
    return likely, counts


def _reached(n: int, m: int, arcs: list[tuple], words: int) -> np.ndarray:
    """Which of the words have an alignment at all, by whether their units have a chance."""
    there = np.zeros((n + 1, m + 1, words), dtype=bool)
    there[0, 0] = True
    for i in range(n):
        for a, b, may in arcs:
            if i + a <= n:
                there[i + a, b:] |= there[i, : m + 1 - b] & may[i]
    return there[n, m]


def expectation(entries: DataFrame, chance: dict | None, sizes: dict[tuple[int, int], float] | None = None, most: tuple[int, int] = (LETTERS, PHONES)) -> DataFrame:
    """letters, phones, n: expected units of all entries (letters, phones: arrays); one row of nulls counts (n) entries without an alignment.

    chance: units to probabilities; where it is None, a unit's is that of its sizes, by default 1.
    """
    def of(x: str, y: str) -> float:
        if chance is not None:
            return chance.get((x, y), 0.0)
        return 1.0 if sizes is None else sizes.get((x.count(JOIN) + 1, 0 if y == NOTHING else y.count(JOIN) + 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        lost = 0
        for batch in batches:
            likely, counts = word_counts(batch["letters"], batch["phones"], of, most)
            lost += int((likely == -np.inf).sum())
            for k, v in counts.items():
                sums[k] = sums.get(k, 0.0) + v
        rows = [(*k, v) for k, v in sums.items()] + ([(None, None, float(lost))] if lost else [])
        x, y, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(n, pa.float64())], ["letters", "phones", "n"])

    part = spread(entries.select("letters", "phones")).mapInArrow(run, "letters string, phones string, n double")
    return part.groupBy("letters", "phones").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame) -> dict:
    """Units to their share; more than MODEL of them are an error rather than too large a model."""
    rows = counts.filter(F.col("letters").isNotNull()).limit(MODEL + 1).collect()
    if len(rows) > MODEL:
        raise ValueError(f"more than {MODEL} units")
    total = sum(r["n"] for r in rows)
    return {(r["letters"], r["phones"]): r["n"] / total for r in rows}


def train(entries: DataFrame, passes: int = 10, most: tuple[int, int] = (LETTERS, PHONES)) -> dict:
    """The units' probabilities after passes of EM, from equal ones."""
    chance, entries = None, cut(entries.select("letters", "phones"))
    for _ in range(passes):
        chance = _model(expectation(entries, chance, None, most))
    return chance or {}


def best_alignments(letters: pa.Array, phones: pa.Array, chance: dict, most: tuple[int, int] = (LETTERS, PHONES)) -> list:
    """The units of the likeliest alignment of each word; None where there is none. Ties go to the first by place, then kind."""
    lattices, out = Lattices(letters, phones, most), [None] * len(letters)
    for portion in _portions(lattices.groups()):
        codes, _, groups = _numbered(portion)
        units = [lattices.unit(c) for c in codes]
        named = [{"letters": x, "phones": y} for x, y in units]
        log = np.array([math.log(p) if (p := chance.get(u, 0.0)) > 0 else -math.inf for u in units])
        for rows, n, m, at in groups:
            score = np.full((n + 1, m + 1, len(rows)), -math.inf)
            score[0, 0] = 0.0
            kind = np.full(score.shape, -1, dtype=np.int64)
            for k in range(1, n + 1):
                # What starts earlier comes first: longer units before shorter ones.
                for t in sorted(range(len(at)), key=lambda t: (-lattices.kinds[t][0], -lattices.kinds[t][1])):
                    (a, b), c = lattices.kinds[t], at[t]
                    if c is None or a > k:
                        continue
                    now = score[k - a, : m + 1 - b] + log[c[k - a]]
                    better = now > score[k, b:]
                    score[k, b:][better] = now[better]
                    kind[k, b:][better] = t
            for w in np.flatnonzero((score[n, m] > -math.inf) & (n > 0)):
                i, j, path = n, m, []
                while i or j:
                    t = kind[i, j, w]
                    i, j = i - lattices.kinds[t][0], j - lattices.kinds[t][1]
                    path.append(named[at[t][i, j, w]])
                out[rows[w]] = path[::-1]
    for row in np.flatnonzero(lattices.long).tolist():
        out[row] = _Rows(lattices, row, lambda *u: chance.get(u, 0.0)).path()
    return out


def aligned(entries: DataFrame, key: str, chance: dict, most: tuple[int, int] = (LETTERS, PHONES)) -> DataFrame:
    """key, units (array of letters, phones): the likeliest alignment of each entry; null where there is none."""
    unit = pa.list_(pa.struct([("letters", pa.string()), ("phones", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = best_alignments(batch["letters"], batch["phones"], chance, most)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(units, unit)], [key, "units"])

    kind = entries.schema[key].dataType.simpleString()
    return spread(entries.select(key, "letters", "phones")).mapInArrow(run, f"{key} {kind}, units array<struct<letters:string,phones:string>>")


def joint_counts(alignments: DataFrame, order: int) -> DataFrame:
    """gram (array of up to order units as letters}phones), n: counts of the units' n-grams, words between <s> and </s>."""
    units = F.transform("units", lambda u: F.concat(u["letters"], F.lit("}"), u["phones"]))
    line = F.concat(F.array(F.lit("<s>")), units, F.array(F.lit("</s>")))
    lines = alignments.filter(F.col("units").isNotNull()).select(line.alias("w"))
    place = lines.select("w", F.explode(F.sequence(F.lit(2), F.size("w"))).alias("end"))
    # An n-gram ends with its last unit; <s> only begins one.
    grams = F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.col("end"))), lambda n: F.slice("w", F.col("end") - n + 1, n))
    return place.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


class _Path:
    """Units one after the other, of which paths with the same begin hold it once; compared as the tuples they stand for."""

    __slots__ = ("before", "unit")

    def __init__(self, before: _Path | None, unit: str):
        self.before, self.unit = before, unit

    def units(self) -> list[str]:
        found, at = [], self
        while at is not None:
            found.append(at.unit)
            at = at.before
        return found[::-1]

    def __lt__(self, other: _Path) -> bool:
        return self.units() < other.units()


class JointModel:
    """P(unit | units before) interpolated with shorter histories, each by the number of units that follow it (Witten-Bell)."""

    def __init__(self, counts: list[tuple[tuple, int]], order: int):
        self.order, self.next = order, {}
        for gram, n in counts:
            self.next.setdefault(gram[:-1], {})[gram[-1]] = n
        self.total = {h: sum(c.values()) for h, c in self.next.items()}
        self.vocabulary = len(self.next.get((), {})) + 1
        self.kept: dict[tuple, list] = {}
        self.units: dict[str, list[str]] = {}
        for u in self.next.get((), {}):
            if u != "</s>":
                self.units.setdefault(u.split("}")[0], []).append(u)

    def logs(self, history: tuple, letters: str) -> list[tuple[float, str]]:
        """The logarithm of the chance of each unit of these letters, with the unit; what was asked is kept, up to KEPT questions."""
        if (found := self.kept.get((history, letters))) is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            found = self.kept[history, letters] = [(math.log(self.chance(history, unit)), unit) for unit in self.units.get(letters, [])]
        return found

    def chance(self, history: tuple, unit: str) -> float:
        p = 1 / self.vocabulary
        for n in range(len(history) + 1):
            h = history[len(history) - n :]
            if h not in self.next:
                break
            kinds = len(self.next[h])
            p = (self.next[h].get(unit, 0) + kinds * p) / (self.total[h] + kinds)
        return p

    def decode(self, letters: list, beam: int, most: int = LETTERS) -> list[str] | None:
        """The phones of the best of the beam's paths; ties go to the first in the order of units. None if no units cover the letters."""
        heaps = [{} for _ in range(len(letters) + 1)]
        heaps[0][("<s>",)] = (0.0, None)
        for i in range(len(letters)):
            kept = sorted(heaps[i].items(), key=lambda x: (-x[1][0], x[1][1]))[:beam]
            heaps[i] = {}  # what isn't kept goes
            for history, (score, said) in kept:
                for a in range(1, min(most, len(letters) - i) + 1):
                    for log, unit in self.logs(history, JOIN.join(letters[i : i + a])):
                        now = (score + log, _Path(said, unit))
                        after = (*history, unit)[-(self.order - 1) :] if self.order > 1 else ()
                        old = heaps[i + a].get(after)
                        if old is None or (-now[0], now[1]) < (-old[0], old[1]):
                            heaps[i + a][after] = now
        ends = [(score + math.log(self.chance(h, "</s>")), said) for h, (score, said) in heaps[-1].items()]
        if not ends or not letters:
            return None
        said = min(ends, key=lambda x: (-x[0], x[1]))[1]
        return [p for u in said.units() for p in u.split("}")[1].split(JOIN) if p != NOTHING]


def joint_model(counts: DataFrame, order: int) -> JointModel:
    rows = counts.limit(MODEL + 1).collect()  # as many as units and their n-grams
    if len(rows) > MODEL:
        raise ValueError(f"more than {MODEL} n-grams")
    return JointModel([(tuple(r["gram"]), r["n"]) for r in sorted(rows, key=lambda r: list(r["gram"]))], order)


def pronounced(words: DataFrame, key: str, model: JointModel, beam: int = 20) -> DataFrame:
    """key, phones of each word (letters: an array); null where the model has no units for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "phones": [model.decode(list(x), beam) for x in batch["letters"]]})

    kind = words.schema[key].dataType.simpleString()
    return spread(words.select(key, "letters")).mapInPandas(run, f"{key} {kind}, phones array<string>")
