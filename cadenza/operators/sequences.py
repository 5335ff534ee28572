"""Operators on ordered sequences: deltas, normalisation, contexts, segments, transitions.

Sequences are rows (key, frame, ...); every operator is a window over the key, so one shuffle by key
serves a chain of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FILLERS = ("SIL", "+NOISE+", "<s>", "</s>")
#: Characters of texts whose contexts are counted at once, one text at least; counters of contexts that are held as they are.
PORTION, COUNTERS = 1 << 20, 1 << 22


def number(rows: DataFrame, key: str, *order: str, name: str = "frame") -> DataFrame:
    """Frame numbers from 0 within a key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def _line(key: str, order: str = "frame") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def _whole(key: str) -> WindowSpec:
    return Window.partitionBy(key)


def shifted(x: str, by: int, key: str, order: str = "frame") -> Column:
    """x at another frame, the first or last frame repeated beyond the ends."""
    edge = F.min_by(x, order) if by < 0 else F.max_by(x, order)
    moved = F.lag(x, -by) if by < 0 else F.lead(x, by)
    return F.coalesce(moved.over(_line(key, order)), edge.over(_whole(key)))


def delta(x: str, key: str, reach: int = 2) -> Column:
    return shifted(x, reach, key) - shifted(x, -reach, key)


def delta_delta(x: str, key: str) -> Column:
    return (shifted(x, 3, key) - shifted(x, -1, key)) - (shifted(x, 1, key) - shifted(x, -3, key))


def stacked(x: str, key: str, reach: int) -> Column:
    """The frames from -reach to reach as one array, edges repeated."""
    return F.array(*[shifted(x, n, key) for n in range(-reach, reach + 1)])


def preemphasis(x: str, key: str, alpha: float = 0.97) -> Column:
    return F.col(x) - alpha * F.coalesce(F.lag(x).over(_line(key)), F.lit(0.0))


def batch_mean_normalised(x: str, key: str, c0: str) -> Column:
    """x minus its mean over frames with c0 >= 0; all frames are shifted. No such frame: null."""
    return F.col(x) - F.avg(F.when(F.col(c0) >= 0, F.col(x))).over(_whole(key))


def variance_normalised(x: str, key: str, c0: str) -> Column:
    """The normalised x over the root of the mean square, over all frames, around that mean."""
    mean = F.avg(F.when(F.col(c0) >= 0, F.col(x))).over(_whole(key))
    return (F.col(x) - mean) / F.sqrt(F.avg(F.col("x2")).over(_whole(key)) - 2 * mean * F.avg(F.col(x)).over(_whole(key)) + mean * mean)


def live_means_of(x: np.ndarray, c0: np.ndarray, mean: float, total: float, n: float, window: int, most: int) -> tuple[np.ndarray, tuple[float, float, float]]:
    """x less the running mean, and the state after it. Frames whose c0 is below 0 neither change nor count."""
    out, counts = x.astype(float).copy(), c0 >= 0
    at = 0
    while at < len(x):
        # The mean stands still until more than most frames have counted.
        due = np.flatnonzero(np.cumsum(counts[at:]) + n > most)
        end = at + (int(due[0]) + 1 if len(due) else len(x) - at)
        part = slice(at, end)
        out[part] -= np.where(counts[part], mean, 0.0)
        total += float(x[part][counts[part]].sum())
        n += int(counts[part].sum())
        if n > most:
            mean = total / n
            total, n = mean * window, float(window)
        at = end
    return out, (mean, total, n)


def live_mean_normalised(
    rows: DataFrame, key: str, x: str, start: float = 12.0, window: int = 500, most: int = 800, c0: str | None = None
) -> DataFrame:
    """key, frame, y: x less the running mean; past most frames the sums shrink to window frames.

    Frames whose c0 (x itself unless named) is below 0 stay as they are and don't count. The frames of a key,
    one utterance, are one Arrow group; keys go on side by side.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        y, _ = live_means_of(part["x"].to_numpy(float), part["c0"].to_numpy(float), start, start * window, float(window), window, most)
        return pd.DataFrame({key: part[key], "frame": part["frame"].astype("int32"), "y": y})

    kind = rows.schema[key].dataType.simpleString()
    named = rows.select(key, "frame", F.col(x).cast("double").alias("x"), F.col(c0 or x).cast("double").alias("c0"))
    return named.groupBy(key).applyInPandas(run, f"{key} {kind}, frame int, y double")


def agc_max(c0: str, key: str) -> Column:
    return F.col(c0) - F.max(c0).over(_whole(key))


def agc_noise(rows: DataFrame, key: str, c0: str, threshold: float = 2.0) -> DataFrame:
    """c0 minus the mean of the frames below the minimum plus threshold; unchanged where there are none."""
    low = rows.withColumn("floor", F.min(c0).over(_whole(key)) + threshold)
    noise = F.avg(F.when(F.col(c0) < F.col("floor"), F.col(c0))).over(_whole(key))
    return low.withColumn("agc", F.col(c0) - F.coalesce(noise, F.lit(0.0))).drop("floor")


def contexts(rows: DataFrame, key: str, phone: str, fillers: Sequence[str] = FILLERS) -> DataFrame:
    """left and right neighbour of each phone; fillers and the ends are SIL, filler bases are left out."""
    near = lambda f: F.coalesce(F.when(f.over(_line(key)).isin(*fillers), "SIL").otherwise(f.over(_line(key))), F.lit("SIL"))
    named = rows.withColumn("left", near(F.lag(phone))).withColumn("right", near(F.lead(phone)))
    return named.filter(~F.col(phone).isin(*fillers))


def contexts_of(words: Column, fillers: Sequence[str] = FILLERS) -> Column:
    """left, phone, right, wpos of all phones of words (an array of arrays of phones), in an array: contexts and word_position within one row, nothing is shuffled."""
    place = lambda i, n: F.when(n == 1, "s").when(i == 0, "b").when(i == n - 1, "e").otherwise("i")
    phones = F.flatten(F.transform(words, lambda w: F.transform(w, lambda p, i: F.struct(p.alias("phone"), place(i, F.size(w)).alias("wpos")))))
    near = lambda c, at: F.coalesce(F.when(F.get(c, at)["phone"].isin(*fillers), "SIL").otherwise(F.get(c, at)["phone"]), F.lit("SIL"))
    each = lambda c: F.transform(c, lambda p, i: F.struct(near(c, i - 1).alias("left"), p["phone"].alias("phone"), near(c, i + 1).alias("right"), p["wpos"].alias("wpos")))
    # The lambda over one element has the phones made once.
    return F.filter(F.flatten(F.transform(F.array(phones), each)), lambda x: ~x["phone"].isin(*fillers))


def _context_counts(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """left, phone, right (code points, 0 for SIL), place (of PLACES) and n of the contexts of the characters of texts that aren't white space."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero(~((chars == 32) | ((chars >= 9) & (chars <= 13))))
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[at]
    # A code point's number among those that occur, from 1.
    there = np.zeros(0x110000, dtype=bool)
    there[chars[at]] = True
    names = np.flatnonzero(there)
    numbers = np.zeros(0x110000, dtype=np.int64)
    numbers[names] = np.arange(1, len(names) + 1)
    phone, wide = numbers[chars[at]], len(names) + 1
    line = np.concatenate([[True], row[1:] != row[:-1], [True]])[: len(at) + 1]  # before each and after the last
    word = np.concatenate([[True], at[1:] != at[:-1] + 1, [True]])[: len(at) + 1] | line
    left, right = np.where(line[:-1], 0, np.roll(phone, 1)), np.where(line[1:], 0, np.roll(phone, -1))
    key = ((left * wide + phone) * wide + right) * 4 + 2 * word[:-1] + word[1:]
    if wide**3 * 4 <= COUNTERS:
        n = np.bincount(key, minlength=1)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    code = np.concatenate([[0], names])
    return code[key // (4 * wide * wide)], code[key // (4 * wide) % wide], code[key // 4 % wide], key % 4, n


#: Inside, end, begin, single: whether a word begins with the phone (2) and ends with it (1).
PLACES = ("i", "e", "b", "s")


def context_counts(rows: DataFrame, text: str) -> DataFrame:
    """left, phone, right, wpos, n: how often each context of contexts_of occurs among the characters of the words of all texts.

    Phones are characters, words lie between white space. Tasks count the characters of many texts at once, so only
    counts are shuffled; a text is held as a whole, others up to PORTION characters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = np.vectorize(lambda c: chr(c) if c else "SIL", otypes=[object])
        for batch in batches:
            column = batch.column(0).drop_null()
            ends = np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
            a = 0
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PORTION, side="right")))
                left, phone, right, place, n = _context_counts(column.slice(a, b - a))
                a = b
                if len(n):
                    texts = [pa.array(named(c), pa.string()) for c in (left, phone, right)]
                    yield pa.RecordBatch.from_arrays([*texts, pa.array(np.array(PLACES)[place], pa.string()), pa.array(n, pa.int64())], ["left", "phone", "right", "wpos", "n"])

    found = rows.select(text).mapInArrow(run, "left string, phone string, right string, wpos string, n long")
    return found.groupBy("left", "phone", "right", "wpos").agg(F.sum("n").alias("n"))


def word_position(rows: DataFrame, key: str, ends_word: str) -> DataFrame:
    """wpos of each phone from the mark on a word's last phone: b begin, i inside, e end, s single."""
    starts = F.coalesce(F.lag(ends_word).over(_line(key)), F.lit(True))
    place = F.when(starts & F.col(ends_word), "s").when(starts, "b").when(F.col(ends_word), "e").otherwise("i")
    return rows.withColumn("wpos", place)


def segments(rows: DataFrame, key: str, state: str) -> DataFrame:
    """key, seq, state, start_frame, end_frame (inclusive), frames: runs of equal state."""
    change = F.when(F.lag(state).over(_line(key)) == F.col(state), 0).otherwise(1)
    marked = rows.select(key, "frame", state, change.alias("change"))
    run = F.sum("change").over(_line(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("seq", run.cast("int") - 1).groupBy(key, "seq", state).agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("frames")
    )


def frames_of_segments(segs: DataFrame, key: str, state: str) -> DataFrame:
    """Each frame with its segment: the range is expanded, not joined."""
    return segs.select(key, "seq", state, F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))


def fill_gaps(intervals: DataFrame, key: str, begin: str, end: str, label: str, to: Column) -> DataFrame:
    """key, begin, end, label with empty intervals for what [0, to] is not covered by; intervals don't overlap.

    One pass over the intervals: each is returned with the gap in front of it, the last of a key with the gap behind it.
    """
    so_far = _line(key, begin).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = intervals.select(key, begin, end, label, to.alias("to"))
    placed = placed.select("*", F.max(end).over(so_far).alias("done"), F.max("to").over(so_far).alias("until"))
    before = F.coalesce(F.lag("done").over(_line(key, begin)), F.lit(0.0))
    last = F.lead(F.lit(True)).over(_line(key, begin)).isNull()
    row = lambda a, b, name: F.struct(a.alias(begin), b.alias(end), name.alias(label))
    gap = lambda a, b, there: F.when(there & (b > a), row(a, b, F.lit("")))
    placed = placed.select("*", before.alias("before"), last.alias("last"))
    each = F.array(
        row(F.col(begin), F.col(end), F.col(label)),
        gap(F.col("before"), F.col(begin), F.lit(True)),
        gap(F.col("done"), F.col("until"), F.col("last")),
    )
    return placed.select(key, F.explode(each).alias("one")).filter("one IS NOT NULL").select(key, "one.*")


def transitions(rows: DataFrame, key: str, state: str) -> DataFrame:
    """i, j, n: how often a state follows another within a key."""
    step = rows.select(F.col(state).alias("i"), F.lead(state).over(_line(key)).alias("j"))
    return step.filter("j IS NOT NULL").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def normalise_rows(counts: DataFrame, by: str, x: str, name: str = "p") -> DataFrame:
    """Each value over its row's sum; rows that sum to 0 are kept."""
    total = F.sum(x).over(Window.partitionBy(by))
    return counts.withColumn(name, F.when(total != 0, F.col(x) / total).otherwise(F.col(x).cast("double")))


def hangover(rows: DataFrame, key: str, speech: str, start: int = 3, stop: int = 3) -> DataFrame:
    """in_speech by frame: on after start speech frames in a row, off after stop silent ones in a row."""
    last = lambda n: _line(key).rowsBetween(-(n - 1), 0)
    on = (F.sum(F.col(speech).cast("int")).over(last(start)) == start)
    off = (F.sum((~F.col(speech)).cast("int")).over(last(stop)) == stop)
    switch = F.when(on, True).when(off, False)
    marked = rows.withColumn("switch", switch)
    held = F.last("switch", ignorenulls=True).over(_line(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("in_speech", F.coalesce(held, F.lit(False))).drop("switch")


def framing(signals: DataFrame, key: str, samples: str, width: int, hop: int) -> DataFrame:
    """key, frame, samples of each whole window."""
    starts = F.when(F.size(samples) >= width, F.sequence(F.lit(0), F.size(samples) - width, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return signals.select(key, samples, F.posexplode(starts).alias("frame", "at")).select(key, "frame", F.slice(samples, F.col("at") + 1, F.lit(width)).alias("samples"))


def four_streams(frames: DataFrame, key: str, vec: str, width: int = 13) -> DataFrame:
    """key, frame, cep, dcep, power, ddcep: the layout of four streams. c0 and its differences are the power stream.

    dcep has the short differences (2 frames either way) and then the long ones (4); edges are repeated.
    """
    rest = lambda n: F.slice(shifted(vec, n, key), 2, width - 1)
    c0 = lambda n: F.get(shifted(vec, n, key), F.lit(0))
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    second = less(less(rest(3), rest(-1)), less(rest(1), rest(-3)))
    power = F.array(F.get(vec, F.lit(0)), c0(2) - c0(-2), (c0(3) - c0(-1)) - (c0(1) - c0(-3)))
    return frames.select(
        key, "frame", F.slice(vec, 2, width - 1).alias("cep"), F.concat(less(rest(2), rest(-2)), less(rest(4), rest(-4))).alias("dcep"), power.alias("power"), second.alias("ddcep")
    )


def single_stream(frames: DataFrame, key: str, vec: str, width: int = 13) -> DataFrame:
    """key, frame, feat: cepstra, short differences, power and second differences in one array, 3 * width long."""
    f = four_streams(frames, key, vec, width)
    return f.select(key, "frame", F.concat("cep", F.slice("dcep", 1, width - 1), "power", "ddcep").alias("feat"))


def estimated_maxima(utterances: DataFrame, stream: str, order: str, top: str, start: float = 0.0) -> DataFrame:
    """stream, order, estimate: the mean of the maxima (top) of the utterances before, start for the first.

    The history halves when it has 16 utterances. Maxima of -1000 and less count as nothing seen. A stream's
    utterances, one row each, are one Arrow group.
    """
    kinds = {c: utterances.schema[c].dataType.simpleString() for c in (stream, order)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        out, total, n, now = [], 0.0, 0, start
        for x in rows[top].to_numpy(float):
            out.append(now)
            if x > -1000.0:
                total, n = total + x, n + 1
                now = total / n
                if n == 16:
                    total, n = total / 2, 8
        return pd.DataFrame({stream: rows[stream], order: rows[order], "estimate": out})

    return utterances.select(stream, order, F.col(top).cast("double").alias(top)).groupBy(stream).applyInPandas(run, f"{stream} {kinds[stream]}, {order} {kinds[order]}, estimate double")
