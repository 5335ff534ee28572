"""Live front end on Structured Streaming: state per utterance, emitted as soon as enough frames are known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.frontend import QUIET, Analysis, FrontEnd, Noise, cut_frames, dithered, endpoint, seed_of
from ..operators.sequences import live_means_of


def live_deltas(frames: DataFrame, key: str, value: str, reach: int = 2) -> DataFrame:
    """key, frame, delta of a stream of (key, frame, value, last): the delta of frame t once t + reach is known.

    A row with last true ends its utterance: the edge frames are repeated and the state is dropped. The
    state holds at most 2 * reach + 1 values and the rows that came ahead of their turn.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done, end = state.get if state.exists else ([], 0, -1)
        known = {int(f): v for f, v in (x.split("=") for x in seen)}
        for batch in batches:
            for f, v, last in batch[["frame", value, "last"]].itertuples(index=False):
                known[int(f)] = repr(float(v))
                end = int(f) if last else end
        rows = []
        ready = 0  # frames known without a gap
        while done + ready in known:
            ready += 1
        upto = done + ready - 1
        first = min(known) if known else 0
        closed = end >= 0 and upto >= end
        while done <= upto and (done + reach <= upto or closed):
            high, low = min(done + reach, end if closed else upto), max(done - reach, max(0, first))
            rows.append((name[0], done, float(known[high]) - float(known[low])))
            done += 1
        if closed:
            state.remove()
        else:
            kept = [f"{f}={v}" for f, v in sorted(known.items()) if f >= done - reach]
            state.update((kept, done, end))
        yield pd.DataFrame(rows, columns=[key, "frame", "delta"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "frame", value, "last").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame int, delta double", "seen array<string>, done int, end_frame int", "append", GroupStateTimeout.NoTimeout
    )


def live_means(frames: DataFrame, key: str, value: str, start: float = 12.0, window: int = 500, most: int = 800) -> DataFrame:
    """key, frame, y of a stream: value less the running mean; the sums shrink to window frames past most frames.

    Rows of a key must come in the order of frames across batches. Values below 0 stay as they are and don't count.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, total, n = state.get if state.exists else (start, start * window, float(window))
        rows = pd.concat(list(batches)).sort_values("frame")
        x = rows[value].to_numpy(float)
        y, after = live_means_of(x, x, mean, total, n, window, most)
        state.update(after)
        yield pd.DataFrame({key: name[0], "frame": rows["frame"].astype("int32"), "y": y})

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "frame", value).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame int, y double", "mean double, total double, n double", "append", GroupStateTimeout.NoTimeout
    )


def endpoints(frames: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, frames: utterances of a stream as sessions closed by a gap; late rows within the watermark count."""
    sessions = frames.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap))
    return sessions.agg(F.count(F.lit(1)).alias("frames")).select(key, "session_window.start", "session_window.end", "frames")


def live_cepstra(pieces: DataFrame, key: str, samples: str, front: FrontEnd) -> DataFrame:
    """key, frame, vec, speech of a stream of (key, piece, samples, last): the frames of frontend.cepstra, each as soon as its samples are there.

    Pieces of a key may come in any order and are taken by number, from 0 on; last ends the recording and drops
    its state, which holds less than a frame of samples and the pieces that came ahead of their turn.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, before, seen, done, turn, ahead, end, heard = state.get if state.exists else ([], 0.0, 0, 0, 0, [], -1, [])
        waiting = {p["piece"]: list(p["samples"]) for p in ({"piece": int(x[0]), "samples": x[1:]} for x in ahead)}
        for batch in batches:
            for piece, x, last in batch[["piece", samples, "last"]].itertuples(index=False):
                waiting[int(piece)] = [float(v) for v in (x if x is not None else ())]
                end = int(piece) if last else end
        x = np.array(left, dtype=float)
        while turn in waiting:
            new = np.array(waiting.pop(turn), dtype=float)
            if front.dither:
                new = dithered(new, seen, seed_of(front, name[0]))
            seen, turn = seen + len(new), turn + 1
            x = np.concatenate([x, new])
        closed = 0 <= end < turn
        frames, used = cut_frames(x, before, closed, front)
        noise = Noise(front, list(heard))
        vec, speech = Analysis(front).features(frames, noise) if len(frames) else ([], [])
        if closed:
            state.remove()
        else:
            before = float(x[used - 1]) if used else before
            state.update((x[used:].tolist(), before, seen, done + len(vec), turn, [[float(k), *v] for k, v in sorted(waiting.items())], end, noise.state()))
        yield pd.DataFrame({key: name[0], "frame": np.arange(done, done + len(vec), dtype=np.int32), "vec": list(vec), "speech": speech})

    kind = pieces.schema[key].dataType.simpleString()
    held = "left array<double>, before double, seen long, done int, turn int, ahead array<array<double>>, end_piece int, heard array<double>"
    return pieces.select(key, "piece", samples, "last").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame int, vec array<double>, speech boolean", held, "append", GroupStateTimeout.NoTimeout
    )


def live_endpoints(frames: DataFrame, key: str, speech: str, start: int = 10, stop: int = 50, held: int = 20) -> DataFrame:
    """key, frame, segment of a stream of frames, as frontend.endpointed has them; rows of a key must come in the order of frames across batches.

    The state is the counters and at most held frames that a begin of speech would still take along.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        talking, before, after, segment, kept = state.get if state.exists else QUIET
        rows = pd.concat(list(batches)).sort_values("frame")
        flags = [bool(s) if s is not None and s == s else False for s in rows[speech]]
        now, found = endpoint((talking, before, after, segment, tuple(kept)), list(zip(rows["frame"].tolist(), flags, strict=True)), start, stop, held)
        state.update((*now[:4], list(now[4])))
        yield pd.DataFrame([(name[0], *x) for x in found], columns=[key, "frame", "segment"])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, F.col("frame").cast("int").alias("frame"), speech).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame int, segment int", "talking boolean, before int, after int, segment int, kept array<int>", "append", GroupStateTimeout.NoTimeout
    )
