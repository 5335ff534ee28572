"""Hidden Markov models over groups of frames: forward-backward, Viterbi and re-estimation.

Each utterance is one group, so applyInPandas spreads utterances over tasks and the recursion runs on the
arrays of one; the sums of a pass are DataFrame aggregates over what the groups emit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward_backward(emit: np.ndarray, start: np.ndarray, move: np.ndarray, beam: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, occupancies (frames, states) and expected moves (states, states).

    emit: log densities; the best of a frame is taken out before exp. States whose scaled alpha is below
    beam times the best are dropped.
    """
    n, k = emit.shape
    best = emit.max(axis=1)
    b = np.exp(emit - best[:, None])
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        a = (start if t == 0 else alpha[t - 1] @ move) * b[t]
        if beam:
            a = np.where(a < beam * a.max(), 0.0, a)
        scale[t] = a.sum()
        if scale[t] == 0:
            return -np.inf, np.zeros((n, k)), np.zeros((k, k))
        alpha[t] = a / scale[t]
    beta, moves = np.ones((n, k)), np.zeros((k, k))
    for t in range(n - 2, -1, -1):
        ahead = b[t + 1] * beta[t + 1] / scale[t + 1]
        moves += alpha[t][:, None] * move * ahead[None, :]
        beta[t] = move @ ahead
    return float(np.log(scale).sum() + best.sum()), alpha * beta, moves


def viterbi(emit: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray]:
    """Log score and states of the best path; ties go to the lower state."""
    with np.errstate(divide="ignore"):
        score, step = np.log(start) + emit[0], np.log(move)
    back = np.zeros(emit.shape, dtype=np.int64)
    for t in range(1, len(emit)):
        to = score[:, None] + step
        back[t] = to.argmax(axis=0)
        score = to.max(axis=0) + emit[t]
    path = [int(score.argmax())]
    for t in range(len(emit) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return float(score.max()), np.array(path[::-1])


def _emissions(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    off = x[:, None, :] - mean[None]
    return -0.5 * (off * off / var + np.log(2 * np.pi * var)).sum(axis=2)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def expectation(frames: DataFrame, key: str, model: dict, beam: float = 0.0) -> DataFrame:
    """key, kind, i, j, d, value of every utterance: ll, occupancy, weighted sums and moves to be summed.

    frames: key, frame, vec; model: start, move, mean, var (small arrays, shipped with the tasks). An
    utterance that no path explains emits its key with kind skip only, so a failure leaves no trace in the sums.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        x, name = _matrix(rows["vec"]), rows[key].iloc[0]
        ll, gamma, moves = forward_backward(_emissions(x, model["mean"], model["var"]), model["start"], model["move"], beam)
        if not np.isfinite(ll):
            return pd.DataFrame({key: [name], "kind": "skip", "i": 0, "j": 0, "d": 0, "value": 1.0})
        k, width = gamma.shape[1], x.shape[1]
        parts = [pd.DataFrame({"kind": ["ll", "frames"], "i": 0, "j": 0, "d": 0, "value": [ll, len(x)]})]
        parts.append(pd.DataFrame({"kind": "occ", "i": np.arange(k), "j": 0, "d": 0, "value": gamma.sum(axis=0)}))
        parts.append(pd.DataFrame({"kind": "start", "i": np.arange(k), "j": 0, "d": 0, "value": gamma[0]}))
        parts.append(pd.DataFrame({"kind": "move", "i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "d": 0, "value": moves.ravel()}))
        for label, y in (("sum", x), ("square", x * x)):
            parts.append(pd.DataFrame({"kind": label, "i": np.repeat(np.arange(k), width), "j": 0, "d": np.tile(np.arange(width), k), "value": (gamma.T @ y).ravel()}))
        return pd.concat(parts).assign(**{key: name})[[key, "kind", "i", "j", "d", "value"]]

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "frame", "vec").groupBy(key).applyInPandas(run, f"{key} {kind}, kind string, i int, j int, d int, value double")


def maximisation(sums: dict, model: dict, floor: float = 1e-4) -> dict:
    """The model from summed statistics; unobserved states keep their parameters."""
    occ = sums["occ"][:, 0, 0]
    seen = occ > 1e-10
    mean, var, move = model["mean"].copy(), model["var"].copy(), model["move"].copy()
    mean[seen] = sums["sum"][seen, 0] / occ[seen, None]
    var[seen] = np.maximum(floor, sums["square"][seen, 0] / occ[seen, None] - mean[seen] ** 2)
    rows = sums["move"][:, :, 0].sum(axis=1)
    move[rows > 0] = sums["move"][rows > 0, :, 0] / rows[rows > 0, None]
    first = sums["start"][:, 0, 0]
    return {"start": first / first.sum() if first.sum() else model["start"], "move": move, "mean": mean, "var": var}


def train(frames: DataFrame, key: str, model: dict, passes: int, least: int = 1, threshold: float = 0.0) -> tuple[dict, list[dict]]:
    """Baum-Welch passes until the signed gain per frame is at most threshold; the model and telemetry of each pass.

    Only summed statistics, of the model's size, come to the driver.
    """
    k, width = model["mean"].shape
    shapes = {"occ": (k, 1, 1), "start": (k, 1, 1), "move": (k, k, 1), "sum": (k, 1, width), "square": (k, 1, width), "ll": (1, 1, 1), "frames": (1, 1, 1), "skip": (1, 1, 1)}
    telemetry, before = [], None
    for n in range(1, passes + 1):
        rows = expectation(frames, key, model).groupBy("kind", "i", "j", "d").agg(F.sum("value").alias("value")).collect()
        sums = {name: np.zeros(shape) for name, shape in shapes.items()}
        for r in rows:
            sums[r["kind"]][r["i"], r["j"], r["d"]] = r["value"]
        count = sums["frames"].item()
        now = sums["ll"].item() / count if count else 0.0
        telemetry.append({"pass": n, "total_ll": sums["ll"].item(), "frames": int(count), "skipped": int(sums["skip"].item())})
        model = maximisation(sums, model)
        if n >= least and before is not None and now - before <= threshold:
            break
        before = now
    return model, telemetry


def best_paths(frames: DataFrame, key: str, model: dict) -> DataFrame:
    """key, frame, state, score: the Viterbi path of each utterance."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        score, path = viterbi(_emissions(_matrix(rows["vec"]), model["mean"], model["var"]), model["start"], model["move"])
        return pd.DataFrame({key: rows[key], "frame": rows["frame"], "state": path, "score": score})

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "frame", "vec").groupBy(key).applyInPandas(run, f"{key} {kind}, frame int, state int, score double")


def align(frames: DataFrame, transcripts: DataFrame, key: str, model: dict, stay: float = 0.5) -> DataFrame:
    """key, seq, state, start_frame, end_frame: frames forced through each transcript's states from left to right.

    transcripts: key, states (array of state numbers). Utterances with fewer frames than states yield no rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        states = np.array(rows["states"].iloc[0], dtype=np.int64)
        n, k = len(rows), len(states)
        if not k or n < k:
            return pd.DataFrame(columns=[key, "seq", "state", "start_frame", "end_frame"])
        emit = _emissions(_matrix(rows["vec"]), model["mean"], model["var"])[:, states]
        move = np.diag(np.full(k, stay)) + np.diag(np.full(k - 1, 1 - stay), 1)
        emit[:-1, :][np.arange(n - 1)[:, None] >= n - k + np.arange(k)[None, :]] = -np.inf  # the last state must be reached
        emit[-1, :-1] = -np.inf
        _, path = viterbi(emit, np.eye(k)[0], move)
        starts = np.searchsorted(path, np.arange(k))
        frame = rows["frame"].to_numpy()
        return pd.DataFrame({key: rows[key].iloc[0], "seq": np.arange(k), "state": states, "start_frame": frame[starts], "end_frame": frame[np.append(starts[1:], n) - 1]})

    kind = frames.schema[key].dataType.simpleString()
    joined = frames.select(key, "frame", "vec").join(transcripts.select(key, "states"), key)
    return joined.groupBy(key).applyInPandas(run, f"{key} {kind}, seq int, state int, start_frame int, end_frame int")


def regression(frames: DataFrame, dim: int) -> DataFrame:
    """d, row: the mean transform A m + b of each dimension that maximises the likelihood of posterior-weighted frames.

    frames: gamma, mean, var, vec (arrays of dim). Normal equations are summed by Spark and solved per dimension.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(dim + 1) for j in range(dim + 1)])
    e = frames.select("gamma", "var", "vec", F.concat("mean", F.array(F.lit(1.0))).alias("e"))
    each = e.select("gamma", "var", "vec", "e", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d")).select(
        "d", "e", (F.col("gamma") / F.get("var", F.col("d"))).alias("w"), F.get("vec", F.col("d")).alias("y"), F.explode(pairs).alias("p")
    )
    terms = each.groupBy("d", "p.i", "p.j").agg(
        F.sum(F.col("w") * F.get("e", F.col("p.i")) * F.get("e", F.col("p.j"))).alias("g"),
        F.sum(F.when(F.col("p.j") == 0, F.col("w") * F.col("y") * F.get("e", F.col("p.i"))).otherwise(0.0)).alias("k"),
    )

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        g, k = np.zeros((dim + 1, dim + 1)), np.zeros(dim + 1)
        g[rows["i"], rows["j"]] = rows["g"]
        np.add.at(k, rows["i"], rows["k"])
        return pd.DataFrame({"d": [rows["d"].iloc[0]], "row": [np.linalg.lstsq(g, k, rcond=None)[0].tolist()]})

    return terms.groupBy("d").applyInPandas(solve, "d int, row array<double>")
