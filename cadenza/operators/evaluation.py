"""Error rates, gates and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("hits", "subs", "dels", "ins")


def convergence(passes: DataFrame, order: str, total: str, frames: str, threshold: float, least: int = 0) -> DataFrame:
    """delta of the per-frame likelihood to the pass before (signed; null for the first) and whether it stops.

    After a likelihood of 0 the delta is the sign of the new one. No pass before the least-th stops.
    """
    line = Window.orderBy(order)  # one row a pass
    mean = F.col(total) / F.col(frames)
    before = F.lag(mean).over(line)
    delta = F.when(before == 0, F.signum(mean)).otherwise(mean - before)
    stop = F.coalesce(F.col("delta") <= threshold, F.lit(False)) & (F.col(order) >= least)
    return passes.withColumn("delta", delta).withColumn("stop", stop)


#: Rows times columns of the table of an alignment that is held at once.
CELLS = 1 << 22


def _last_row(ref: np.ndarray, hyp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The row of costs behind ref, given the one before it: a row at a time, insertions as a running minimum."""
    steps = np.arange(len(row))
    for word in ref:
        free = np.minimum(row[1:] + 1, row[:-1] + (hyp != word))
        row = np.minimum.accumulate(np.concatenate([[row[0] + 1], free]) - steps) + steps
    return row


def _operations(ref: np.ndarray, hyp: np.ndarray, row: np.ndarray) -> tuple[list[str], int]:
    """The operations, last one first, that lead from some column of row to the end of both; and that column.

    A table too large is halved: the row in its middle is made first, the lower half followed back to it.
    """
    if len(ref) * len(hyp) > CELLS and len(ref) > 1:
        half = len(ref) // 2
        lower, column = _operations(ref[half:], hyp, _last_row(ref[:half], hyp, row))
        upper, column = _operations(ref[:half], hyp[:column], row[: column + 1])
        return lower + upper, column
    cost = [row]
    for word in ref:
        cost.append(_last_row(np.array([word]), hyp, cost[-1]))
    out, i, j = [], len(ref), len(hyp)
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append("C" if ref[i] == hyp[j] else "S")
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append("D")
        else:
            j -= 1
            out.append("I")
    return out, j


def align(reference: list[str], hypothesis: list[str]) -> list[str]:
    """The edit operations C, S, D, I of a minimal alignment; ties: match or substitution, deletion, insertion.

    Long texts take time in proportion to the product of their lengths, but memory of a few rows and CELLS.
    """
    ids: dict[str, int] = {}
    ref, hyp = (np.array([ids.setdefault(w, len(ids)) for w in x], dtype=np.int64) for x in (reference, hypothesis))
    out, left = _operations(ref, hyp, np.arange(len(hyp) + 1))
    return ["I"] * left + out[::-1]


def word_counts(pairs: DataFrame, ref: str, hyp: str) -> DataFrame:
    """pairs with hits, subs, dels, ins of lower-cased words; an empty reference gives zeros."""

    @F.pandas_udf("hits int, subs int, dels int, ins int")
    def count(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(ref, hyp, strict=True):
            r, h = (r or "").lower().split(), (h or "").lower().split()
            ops = align(r, h) if r else []
            rows.append([ops.count(k) for k in "CSDI"])
        return pd.DataFrame(rows, columns=list(COUNTS), dtype=np.int32)

    return pairs.withColumn("c", count(ref, hyp)).select(*pairs.columns, "c.*")


def chunks(pairs: DataFrame, key: str, ref: str, hyp: str) -> DataFrame:
    """key, seq, kind, ref_start, ref_end, hyp_start, hyp_end of each run of one edit operation (ends exclusive)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, r, h in batch[[key, ref, hyp]].itertuples(index=False):
                ops = align((r or "").lower().split(), (h or "").lower().split())
                i = j = 0
                begin = 0
                seq = 0
                for n in range(1, len(ops) + 1):
                    if n == len(ops) or ops[n] != ops[begin]:
                        size, kind = n - begin, ops[begin]
                        di, dj = (kind != "I") * size, (kind != "D") * size
                        rows.append((k, seq, kind, i, i + di, j, j + dj))
                        i, j, begin, seq = i + di, j + dj, n, seq + 1
            yield pd.DataFrame(rows, columns=[key, "seq", "kind", "ref_start", "ref_end", "hyp_start", "hyp_end"])

    kind = pairs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, seq int, kind string, ref_start int, ref_end int, hyp_start int, hyp_end int"
    return pairs.select(key, ref, hyp).mapInPandas(run, schema)


def rates(scores: DataFrame, *by: str) -> DataFrame:
    """Summed counts and wer, mer, wil, wip recomputed from them; zeros where a total is 0."""
    h, s, d, i = (F.col(c) for c in COUNTS)
    summed = scores.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS])
    n_ref, n_hyp = h + s + d, h + s + i
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    wip = safe(h, n_ref) * safe(h, n_hyp)
    return summed.select(
        *by, *COUNTS, safe(s + d + i, n_ref).alias("wer"), safe(s + d + i, h + s + d + i).alias("mer"), (1 - wip).alias("wil"), wip.alias("wip")
    )


def letter_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes one code point from U+10000.

    There are a million of those; a pair of more distinct words would be an error, not a wrong distance.
    """
    # Bound once as a struct, so that no lookup makes the words again.
    bound = F.array(F.struct(ref.alias("ref"), hyp.alias("hyp"), F.array_distinct(F.concat(ref, hyp)).alias("words")))

    def distance(x: Column) -> Column:
        unit = lambda w: F.lpad(F.hex(F.array_position(x["words"], w) + 0xFFFF), 8, "0")
        letters = lambda side: F.decode(F.unhex(F.array_join(F.transform(side, unit), "")), "UTF-32")
        return F.levenshtein(letters(x["ref"]), letters(x["hyp"]))

    return F.get(F.transform(bound, distance), F.lit(0))


def bootstrap(scores: DataFrame, stratum: str, errors: str, words: str, draws: int, seed: int = 7, blocks: int = 32) -> DataFrame:
    """low, high: percentile interval (95 %) of the pooled error rate, resampling rows within each stratum.

    Rows are counted by stratum, errors and words first. Each stratum draws multinomial counts over these
    kinds, in blocks of draws dealt to tasks, and the sums of the strata are added by draw: neither rows nor
    kinds pass through the driver. An empty table gives nulls; draws without words have the rate 0.
    """
    kinds = scores.groupBy(F.col(stratum).cast("string").alias("s"), F.col(errors).cast("double").alias("e"), F.col(words).cast("double").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    size = -(-draws // blocks)

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["e", "w"])
        s, block = rows["s"].iloc[0], int(rows["block"].iloc[0])
        rng = np.random.default_rng([seed, block, *str(s).encode()])
        n = rows["n"].to_numpy(np.int64)
        first = block * size
        count = max(0, min(size, draws - first))
        e, w = np.zeros(count), np.zeros(count)
        for k in range(count):
            picked = rng.multinomial(int(n.sum()), n / n.sum())
            e[k], w[k] = picked @ rows["e"].to_numpy(), picked @ rows["w"].to_numpy()
        return pd.DataFrame({"draw": np.arange(first, first + count), "e": e, "w": w})

    each = kinds.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    drawn = each.groupBy("s", "block").applyInPandas(draw, "draw long, e double, w double")
    rates_ = drawn.groupBy("draw").agg(F.coalesce(F.try_divide(F.sum("e"), F.sum("w")), F.lit(0.0)).alias("rate"))
    ends = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))
    return rates_.agg(ends.alias("p")).select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def paired_gate(scores: DataFrame, stratum: str, errors: str, other: str, words: str, draws: int, seed: int = 7) -> DataFrame:
    """low, high, passed: interval of the paired difference of two systems' error rates; passes when high <= 0."""
    ends = bootstrap(scores.withColumn("_diff", F.col(errors) - F.col(other)), stratum, "_diff", words, draws, seed)
    return ends.withColumn("passed", F.col("high") <= 0)


def boundary_scores(reference: DataFrame, hypothesis: DataFrame, key: str, tolerances: tuple[float, ...] = (10.0, 20.0, 25.0, 50.0)) -> DataFrame:
    """Scores of the internal boundaries of each key, after a deterministic edit alignment of the labels.

    Both tables: key, seq, label, start, end (seconds). A boundary counts as comparable between two matches
    that follow each other in both sequences; its time is the midpoint of the left end and the right start.
    key, reference_boundaries, hypothesis_boundaries, comparable, insertions, deletions, substitutions,
    mean_error_ms and median_error_ms (infinite without comparable ones), and arrays tolerance_ms, recall,
    precision, f1. Keys of one side only are scored against nothing. An empty label, a time below 0, an end
    before its start or starts out of order are errors. One key's intervals are one utterance.
    """

    def listed(df: DataFrame, name: str) -> DataFrame:
        bad = (F.coalesce(F.col("label"), F.lit("")) == "") | (F.col("start") < 0) | (F.col("end") < F.col("start"))
        label = F.when(bad, F.raise_error(F.concat(F.lit(f"bad interval of {name} "), F.col(key).cast("string")))).otherwise(F.col("label"))
        each = F.struct("seq", label.alias("label"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
        return df.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias(name))

    def score(ref: list, hyp: list) -> list:
        for side in (ref, hyp):
            if any(b["start"] < a["start"] for a, b in zip(side, side[1:], strict=False)):
                raise ValueError("intervals out of order")
        ops = align([x["label"] for x in ref], [x["label"] for x in hyp])
        i = j = 0
        of = {}
        for op in ops:
            if op == "C":
                of[i] = j
            i, j = i + (op != "I"), j + (op != "D")
        off = []
        for n in range(1, len(ref)):
            a, b = of.get(n - 1), of.get(n)
            if a is not None and b == a + 1:
                off.append(abs((ref[n - 1]["end"] + ref[n]["start"]) - (hyp[a]["end"] + hyp[b]["start"])) * 500)
        n_ref, n_hyp = max(0, len(ref) - 1), max(0, len(hyp) - 1)
        hits = [sum(x <= t + 1e-9 for x in off) for t in tolerances]
        recall, precision = ([h / n if n else 0.0 for h in hits] for n in (n_ref, n_hyp))
        f1 = [2 * p * r / (p + r) if p + r else 0.0 for p, r in zip(precision, recall, strict=True)]
        middle = [float(np.mean(off)), float(np.median(off))] if off else [float("inf")] * 2
        return [n_ref, n_hyp, len(off), ops.count("I"), ops.count("D"), ops.count("S"), *middle, list(map(float, tolerances)), recall, precision, f1]

    names = ["reference_boundaries", "hypothesis_boundaries", "comparable", "insertions", "deletions", "substitutions", "mean_error_ms", "median_error_ms"]
    arrays = ["tolerance_ms", "recall", "precision", "f1"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = [[[] if x is None else list(x) for x in batch[c]] for c in ("reference", "hypothesis")]
            rows = [[k, *score(r, h)] for k, r, h in zip(batch[key], *sides, strict=True)]
            yield pd.DataFrame(rows, columns=[key, *names, *arrays])

    kind = reference.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join([f"{c} int" for c in names[:6]] + [f"{c} double" for c in names[6:]] + [f"{c} array<double>" for c in arrays])
    return listed(reference, "reference").join(listed(hypothesis, "hypothesis"), key, "full_outer").mapInPandas(run, schema)


def wer_summary(scores: DataFrame) -> DataFrame:
    """line_no, line: the totals of scores (COUNTS) and their rates as readable lines."""
    row = rates(scores)
    h, s, d, i = (F.col(c) for c in COUNTS)
    percent = lambda c: F.concat(F.format_string("%.2f", F.col(c) * 100), F.lit("%"))
    three = lambda c: F.format_string("%.3f", F.col(c))
    named = [
        ("Word Error Rate (WER):      ", percent("wer")), ("Match Error Rate (MER):     ", percent("mer")), ("Word Info Lost (WIL):       ", three("wil")),
        ("Word Info Preserved (WIP):  ", three("wip")), ("", F.lit("")), ("Reference words:  ", h + s + d), ("Hypothesis words: ", h + s + i), ("", F.lit("")),
        ("Correct (hits):   ", h), ("Substitutions:    ", s), ("Deletions:        ", d), ("Insertions:       ", i), ("Total errors:     ", s + d + i),
    ]
    return row.select(F.posexplode(F.array(*[F.concat(F.lit(n), v.cast("string")) for n, v in named])).alias("line_no", "line"))
