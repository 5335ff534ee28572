"""Repair of conversations by composition of weighted automata, on damaged turns.

An input acceptor (the turns in their order), an edit transducer (keep, rerole, delete, insert) and a grammar
acceptor of roles, (s?(ua)+)?, are composed lazily: only the states (turn, grammar state) are expanded, from the
last turn to the first, which is a topological order. Insertions are followed at most as far as the grammar goes
without reading a turn. Weights are pairs of a cost and a label string, compared in this order: the backward
pass gives each state its least cost, and the walk forward takes the least label among the arcs on cheapest paths.
A label decides its arc, and no cheapest string is the prefix of another over the same turns, so the walk gives
the least string.

No task needs a whole conversation: one global sort orders the turns, parts of at most PART turns become cost
matrices over the four grammar states, a pass over the matrices of a conversation gives the cost behind each
part, and the walk is done by part for every state in which it may be entered. Only the digest of the repaired
text, sequential by its nature, streams the turns of a conversation through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, in_small_batches

#: Neighbouring turns that one task handles at once: two to this power.
PART_BITS = 12
#: Costs of the edits; what a truncated turn costs that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The grammar: what each state reads and where it leads. 0: nothing yet, 1: system, 2: user, 3: user and assistant.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
STATES = range(len(GRAMMAR))
#: No path.
FAR = 1 << 60
#: Faults by number; 0 is none.
BLANK, DUPLICATE, CUT = 1, 2, 3

#: Parts of at most SHORT turns are alike so often that each task keeps what it found for KNOWN of them.
SHORT, KNOWN = 16, 1 << 16

#: How to rewrite one turn: roles inserted before it, whether it stays, its new role if any, roles inserted after it.
EDIT = "struct<at:bigint,before:array<string>,kept:boolean,role:string,after:array<string>>"


def inserted(costs: list[int]) -> list[int]:
    """Least costs when turns may first be inserted."""
    out = list(costs)
    for _ in STATES:
        out = [min([out[g], *(INSERT + out[to] for role, to in GRAMMAR[g].items() if role in ROLES)]) for g in STATES]
    return out


def arcs(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """label, cost and next state of the arcs that read one turn, by label."""
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    if initial in GRAMMAR[state]:
        out.append(("K", more, GRAMMAR[state][initial]))
    return out + [("R", REROLE + more, to) for role, to in GRAMMAR[state].items() if role in ROLES]


def consumed(costs: list[int], initial: str, fault: int) -> list[int]:
    """Least costs before one turn, given those behind it."""
    return [min(cost + costs[to] for _, cost, to in arcs(g, initial, fault)) for g in STATES]


def behind(turns, end: list[int]) -> list[list[int]]:
    """Least costs before each turn and at the end, where they are end."""
    out = [end]
    for initial, fault in reversed(turns):
        out.append(inserted(consumed(out[-1], initial, fault)))
    return out[::-1]


#: At the end of a conversation.
END = inserted([0 if g in FINAL else FAR for g in STATES])


def walk(turns, end: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least label string of the cheapest paths from state over turns, and the state they end in.

    What may be inserted behind the turns belongs to the next part, unless this is the last one.
    """
    costs, labels, i = behind(turns, end), [], 0
    while i < len(turns) or (last and not (state in FINAL and costs[i][state] == 0)):
        least = costs[i][state]
        if least >= FAR:
            return "", state
        steps = [(a, to, 1) for a, cost, to in arcs(state, *turns[i]) if cost + costs[i + 1][to] == least] if i < len(turns) else []
        steps += [("I", to, 0) for role, to in GRAMMAR[state].items() if role in ROLES and INSERT + costs[i][to] == least]
        label, state, read = min(steps)
        labels.append(label)
        i += read
    return "".join(labels), state


def edits(labels: str, state: int, turns: list) -> list[tuple]:
    """EDIT rows (before, kept, role, after) of the turns, for labels from state on."""
    out, before, i = [], [], 0
    for label in labels:
        if label == "I":
            role = next(r for r in GRAMMAR[state] if r in ROLES)
            state = GRAMMAR[state][role]
            before.append(ROLES[role])
            continue
        initial = turns[i][0]
        new = None
        if label == "K":
            state = GRAMMAR[state][initial]
        elif label == "R":
            role = next(r for r in GRAMMAR[state] if r in ROLES)
            state, new = GRAMMAR[state][role], ROLES[role]
        out.append([before, label != "D", new, []])
        before, i = [], i + 1
    if before:
        out[-1][3] = before
    return out


def _conv() -> Column:
    """conv: conv_id as a text that is never null, as Python sees large numbers next to nulls as floats."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy: the turns after damage by the CRC-32 of conv_id:turn; nulls are written as one space."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(written("text"), "[.!?]", "")).otherwise(written("text"))
    role = F.when(what == 4, "user").otherwise(written("role"))
    copies = F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(what != 0).select(_conv(), "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def faulty(turns: DataFrame) -> DataFrame:
    """conv, turn, at, initial, fault of turns in their order (at); a duplicate repeats role and text of an earlier turn."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    slim = turns.select("conv", "turn", "at", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut"), key.alias("key"))
    first = slim.groupBy("conv", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    return slim.join(first, "at", "left").select("conv", "turn", "at", "initial", fault.alias("fault"))


def _each(frame: DataFrame, keys: list[str], names: list[str], work, schema: str) -> DataFrame:
    """The keys (texts and longs) of frame and what work makes of the columns names, row by row inside batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [work(*row) for row in zip(*[batch[n] for n in names], strict=True)]
            yield pd.DataFrame({k: batch[k].to_numpy() for k in keys} | {f: [x[n] for x in got] for n, f in enumerate(fields)})

    fields = [x.strip().split(" ")[0] for x in schema.split(";")]
    kept = "".join(f"{k} {frame.schema[k].dataType.simpleString()}, " for k in keys)
    return frame.select(*keys, *names).mapInPandas(run, kept + schema.replace(";", ","))


def _turns(rows) -> list[tuple[str, int]]:
    return [(r["initial"], r["fault"]) for r in rows]


@lru_cache(KNOWN)
def _matrix_of(turns: tuple) -> tuple:
    """Least costs of the turns from each state to each, row by row, and the illegal pairs inside them."""
    columns = [behind(turns, [0 if g == to else FAR for g in STATES])[0] for to in STATES]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return [columns[to][g] for g in STATES for to in STATES], illegal, turns[0][0], turns[-1][0]


@lru_cache(KNOWN)
def _walks_of(turns: tuple, end: tuple, last: bool) -> tuple:
    """Labels and last state for each state in which the turns may be entered."""
    found = [walk(turns, list(end), g, last) for g in STATES]
    return [x for x, _ in found], [to for _, to in found]


def _matrix(rows) -> tuple:
    turns = tuple(_turns(rows))
    return (_matrix_of if len(turns) <= SHORT else _matrix_of.__wrapped__)(turns)


def _suffixes(parts) -> tuple:
    """The costs behind each part of one conversation, from its last part on, with the illegal pairs that end in it; the cost of all."""
    end, out = END, []
    for x in reversed(parts):
        out.append(end)
        end = inserted([min(x["costs"][g * len(STATES) + to] + end[to] for to in STATES) for g in STATES])
    before = [None, *(x["tail"] for x in parts[:-1])]
    pairs = [x["illegal"] + (b is not None and b + x["head"] not in ("su", "ua", "au")) for x, b in zip(parts, before, strict=True)]
    made = zip(parts, pairs, reversed(out), strict=True)
    ends = [{"part": int(x["part"]), "illegal": int(n), "end": e, "last": x is parts[-1]} for x, n, e in made]
    return ends, end[0]


def _entries(parts) -> tuple:
    """The state in which each part of one conversation is entered."""
    state, out = 0, []
    for x in parts:
        out.append({"part": int(x["part"]), "entry": state})
        state = int(x["exits"][state])
    return (out,)


def _walks(rows, end, last) -> tuple:
    turns, end = tuple(_turns(rows)), tuple(int(x) for x in end)
    return (_walks_of if len(turns) <= SHORT else _walks_of.__wrapped__)(turns, end, bool(last))


def _edits(rows, entry, labels) -> tuple:
    found = edits(labels[entry], entry, _turns(rows))
    return labels[entry], [{"at": r["at"], "before": b, "kept": k, "role": n, "after": a} for r, (b, k, n, a) in zip(rows, found, strict=True)]


def repair(rows: DataFrame, part_bits: int = PART_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of rows.

    rows: conv_id, turn, role, text; others are not read. They are damaged first (see damaged). Turns lie by turn,
    null first; rows of one turn by role and text, copies next to each other. A null conv_id is a
    conversation of its own. Whole texts are read. A conversation all of whose turns were dropped has zeros, an empty
    audit and the digest of the empty text. An empty table gives an empty result.
    """
    by = ["conv", F.asc_nulls_first("turn"), "role", "text", "copy"]
    turns = checkpoint(damaged(rows).orderBy(*by).withColumn("at", F.monotonically_increasing_id()))
    marked = checkpoint(faulty(turns))

    seen = marked.groupBy("conv", "turn").agg(*[F.count(F.when(F.col("fault") == n, 1)).alias(f"f{n}") for n in (BLANK, DUPLICATE, CUT)])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    sums = seen.groupBy("conv").agg(gaps.alias("gaps"), F.sum("f1").alias("blank"), F.sum("f2").alias("duplicate"), F.sum("f3").alias("truncated"))

    listed = F.array_sort(F.collect_list(F.struct("at", "initial", "fault")))
    parts = in_small_batches(checkpoint(marked.groupBy("conv", F.shiftright("at", part_bits).alias("part")).agg(listed.alias("rows"))))
    matrices = _each(parts, ["conv", "part"], ["rows"], _matrix, "costs array<long>; illegal long; head string; tail string")

    # A conversation's parts become one short row each time: some numbers for a part.
    of_conv = lambda frame, *names: frame.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", *names))).alias("parts"))
    ends = _each(of_conv(matrices, "costs", "illegal", "head", "tail"), ["conv"], ["parts"], _suffixes, "ends array<struct<part:bigint,illegal:bigint,end:array<bigint>,last:boolean>>; cost long")
    ends = checkpoint(ends)
    # Both sides of the joins by part have one row for each.
    open_ = parts.join(ends.select("conv", F.explode("ends").alias("e")).select("conv", "e.*").drop("illegal"), ["conv", "part"])
    walks = checkpoint(_each(open_, ["conv", "part"], ["rows", "end", "last"], _walks, "labels array<string>; exits array<int>"))
    chosen = _each(of_conv(walks, "exits"), ["conv"], ["parts"], _entries, "entries array<struct<part:bigint,entry:int>>")
    chosen = chosen.select("conv", F.explode("entries").alias("e")).select("conv", "e.*")
    whole = parts.join(chosen, ["conv", "part"]).join(walks.select("conv", "part", "labels"), ["conv", "part"])
    edited = checkpoint(_each(whole, ["conv", "part"], ["rows", "entry", "labels"], _edits, f"labels string; edits array<{EDIT}>"))

    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "labels"))), lambda x: x["labels"])
    audits = edited.groupBy("conv").agg(F.array_join(pieces, "").alias("audit"))
    illegal = F.aggregate("ends", F.lit(0).cast("long"), lambda n, e: n + e["illegal"])
    costs = ends.select("conv", illegal.alias("illegal"), "cost")

    out = rows.select("conv_id", _conv()).distinct()
    for right in (sums, costs, audits, digests(repaired_lines(turns, edited))):
        out = out.join(right, "conv", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def repaired_lines(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """conv, line of the repaired conversations, each conversation in one partition, its lines in their order.

    A turn and its edit meet as neighbours in the order of turns, so that texts move once and tasks hold a batch.
    """
    edit = edited.select("conv", F.explode("edits").alias("edit")).select("conv", F.col("edit.at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "edit")
    said = turns.select("conv", "at", F.lit(1).alias("side"), "role", "text", F.lit(None).cast(EDIT).alias("edit"))
    ordered = said.unionByName(edit).repartition("conv").sortWithinPartitions("conv", "at", "side")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            lines = []
            for conv, side, role, text, change in zip(batch["conv"], batch["side"], batch["role"], batch["text"], batch["edit"], strict=True):
                if not side:
                    now = change
                    continue
                lines += [(conv, f"{r}:") for r in now["before"]]
                if now["kept"]:
                    lines.append((conv, f"{role if now['role'] is None else now['role']}:{text}"))
                lines += [(conv, f"{r}:") for r in now["after"]]
            yield pd.DataFrame(lines, columns=["conv", "line"], dtype=object)

    return in_small_batches(ordered.select("conv", "side", "role", "text", "edit")).mapInPandas(merge, "conv string, line string")


def digests(lines: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the conversations of which a line is left, streamed in the order of repaired_lines."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, names = None, None, ["conv", "repaired_sha256"]
        for batch in batches:
            done = []
            for conv, line in zip(batch["conv"], batch["line"], strict=True):
                if conv == now:
                    state.update(b"\n" + line.encode())
                    continue
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = conv, hashlib.sha256(line.encode())
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=names)

    return lines.mapInPandas(digest, "conv string, repaired_sha256 string")


SQL = """
WITH RECURSIVE k AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda p: CAST(ord(substr(key, CAST(p AS INTEGER), 1)) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, n: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))
    ), 4294967295) % 20 AS what
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE what <> 0
), o AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM d
), t AS (
  SELECT conv_id, conv, i, turn, role, text, substr(role, 1, 1) AS g,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) || substr(role, 1, 1) AS pair
  FROM o
), paths AS (
  -- The least (cost, labels) by which each grammar state is reached before turn i + 1.
  SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, {'c': 0, 'l': ''} AS s0, CAST(NULL AS STRUCT(c INTEGER, l VARCHAR)) AS s1,
    {'c': 3, 'l': 'I'} AS s2, {'c': 6, 'l': 'II'} AS s3 FROM t
  UNION ALL
  SELECT conv, i, s0, s1, s2, least(s3, CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 3, 'l': s2.l || 'I'} END) FROM (
    SELECT conv, i, s0, s1, s3, list_min(list_filter([s2] || list_transform([s0, s1, s3], lambda s: CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'l': s.l || 'I'} END), lambda s: s IS NOT NULL)) AS s2 FROM (
      SELECT p.conv, t.i, {'c': s0.c + 4, 'l': s0.l || 'D'} AS s0,
        list_min(list_filter([CASE WHEN s1 IS NOT NULL THEN {'c': s1.c + 4, 'l': s1.l || 'D'} END, CASE WHEN fault IN (0, 3) AND g = 's' THEN {'c': s0.c + fault, 'l': s0.l || 'K'} END], lambda s: s IS NOT NULL)) AS s1,
        list_min(list_filter([CASE WHEN s2 IS NOT NULL THEN {'c': s2.c + 4, 'l': s2.l || 'D'} END]
          || list_transform([s0, s1, s3], lambda s: CASE WHEN s IS NOT NULL AND fault IN (0, 3) AND g = 'u' THEN {'c': s.c + fault, 'l': s.l || 'K'} END)
          || list_transform([s0, s1, s3], lambda s: CASE WHEN s IS NOT NULL AND fault IN (0, 3) THEN {'c': s.c + 3 + fault, 'l': s.l || 'R'} END), lambda s: s IS NOT NULL)) AS s2,
        list_min(list_filter([CASE WHEN s3 IS NOT NULL THEN {'c': s3.c + 4, 'l': s3.l || 'D'} END,
          CASE WHEN s2 IS NOT NULL AND fault IN (0, 3) AND g = 'a' THEN {'c': s2.c + fault, 'l': s2.l || 'K'} END,
          CASE WHEN s2 IS NOT NULL AND fault IN (0, 3) THEN {'c': s2.c + 3 + fault, 'l': s2.l || 'R'} END], lambda s: s IS NOT NULL)) AS s3
      FROM paths p JOIN t ON t.conv = p.conv AND t.i = p.i + 1
    )
  )
), best AS (
  SELECT conv, least(s0, s3) AS s FROM paths QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1
), chars AS (
  SELECT conv, n, substr(s.l, CAST(n AS INTEGER), 1) AS label FROM (SELECT conv, s, unnest(range(1, length(s.l) + 1)) AS n FROM best)
), steps AS (
  SELECT *, count(*) FILTER (label <> 'I') OVER w AS i, count(*) FILTER (label <> 'D') OVER w AS place FROM chars WINDOW w AS (PARTITION BY conv ORDER BY n)
), placed AS (
  SELECT s.*, t.role, t.text, max(CASE WHEN place = 1 AND label = 'K' AND g = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv) AS system
  FROM steps s LEFT JOIN t ON t.conv = s.conv AND t.i = s.i AND label <> 'I' WHERE label <> 'D'
), texts AS (
  SELECT conv, sha256(string_agg(CASE label WHEN 'K' THEN role ELSE CASE WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY n)) AS sha
  FROM placed GROUP BY conv
), sums AS (
  SELECT conv_id, conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM t GROUP BY conv_id, conv
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.s.c, 0) AS BIGINT) AS cost, coalesce(b.s.l, '') AS audit, coalesce(x.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv = sums.conv
LEFT JOIN texts x ON x.conv = sums.conv
"""
