"""Mixing sources to target weights, in fixed-length blocks.

The words of each source are packed into blocks of fixed length; a source's target becomes a number of
slots. Each output shard draws its slot counts of all sources from a multinomial whose probabilities
follow what is left of the targets, so the totals are met exactly. Slot t of a source with n blocks
takes block p(t mod n), p a pseudorandom permutation (a Feistel network with cycle walking) keyed by
source and epoch, and the join by block index tells how often each part of a document is taken.

The packing never needs a whole source in one task: documents are dealt by a hash of their id to chunks
of about CHUNK documents of one source, and each chunk fills blocks of its own.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, in_small_batches, text_or_empty

#: Weights in turn, by the source's place in code point order, and the limits of the contract.
WEIGHTS, SHARE, REPEATS = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words of a block, documents of a chunk, output shards.
BLOCK, CHUNK, SHARDS = 64, 4096, 64
#: Slots that one row expands to, and about as many as one task takes.
RUN, SLOTS_OF_TASK = 16384, 1_000_000


def count_words(text: Column) -> Column:
    """Number of words of a text, white space being space and tab to return; null has none."""
    white = r"[\x20\x09-\x0D]"
    t = text_or_empty(text)
    outer = F.substring(t, 1, 1).rlike(white).cast("long") + F.substring(t, -1, 1).rlike(white).cast("long")
    parts = F.size(F.split(t, white + "+")).cast("long")
    return F.when(t == "", F.lit(0).cast("long")).otherwise(parts - outer)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> dict[str | None, float]:
    """Words wanted of each source: share of all words by weight, at most repeats times the source's own."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, wanted, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if part[s] > repeats * sizes[s]]
        if not full:
            wanted |= part
            break
        for s in full:
            wanted[s] = repeats * sizes[s]
            left -= wanted[s]
        open_ = [s for s in open_ if s not in full]
    return wanted


def draw_shards(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts: each row a multinomial draw from what is left; columns sum to slots."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    out = np.zeros((shards, len(slots)), dtype=np.int64)
    for k in range(shards):
        want = int(left.sum()) // (shards - k)
        while want > 0:  # draws above what a source has left are drawn again among the others
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key, applied to index; arrays of one length."""
    n64 = n.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, n.astype(float) + 1))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    salt = key.astype(np.int64).view(np.uint64)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    x, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        y, h, m = x[todo], half[todo], low[todo]
        left, right = y >> h, y & m
        for turn in range(4):
            left, right = right, left ^ (mix(right ^ salt[todo] ^ np.uint64(turn << 56)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n64[todo]]  # cycle walking: outside of the range, go on
    return x.astype(np.int64)


def _blocks_of(docs: DataFrame, block: int, chunk: int, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the source's blocks, and the chunks; both checkpointed."""
    sized = checkpoint(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), *more))
    rows = sized.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    # The table of sources, one row each, is joined by Spark's own choice of strategy.
    dealt = sized.join(rows, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", *more,
        F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("rows") / chunk)).alias("chunk"),
    )
    line = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = checkpoint(dealt.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long"))))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        placed.groupBy("source", "chunk")
        .agg(F.sum("size").alias("words"))
        .withColumn("blocks", F.ceil(F.col("words") / block))
        .withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("long")))
    )
    return placed, checkpoint(chunks)


def _small_table(spark: SparkSession, rows: list[tuple], columns: dict[str, pa.DataType]) -> DataFrame:
    """rows as a DataFrame by way of Arrow, which takes no Python workers of its own."""
    named = {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(columns.items())}
    return spark.createDataFrame(pa.table(named))


def taken_pieces(
    docs: DataFrame, block: int = BLOCK, chunk: int = CHUNK, shards: int = SHARDS, seed: int = 6, more: list[str] = ()
) -> DataFrame:
    """Pieces of documents, one for each block a document reaches into, and how often the mix takes them.

    doc_id, source, size, source_size, target, chunk, start, from_word, to_word (null for documents
    without words), times; and the columns more of docs.
    """
    spark = docs.sparkSession
    placed, chunks = _blocks_of(docs, block, chunk, more)
    # One row per source comes to the driver, never documents.
    have = {r["source"]: r for r in chunks.groupBy("source").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks")).collect()}
    wanted = targets({s: r["words"] for s, r in have.items()})
    names = sorted((s for s in have if s is not None)) + [None] * (None in have)
    slots = [min(round(REPEATS * have[s]["blocks"]), round(wanted[s] * have[s]["blocks"] / have[s]["words"])) if have[s]["words"] else 0 for s in names]
    counts = draw_shards(slots, shards, seed)
    first = np.cumsum(counts, axis=0) - counts
    plan = [
        (n, int(have[s]["blocks"]), k, int(first[k, n]), int(counts[k, n]))
        for n, s in enumerate(names)
        for k in range(shards)
        if counts[k, n]
    ]
    named = [(n, s, float(wanted[s])) for n, s in enumerate(names)]
    sources = _small_table(spark, named, {"number": pa.int32(), "name": pa.string(), "target": pa.float64()})
    drawn = _small_table(spark, plan, {"number": pa.int32(), "blocks": pa.int64(), "shard": pa.int32(), "first": pa.int64(), "count": pa.int64()})

    @F.pandas_udf("long")
    def block_of(slot: pd.Series, blocks: pd.Series, number: pd.Series) -> pd.Series:
        n = blocks.to_numpy(np.int64)
        epoch = slot.to_numpy(np.int64) // n
        key = (number.to_numpy(np.int64) * 1_000_003 + epoch) * 7_919 + seed
        return pd.Series(permute(slot.to_numpy(np.int64) % n, n, key))

    runs = drawn.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(RUN).cast("long"))))
    # A number of its own: the rows are few before they expand, and would be put into one task.
    tasks = max(shards, sum(slots) // SLOTS_OF_TASK)
    each = runs.repartition(tasks, F.col("number"), F.col("shard"), F.col("at")).withColumn(
        "slot", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + RUN, F.col("count")) - 1))
    )
    times = each.select("number", block_of("slot", "blocks", "number").alias("index")).groupBy("number", "index").agg(F.count(F.lit(1)).alias("times"))

    base = chunks.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "base")
    with_base = placed.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    numbered = with_base.join(sources, F.col("source").eqNullSafe(F.col("name")))
    reach = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = numbered.select(
        "doc_id", "source", "size", "source_size", "target", "chunk", "start", "number", "base", *more,
        F.explode_outer(F.when(F.col("size") > 0, reach)).alias("b"),
    ).select(
        "doc_id", "source", "size", "source_size", "target", "chunk", "start", "number", *more,
        (F.col("base") + F.col("b")).alias("index"),
        (F.greatest(F.col("start"), F.col("b") * block) - F.col("start")).alias("from_word"),
        (F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.col("start")).alias("to_word"),
    )
    # Its size follows the corpus, which the plan can't see through the expansion: never broadcast.
    return pieces.join(times.hint("merge"), ["number", "index"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))


def mix(docs: DataFrame, block: int = BLOCK, chunk: int = CHUNK, shards: int = SHARDS, seed: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words the mix takes, with repeats).

    A null text has no words and is never taken; a null source is a source of its own, the last. Documents
    without words have taken 0. No part of a document is taken more than twice. Reruns agree: order and
    draws depend on ids, sizes and the seed only; rows that repeat an id are separate documents, and
    those that repeat id, source and size are told apart by their place only. An empty table gives an
    empty result. Other columns are not read.
    """
    pieces = taken_pieces(docs, block, chunk, shards, seed)
    words = F.coalesce(F.col("to_word") - F.col("from_word"), F.lit(0).cast("long"))
    # Rows that repeat an id have places of their own; repeats without words are counted apart below.
    key = ["doc_id", "source", "chunk", "start", "size", "source_size", "target"]
    out = pieces.groupBy(*key).agg(
        F.sum(words * F.col("times")).alias("taken"),
        F.sum((F.col("size") == 0).cast("long")).alias("same"),
    )
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("same", F.lit(1).cast("long"))))
    return out.select("doc_id", "size", "source_size", "target", "taken", repeated.alias("n")).drop("n")


_WORDS = re.compile(WORD)


def take_text(text: str, spans: list) -> str:
    """The taken parts of a text in order, then those that are taken again, each with its own white space."""
    starts = [m.start() for m in _WORDS.finditer(text)]
    starts[0] = 0
    ends = [*starts[1:], len(text)]
    spans = sorted((s["from_word"], s["to_word"], s["times"]) for s in spans)
    rounds = []
    for turn in range(1, max(t for *_, t in spans) + 1):
        rounds.append("".join(text[starts[a] : ends[b - 1]] for a, b, t in spans if t >= turn))
    return "\n".join(rounds)


def mixed_documents(docs: DataFrame, block: int = BLOCK, chunk: int = CHUNK, shards: int = SHARDS, seed: int = 6) -> DataFrame:
    """The mix as documents: the columns of docs, text made of the taken parts, n_chars (if there) its length.

    Documents of which nothing is taken are left out. Rows are told apart by numbers of their own, so doc_id
    may be null or repeated.
    """
    row = f"k_{uuid.uuid4().hex}"
    docs = checkpoint(docs.withColumn(row, F.monotonically_increasing_id()))  # fixes the numbers
    pieces = taken_pieces(docs, block, chunk, shards, seed, [row]).filter(F.col("times") > 0)
    spans = pieces.groupBy(F.col(row).alias("mixed_row")).agg(F.collect_list(F.struct("from_word", "to_word", "times")).alias("mixed_spans"))

    @F.pandas_udf("string")
    def build(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([take_text(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    others = [c for c in docs.columns if c not in ("text", "n_chars", row)]
    joined = in_small_batches(docs).join(spans, docs[row] == spans["mixed_row"])
    built = joined.select(*[docs[c] for c in others], build(docs["text"], spans["mixed_spans"]).alias("text"))
    if "n_chars" in docs.columns:
        built = built.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return built.select([c for c in docs.columns if c != row])
