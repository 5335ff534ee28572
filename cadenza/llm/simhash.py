"""SimHash near-dedup by pivot distance tables.

Documents become 64-bit fingerprints of their 3-word shingles; equal fingerprints are merged first.
Fingerprints at 3 or fewer differing bits are found exactly, in two steps.

* Bands: the 64 bits form 5 blocks. Three differing bits leave at least 2 blocks equal, so linked
  fingerprints share at least one of the 10 keys made of two blocks (about 26 bits each).
* Pivot tables: inside a key, the Hamming distances to PIVOTS reference fingerprints are computed once
  for each fingerprint. By the triangle inequality a pair is discarded when any coordinate differs by
  more than the limit; rows sorted by the first coordinate only meet within that window. Survivors
  are verified on the fingerprints themselves.

A key shared by more than CROWD fingerprints is not compared pairwise. Its members emit every value
within 2 bits of themselves, marked when within 1: two fingerprints are at 3 bits or fewer exactly if
some value lies within 1 bit of one and 2 of the other, so joining the members of each value that has
a marked member finds the same components with work in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop_rows, in_small_batches, text_or_empty
from .components import components

#: Words of a shingle, seed of XXH64 and the largest linked distance.
SHINGLE, SEED, LIMIT = 3, 42, 3
#: Bits of the five blocks.
BLOCKS = (13, 13, 13, 13, 12)
#: Number of reference fingerprints and the most fingerprints of a key that are compared pairwise.
PIVOTS, CROWD = 16, 4096


def masks() -> list[int]:
    """The bits of each key: two of the five blocks, as signed 64-bit numbers."""
    starts = np.cumsum([0, *BLOCKS])
    blocks = [((1 << width) - 1) << int(at) for width, at in zip(BLOCKS, starts, strict=False)]
    return [(a | b) - (1 << 64) * ((a | b) >> 63) for a, b in combinations(blocks, 2)]


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudorandom values."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both by ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes = [digest(joined[a:b], seed) for a, b in spans]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 65536):
        part = h[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _digest(text: Column) -> dict[str, Column]:
    return {"d1": F.xxhash64(text_or_empty(text)), "d2": F.xxhash64(F.lit(1), text_or_empty(text))}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2 (a digest of 128 bits) and fp, a signed 64-bit number, of every row; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter(map(fingerprint, batch["text"]), dtype=np.int64, count=len(batch))
            yield pd.DataFrame({"row": batch["row"], "d1": batch["d1"], "d2": batch["d2"], "fp": fp})

    # The id travels as text, so that nulls and any integer type survive pandas.
    rows = in_small_batches(docs).select(F.col("doc_id").cast("string").alias("row"), *[d.alias(c) for c, d in _digest(F.col("text")).items()], "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, "row string, d1 long, d2 long, fp long").select(F.col("row").cast(kind).alias("doc_id"), "d1", "d2", "fp")


def _pairs(fp: np.ndarray, run: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs of one run number; rows are sorted by run and by the first pivot's distance."""
    table = np.bitwise_count(fp[:, None] ^ references()[None, :]).astype(np.int8)
    i, shift = np.arange(len(fp)), 1
    while True:
        i = i[i + shift < len(fp)]
        i = i[run[i] == run[i + shift]]
        i = i[table[i + shift, 0] - table[i, 0] <= limit]  # sorted: later rows are farther still
        if not len(i):
            return
        for part in np.array_split(i, -(-len(i) // 262144)):
            near = np.abs(table[part] - table[part + shift]).max(axis=1) <= limit
            part = part[near]
            part = part[np.bitwise_count(fp[part] ^ fp[part + shift]) <= limit]
            if len(part):
                yield part, part + shift
        shift += 1


def _forest(fp: np.ndarray, run: np.ndarray, rep: np.ndarray, limit: int) -> np.ndarray:
    """A spanning forest of the linked pairs, as pairs of representatives."""
    parent = np.arange(len(fp))

    def roots(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := parent[x], x):
            x = up
        return x

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept: list[tuple[int, int]] = []
    for a, b in _pairs(fp, run, limit):
        apart = roots(a) != roots(b)
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                kept.append((rep[x], rep[y]))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def _links_of_runs(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            which, key = rows["which"].to_numpy(), rows["key"].to_numpy()
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (which[1:] != which[:-1]) | (key[1:] != key[:-1])
            number = np.cumsum(new)
            size = np.bincount(number)[number]
            rows, number = rows[size > 1], number[size > 1]
            fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
            return pd.DataFrame(_forest(fp, number, rows["rep"].to_numpy(np.int64), limit), columns=["u", "v"])

        for batch in batches:  # sorted by key; the last key of a batch may go on in the next
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows["which"] == rows["which"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            held, rows = rows[last], rows[~last]
            if len(rows):
                yield found(rows)
        if held is not None:
            yield found(held)

    return run


def _balls(limit: int):
    """Values within limit - 1 of each fingerprint; near marks those within limit - 2 (limit is 3: 2 and 1)."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = np.array([a | b for a, b in combinations(one.tolist(), 2)], dtype=np.uint64)
    flips = np.concatenate([np.zeros(1, dtype=np.uint64), one, two])
    near = np.arange(len(flips)) <= 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.iloc[a : a + 64]
                z = part["fp"].to_numpy(np.int64).view(np.uint64)[:, None] ^ flips
                yield pd.DataFrame(
                    {"z": z.ravel().view(np.int64), "rep": np.repeat(part["rep"].to_numpy(), len(flips)), "near": np.tile(near, len(part))}
                )

    return run


def links(groups: DataFrame, crowd: int = CROWD, limit: int = LIMIT) -> DataFrame:
    """u, v: pairs of representatives that connect exactly what fingerprints at limit or fewer bits connect.

    groups: fp (distinct), rep (distinct long).
    """
    keys = F.array(*[F.struct(F.lit(n).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(masks())])
    keyed = groups.select("fp", "rep", F.inline(keys))
    crowded = checkpoint(keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("which", "key"))
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(references()[:1].view(np.int64)[0]))))
    out = None
    if not crowded.isEmpty():
        hot = keyed.join(crowded, ["which", "key"], "left_semi").select("fp", "rep").distinct()
        balls = hot.mapInPandas(_balls(limit), "z long, rep long, near boolean")
        # No value has more than 2,081 members, the number of values within 2 bits.
        centres = balls.groupBy("z").agg(F.min("rep").alias("v"), F.bool_or("near").alias("near")).filter("near").select("z", "v")
        out = balls.join(centres, "z").select(F.col("rep").alias("u"), "v").filter("u != v").distinct()
        keyed = keyed.join(crowded, ["which", "key"], "left_anti")
    runs = keyed.repartition("which", "key").sortWithinPartitions("which", "key", first)
    found = runs.mapInPandas(_links_of_runs(limit), "u long, v long")
    return found if out is None else found.union(out)


def _grouped(docs: DataFrame, crowd: int) -> DataFrame:
    """doc_id, d1, d2, fp, component (its least fingerprint) and component_id of every row."""
    rows = checkpoint(fingerprints(docs))
    groups = checkpoint(rows.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("rep")))
    # Fingerprints are the nodes: rows of one id may have several.
    roots = components(links(groups.filter(F.col("rep").isNotNull()).select("fp", F.col("fp").alias("rep")), crowd))
    of = checkpoint(groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("component")))
    ids = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.join(of.join(ids, "component").select("fp", "component", "component_id"), "fp")


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id reachable.
    Fewer than three words form one shingle; a text without words (null, empty or white space) has
    the fingerprint zero and links like any other. Copies share a fingerprint and so a component. A row
    without doc_id is grouped by its fingerprint; where no row of a fingerprint has an id, component_id
    is null. doc_id must be an integer. An empty table gives an empty result. Other columns are not read.
    """
    return _grouped(docs, crowd).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; every column stays.

    Rows are told apart by doc_id and text, so rows that share an id only don't share a verdict; of the texts
    of the smallest doc_id that of the least digest stays. Rows without doc_id stay.
    """
    rows = checkpoint(_grouped(docs, crowd).filter(F.col("doc_id").isNotNull()))
    own = F.when(F.col("doc_id") == F.col("component_id"), F.struct("d1", "d2"))
    kept = rows.groupBy("component").agg(F.min(own).alias("kept"))
    gone = (F.col("doc_id") != F.col("component_id")) | (F.struct("d1", "d2") != F.col("kept"))
    dropped = rows.join(kept, "component").filter(gone)
    return drop_rows(docs, dropped, {"doc_id": docs["doc_id"], **_digest(docs["text"])})
