"""Pattern packing of documents into fixed-length sequences by non-negative least squares.

Tokenised documents are cut into pieces of at most LENGTH tokens. Only the histogram of piece lengths,
at most LENGTH numbers whatever the corpus, comes to the driver. There, patterns of a few lengths that
fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded down to what the histogram still has, and the residual is packed best-fit on the
histogram. The plan is one row per distinct pattern and place; on the executors each piece gets a rank
among the pieces of its length, and rank and length name its sequence and offset.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, in_small_batches

#: Tokens of a sequence, the id that ends a document, and pieces of a rank chunk.
LENGTH, END, CHUNK = 2048, 0, 262144
#: Words and parts of words in a cache generation of one Python worker.
CACHE = 80_000
#: How the tokenizer splits a word into parts.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


class Recent(dict):
    """A cache of two generations: a full one becomes the old one, from which what is used again comes back."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found


class WordIds(Recent):
    """Ids of the words between white space, where the tokenizer splits before anything else.

    Its normalisation works inside a word, so a text's ids are those of its words in turn. Words of
    Latin letters and marks are split here as its own splitting does, and their parts looked up in this
    same cache; others go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def make(self, word: str) -> bytes:
        if not word.isascii():
            if max(word) >= "\u0250":
                return self.ids(word)
            word = unicodedata.normalize("NFC", word)
        word = word.lower()
        if word.isalpha():
            return self.part(word)
        parts = [word[:-1], word[-1]] if word[-1] in ".," and word[:-1].isalpha() else PARTS.findall(word)
        return self.part(word) if parts == [word] else b"".join(map(self.__getitem__, parts))

    def part(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        found = self.model.tokenize(part if plain else "".join(self.letters[b] for b in part.encode()))
        return array("I", [t.id for t in found]).tobytes()

    def document(self, text: str) -> bytes:
        # Special tokens, and separators that Python splits at and the tokenizer doesn't, need the whole text.
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.split()))


_WORKER: dict[str, WordIds] = {}


def document_ids(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text followed by END, as little-endian unsigned 32-bit numbers."""
    if path not in _WORKER:
        _WORKER[path] = WordIds(path)
    words, end = _WORKER[path], END.to_bytes(4, "little")
    for text in texts:
        yield words.document(text or "") + end


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's tokens in pieces of at most length."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, ids in zip(batch["row"], document_ids(batch["text"].tolist(), path), strict=True):
                for n, a in enumerate(range(0, len(ids), 4 * length)):
                    cut = ids[a : a + 4 * length]
                    rows.append((row, n, a // 4, len(cut) // 4, zlib.crc32(cut), *([np.frombuffer(cut, "<u4").astype(np.int32)] * with_ids)))
            yield pd.DataFrame(rows, columns=["row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "row string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    out = in_small_batches(docs).select(F.col("doc_id").cast("string").alias("row"), "text").mapInPandas(run, schema)
    return out.select(F.col("row").cast(kind).alias("doc_id"), *out.columns[1:])


def patterns(present: np.ndarray, length: int) -> np.ndarray:
    """Rows of up to three lengths that fill a sequence exactly, descending, 0 for none.

    Third lengths come from a grid that keeps their number in proportion to length, not its square.
    """
    there = np.zeros(length + 1, dtype=bool)
    there[present] = True
    out = [(length, 0, 0)] * bool(there[length])
    out += [(a, length - a, 0) for a in range((length + 1) // 2, length) if there[a] and there[length - a]]
    step = max(1, length // 64)
    for c in range(step // 2 or 1, length // 3 + 1, step):
        near = np.flatnonzero(there[c : c + step])
        if not len(near):
            continue
        c += int(near[0])
        b = np.arange(c, (length - c) // 2 + 1)
        a = length - c - b
        fit = there[b] & there[a]
        out += [(int(x), int(y), c) for x, y in zip(a[fit], b[fit], strict=True)]
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise |A x - histogram|^2, by accelerated projected gradient."""
    if not len(rows):
        return np.zeros(0)
    n = len(histogram)

    def apply(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(rows[:, k], weights=x, minlength=n) for k in range(3))
        out[0] = 0
        return out

    want = histogram.astype(float)
    want[0] = 0
    v = np.ones(len(rows))
    for _ in range(30):  # the largest eigenvalue of A'A sets the step
        w = apply(v)
        v = w[rows].sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        r = apply(y) - want
        r[0] = 0
        new = np.maximum(0, y - r[rows].sum(axis=1) / (1.05 * norm))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, offset) rows that place every piece.

    Each row puts consecutive ranks of one length into consecutive sequences at one offset.
    """
    left = np.zeros(length + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[size] = n
    rank, out, sequence = np.zeros(length + 1, dtype=np.int64), [], 0

    def place(lengths: list[int], repeats: int) -> None:
        nonlocal sequence
        offset = 0
        for size in lengths:
            out.append((size, int(rank[size]), repeats, sequence, offset))
            rank[size] += repeats
            left[size] -= repeats
            offset += size
        sequence += repeats

    rows = patterns(np.flatnonzero(left), length)
    fitted = fit_counts(rows, left)
    for n in np.argsort(-fitted, kind="stable"):
        lengths = [int(x) for x in rows[n] if x]
        each = {x: lengths.count(x) for x in lengths}
        repeats = min(int(fitted[n]), *(int(left[x]) // k for x, k in each.items()))
        if repeats > 0:
            place(lengths, repeats)
    # The residual, best-fit decreasing on counts: open sequences are kept by the room they have left.
    opened: list[dict[tuple[int, ...], int]] = [{} for _ in range(length + 1)]
    rooms = np.zeros(length + 1, dtype=np.int64)
    for size in range(length, 0, -1):
        todo = int(left[size])
        while todo:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                content, there = opened[room].popitem()
                many = min(todo, there)
                rooms[room] -= many
                if there > many:
                    opened[room][content] = there - many
            else:
                many, content, room = todo, (), length
                # As many new sequences as will be filled by this size alone.
                per = length // size
                if per > 1:
                    many = -(-todo // per)
            now = (*content, size)
            opened[room - size][now] = opened[room - size].get(now, 0) + many
            rooms[room - size] += many
            todo -= many
    for contents in opened:
        for content, many in contents.items():
            place(list(content), many)
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null text is an empty document of one token, the final END. Only documents longer than length are
    cut. Rows that repeat a doc_id are separate documents. Places in a sequence are gapless from 0. An
    empty table gives an empty result. Other columns are not read.
    """
    cut = checkpoint(pieces(docs, path, length, with_ids))
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most length rows
    histogram = {r["length"]: r["n"] for r in counted}
    total = sum(histogram.values())
    rows = sorted(plan(histogram, length))
    of_length = np.array([r[0] for r in rows], dtype=np.int64)
    first = np.array([r[1] for r in rows], dtype=np.int64)
    sequence = np.array([r[3] for r in rows], dtype=np.int64)
    offset = np.array([r[4] for r in rows], dtype=np.int64)
    begins = np.searchsorted(of_length, np.arange(length + 2))

    # Ranks within a length: chunks by a hash keep a frequent length out of one task.
    chunks = -(-total // CHUNK) or 1
    dealt = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base")
    )
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("within", F.row_number().over(within) - 1).join(bases, ["length", "chunk"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(size), dtype=np.int64)
        for n in np.unique(size):
            a, b = begins[n], begins[n + 1]
            sel = size == n
            at[sel] = a + np.searchsorted(first[a:b], rank[sel], side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank - first[at], "offset": offset[at]})

    placed = ranked.withColumn("place", place("length", F.col("base") + F.col("within")))
    ids = ["ids"] * with_ids
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *ids)
