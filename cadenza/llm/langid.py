"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of its frequent n-grams; the filters are stored bit-sliced, one mask of
language bits per filter position, so a few table lookups and ANDs return all languages that contain an
n-gram. A document's masks are counted per language, the counts corrected for the filters' expected
false positives, and the language with the largest corrected share wins.

The frequent n-grams come from a bounded sample of the labelled rows; at most 1/MIN_SHARE n-grams of an
order can be frequent in a language, which bounds the table for any corpus.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, in_small_batches

#: Orders of the n-grams, least share of a language's n-grams of one order, sampled rows of a language.
ORDERS, MIN_SHARE, SAMPLE = (2, 3, 4), 2e-5, 1500
#: Filter positions (a power of two) and lookups of an n-gram.
POSITIONS, HASHES = 1 << 20, 3
#: Fold of the rows that nothing is learned from.
MODULUS, HELD_OUT = 4, 2
#: Characters whose n-grams a Python worker holds at once.
PORTION = 50_000
#: Prediction for texts without letters.
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool))
    return _LETTERS[0]


def slices(texts: list[str], size: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about size characters, so that arrays stay small however long a batch is."""
    a = 0
    while a < len(texts):
        b, total = a, 0
        while b < len(texts) and (b == a or total + len(texts[b]) <= size):
            total += len(texts[b])
            b += 1
        yield a, b
        a = b


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """order, document number and hash of every n-gram: lower case, runs of other characters as one space."""
    encoded = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    code = np.concatenate(encoded) if encoded else np.zeros(0, dtype="<u4")
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in encoded])
    letter = letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # others stay next to letters, as spaces; each text begins and ends with one
    keep[:-1] |= letter[1:]
    code, doc = np.where(letter, code, 32)[keep].astype(np.uint64), doc[keep]
    double = np.zeros(len(code), dtype=bool)
    double[1:] = (code[1:] == 32) & (code[:-1] == 32) & (doc[1:] == doc[:-1])
    code, doc = code[~double], doc[~double]
    h = code + np.uint64(1)
    for order in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint64(0x100000001B3) + code[order - 1 :]
        if order in ORDERS:
            whole = doc[: len(h)] == doc[order - 1 :]
            yield order, doc[: len(h)][whole], _mix(h[whole] + np.uint64(order))


def _positions(h: np.ndarray) -> list[np.ndarray]:
    bits = POSITIONS.bit_length() - 1
    return [((h >> np.uint64(n * bits)) & np.uint64(POSITIONS - 1)).astype(np.int64) for n in range(HASHES)]


class Filters:
    """Bit-sliced filters: table[word, position] holds the bits of up to 64 languages."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        words = max(1, -(-len(languages) // 64))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.table = np.zeros((words, POSITIONS), dtype=kind)
        filled = []
        for n, h in enumerate(members):
            for at in _positions(h):
                self.table[n // 64, at] |= kind(1 << (n % 64))
            share = np.count_nonzero(self.table[n // 64] & kind(1 << (n % 64))) / POSITIONS
            filled.append(share**HASHES)
        self.false_positive = np.array(filled)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts (documents, languages) of n-grams that a language contains, and all n-grams of each document."""
        count = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        total = np.zeros(len(texts), dtype=np.int64)
        for _, doc, h in grams(texts):
            at = _positions(h)
            total += np.bincount(doc, minlength=len(texts))
            for word, row in enumerate(self.table):
                mask = row[at[0]]
                for x in at[1:]:
                    mask = mask & row[x]
                if row.dtype == np.uint8:
                    seen = np.bincount(doc * 256 + mask, minlength=256 * len(texts)).reshape(-1, 256)
                    for n in range(len(self.languages)):
                        count[:, n] += seen[:, (np.arange(256) >> n) & 1 == 1].sum(axis=1)
                else:
                    for n in range(word * 64, min(len(self.languages), word * 64 + 64)):
                        has = (mask >> np.uint64(n % 64)) & np.uint64(1)
                        count[:, n] += np.bincount(doc, weights=has, minlength=len(texts)).astype(np.int64)
        return count, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t or "" for t in texts]
        names, scores = [], np.zeros(len(texts))
        for a, b in slices(known, PORTION):
            count, total = self.hits(known[a:b])
            share = count / np.maximum(1, total)[:, None]
            if not self.languages:
                names += [UNDETERMINED] * (b - a)
                continue
            right = np.clip((share - self.false_positive) / np.maximum(1e-9, 1 - self.false_positive), 0, 1)
            best = np.argmax(right, axis=1)  # ties: the first by code point
            for n in range(b - a):
                if total[n]:
                    names.append(self.languages[best[n]])
                    scores[a + n] = right[n, best[n]]
                else:  # a letter makes an n-gram, with the spaces around it
                    names.append(UNDETERMINED)
        return names, scores


def bounded_sample(rows: DataFrame, group: Column, order: Column, bound: int, totals: DataFrame) -> DataFrame:
    """At most bound rows of each group, those of least hash order; totals: group as g, n rows.

    A hash threshold first thins each group to about 1.2 times the bound, so that the ranking window
    sees few rows of any group, however large. totals has one row a group (a label or a language) and is
    broadcast, so that rows aren't shuffled by group.
    """
    part = F.pmod(order, F.lit(1 << 40)).cast("double") / float(1 << 40)
    thin = rows.withColumn("g", group).join(F.broadcast(totals), "g").filter(part < F.lit(1.2 * bound + 100) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(order))
    return thin.withColumn("rank_in_g", rank).filter(F.col("rank_in_g") <= bound).drop("rank_in_g", "n")


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from text and lang of rows outside the held-out fold; null text or lang teaches nothing."""
    rows = in_small_batches(docs).select("doc_id", "text", "lang").filter(
        (fold(F.col("doc_id"), MODULUS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    totals = rows.groupBy(F.col("lang").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    taught = bounded_sample(rows, F.col("lang"), F.xxhash64("doc_id", "lang"), sample, totals).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                texts = rows["text"].tolist()
                for a, b in slices(texts, PORTION):
                    for order, _, h in grams(texts[a:b]):
                        found, n = np.unique(h, return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram_order": order, "gram": found.view(np.int64), "n": n})

    counted = taught.mapInPandas(count, "lang string, gram_order int, gram long, n long")
    summed = counted.groupBy("lang", "gram_order", "gram").agg(F.sum("n").alias("n"))
    whole = summed.groupBy("lang", "gram_order").agg(F.sum("n").alias("whole"))  # of the sums, so that texts are counted once
    frequent = summed.join(F.broadcast(whole), ["lang", "gram_order"]).filter(F.col("n") >= F.greatest(F.lit(2), F.col("whole") * MIN_SHARE))
    table = frequent.select("lang", "gram").toArrow().to_pandas()  # at most orders / MIN_SHARE rows a language
    languages = sorted(table["lang"].unique())
    members = [table.loc[table["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64) for x in languages]
    return Filters(languages, members)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. See predict_language."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = shared.value.predict(batch["text"].tolist())
            yield pd.DataFrame({"row": batch["row"], "lang_pred": names, "score": scores})

    rows = docs.select(F.col("doc_id").cast("string").alias("row"), "text")
    found = rows.mapInPandas(run, "row string, lang_pred string, score double")
    doc_id = F.col("row").cast(kind)
    return found.select(doc_id.alias("doc_id"), (fold(doc_id, MODULUS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def predict_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (the corrected share of n-grams, 0 to 1).

    Learned from at most sample rows of each language outside the held-out fold. A text that is null or
    has no letter is und with score 0; so is every text if nothing could be learned. Ties go to the
    first language by code point. Whole texts count, however long. A row without doc_id is in the fold
    of the empty text. Rows that repeat are each returned. Other columns are not read.
    """
    return identify(docs, learn(docs, sample))


def drop_undetermined(docs: DataFrame, sample: int = SAMPLE, least: float = 0.2) -> DataFrame:
    """docs without the rows whose text has no letter or whose best language covers less than least of its n-grams.

    Where nothing could be learned, every text with a letter stays.
    """
    filters = learn(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        if not shared.value.languages:
            return pd.Series([any(letters()[ord(c)] for c in t or "") for t in text], dtype=bool)
        names, scores = shared.value.predict(text.tolist())
        return pd.Series((np.array(names, dtype=object) != UNDETERMINED) & (scores >= least), dtype=bool)

    return docs.filter(known("text"))
