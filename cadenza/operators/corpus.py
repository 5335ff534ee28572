"""Vocabulary, lexicon, reconciliation and split operators over transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, token of every word."""
    return texts.select(key, F.posexplode(T.words(F.col(text))).alias("pos", "token"))


def vocabulary(texts: DataFrame, key: str, text: str) -> DataFrame:
    return tokens(texts, key, text).select("token").distinct()


def out_of_vocabulary(texts: DataFrame, lexicon: DataFrame, key: str, text: str, examples: int = 3) -> DataFrame:
    """token, n, and the first example keys of tokens that the lexicon (word) lacks."""
    # Counted by token and key before the join, so frequent words cost one row a task and key.
    counted = tokens(texts, key, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
    return counted.join(lexicon.select(F.col("word").alias("token")).distinct(), "token", "left_anti")


def near_misses(unknown: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Unknown tokens that differ from a word by case or by punctuation at the edges only, with the hint."""
    words = lexicon.select("word").distinct()
    folded = words.groupBy(F.lower("word").alias("form")).agg(F.min("word").alias("meant"))
    by_case = unknown.join(folded, F.lower("token") == F.col("form")).select("token", F.lit("case").alias("hint"), "meant")
    bare = F.lower(T.strip_edges(F.col("token")))
    by_edge = unknown.filter(bare != F.lower("token")).join(folded, bare == F.col("form")).select("token", F.lit("punctuation").alias("hint"), "meant")
    return by_case.union(by_edge)


def reconcile(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """key, side: missing (wanted, not there) or extra (there, not wanted)."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    missing = b.join(a, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("extra")))


def lexicon_lines(lines: DataFrame, line: str) -> DataFrame:
    """word, base_word, variant, phones of lexicon lines; comments (#) and blank lines dropped, no phones: an error."""
    bare = lines.select(F.trim(F.substring_index(line, "#", 1)).alias("l")).filter("l <> ''")
    parts = F.split("l", r"\s+")
    word = F.when(F.size(parts) > 1, parts[0]).otherwise(F.raise_error(F.concat(F.lit("no pronunciation: "), F.col("l"))))
    return bare.select(word.alias("word"), F.slice(parts, 2, 1 << 30).alias("phones")).select(
        "word", T.base_word(F.col("word")).alias("base_word"), T.variant(F.col("word")).alias("variant"), "phones"
    )


def merge_lexicons(first: DataFrame, second: DataFrame) -> DataFrame:
    """base_word, variant, phones: equal pronunciations once, variants numbered by first appearance."""
    both = first.select("base_word", "phones", "variant", F.lit(0).alias("rank")).unionByName(
        second.select("base_word", "phones", "variant", F.lit(1).alias("rank"))
    )
    once = both.groupBy("base_word", "phones").agg(F.min(F.struct("rank", "variant")).alias("seen"))
    line = Window.partitionBy("base_word").orderBy("seen", F.concat_ws(" ", "phones"))
    return once.select("base_word", F.row_number().over(line).alias("variant"), "phones")


def filter_lexicon(lexicon: DataFrame, words: DataFrame, variants: bool = True) -> DataFrame:
    """Entries of the words (word): all variants of their base words, or the exact entries."""
    wanted = words.select(T.base_word(F.col("word")).alias("base_word") if variants else "word").distinct()
    return lexicon.join(wanted, "base_word" if variants else "word", "left_semi")


def phone_set(lexicon: DataFrame, silence: str = "SIL") -> DataFrame:
    """phone: those of all pronunciations, and silence."""
    spark = lexicon.sparkSession
    return lexicon.select(F.explode("phones").alias("phone")).union(spark.createDataFrame([(silence,)], "phone string")).distinct()


def reversed_map(mapping: DataFrame) -> DataFrame:
    """phone, source: a phone map (pos, source, target) turned around.

    Expansions give an entry a phone; of several sources the last one (pos) wins; deletions are lost.
    """
    each = mapping.select("pos", "source", F.explode(T.words(F.col("target"))).alias("phone"))
    return each.groupBy("phone").agg(F.max_by("source", "pos").alias("source"))


def hashed_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def split_ids(ids: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """key, part: test for about share of the ids by their hash, train for the others; no sort, no shuffle."""
    part = F.conv(F.substring(hashed_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return ids.select(key, F.when(part < share, "test").otherwise("train").alias("part"))


def contiguous_shards(rows: DataFrame, pos: str, total: int, shards: int) -> DataFrame:
    """shard of each position: contiguous, the remainder spread over the first shards."""
    size, more = total // shards, total % shards
    p = F.col(pos)
    head = more * (size + 1)
    shard = F.when(p < head, F.floor(p / (size + 1))).otherwise(more + F.floor((p - head) / max(1, size)))
    return rows.withColumn("shard", shard.cast("int"))


def round_robin_shards(rows: DataFrame, pos: str, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.col(pos), F.lit(shards)).cast("int"))


def corpus_part(rows: DataFrame, pos: str, total: int, part: int, parts: int) -> DataFrame:
    """The part-th (from 1) of contiguous parts of a corpus, the remainder in the last."""
    size = total // parts
    upper = F.lit(True) if part == parts else F.col(pos) < part * size
    return rows.filter((F.col(pos) >= (part - 1) * size) & upper)


def ngrams(texts: DataFrame, key: str, text: str, *orders: int) -> DataFrame:
    """gram, n, gram_order of the word n-grams of the given orders: one scan, which makes those of the highest order only.

    Each place gives the gram that begins there, a shorter one near the end of its text. Grams of a lower order
    are the first words of these, so their numbers are sums over different grams instead of places.
    """
    highest, *lower = sorted(set(orders), reverse=True)
    # Outer: else Spark tests for words first and splits each text twice.
    placed = texts.select(T.words(F.col(text)).alias("w")).select("w", F.posexplode_outer("w").alias("i", "first")).filter("first IS NOT NULL")
    gram = F.concat_ws(" ", "first", *[F.get("w", F.col("i") + k) for k in range(1, highest)])
    words = F.least(F.size("w") - F.col("i"), F.lit(highest))
    level = placed.select(gram.alias("gram"), words.alias("k")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    # k is an aggregate: a filter on a key would be pushed below the shuffle, which could then not be shared.
    each = [level.filter(F.col("k") == highest)]
    for order in lower:
        head = F.substring_index("gram", " ", order).alias("gram")
        level = level.select(head, "n", F.least("k", F.lit(order)).alias("k")).groupBy("gram").agg(F.sum("n").alias("n"), F.max("k").alias("k"))
        each.append(level.filter(F.col("k") == order))
    return reduce(DataFrame.unionByName, each).select("gram", "n", F.col("k").alias("gram_order"))


def digest_tree(lines: DataFrame, line: str, width: int = 6) -> DataFrame:
    """One row: sha256 of the lines as a tree of digests, whatever their order and partitions.

    Lines are bucketed by the first width hex digits of their MD5; a bucket's digest is that of its sorted
    lines, and 256 digests at a time are digested again, down to one. A bucket has one of 16 ** width of the
    lines, so no task holds many; lines that repeat meet in one bucket. No lines give the digest of nothing.
    """
    level = lines.select(F.substring(F.md5(line), 1, width).alias("b"), F.col(line).alias("h"))
    for left in [width, *range(width - 2, -1, -2)]:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n")
        if left:
            level = level.groupBy(F.substring("b", 1, left).alias("b2")).agg(F.sha2(joined, 256).alias("h")).select(F.col("b2").alias("b"), "h")
        else:
            level = level.agg(F.sha2(joined, 256).alias("sha256"))
    return level


def identity(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row: the digest of all keys and the hashes of their texts."""
    return digest_tree(rows.select(F.concat_ws(":", F.col(key).cast("string"), F.sha2(text, 256)).alias("line")), "line")


def overlay(layers: DataFrame) -> DataFrame:
    """path, value, source: of the layers (path, value, source, rank), the highest rank wins at each path."""
    best = F.max_by(F.struct("value", "source"), "rank")
    return layers.groupBy("path").agg(best.alias("w"), (F.count(F.lit(1)) - 1).alias("overridden")).select("path", "w.value", "w.source", "overridden")
