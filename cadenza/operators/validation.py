"""Joins that check: coverage, exclusion, agreement, matched pairs, split files, skips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import digest_tree

#: Positions of a run in the check of a split's order.
RUN = 65536


def with_reason(transcripts: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """key, reason for every id of either side: ok, no features or no transcript."""
    a = transcripts.select(key).distinct().withColumn("t", F.lit(True))
    b = features.select(key).distinct().withColumn("f", F.lit(True))
    reason = F.when(F.col("t").isNull(), "no transcript").when(F.col("f").isNull(), "no features").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, reason.alias("reason"))


def apply_exclusions(rows: DataFrame, schedule: DataFrame, key: str, pass_name: str) -> DataFrame:
    """rows without the ids that the schedule (pass, key) lists for this pass or for *."""
    listed = schedule.filter(F.col("pass").isin("*", pass_name)).select(key).distinct()
    return rows.join(listed, key, "left_anti")


def coverage(manifest: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, times, parts: ids that the parts don't cover exactly once, or that the manifest lacks."""
    named = [df.select(key, F.lit(name).alias("part")) for name, df in sorted(parts.items())]
    union = named[0]
    for df in named[1:]:
        union = union.unionByName(df)
    counted = union.groupBy(key).agg(F.count(F.lit(1)).alias("times"), F.array_join(F.array_sort(F.collect_list("part")), ",").alias("parts"))
    whole = manifest.select(key).distinct().withColumn("wanted", F.lit(True))
    times = F.coalesce("times", F.lit(0).cast("long"))
    both = whole.join(counted, key, "full_outer").select(key, times.alias("times"), F.coalesce("parts", F.lit("")).alias("parts"), "wanted")
    return both.filter((F.col("times") != 1) | F.col("wanted").isNull()).drop("wanted")


def keyed_agreement(a: DataFrame, b: DataFrame, key: Sequence[str], payload: str) -> DataFrame:
    """One row: keys of both sides, and how many of them have equal payloads (null equals null)."""
    other = b.select(*key, F.col(payload).alias("other"))
    return a.join(other, list(key)).agg(
        F.count(F.lit(1)).alias("both"), F.coalesce(F.sum(F.col(payload).eqNullSafe(F.col("other")).cast("long")), F.lit(0).cast("long")).alias("equal")
    )


def matched_pairs(a: DataFrame, b: DataFrame, key: str, same: str) -> DataFrame:
    """The inner join of two systems' rows; an id of one side only, or unequal `same`, raises an error."""
    right = b.select(F.col(key).alias("k2"), F.col(same).alias("s2"), *[F.col(c).alias(f"other_{c}") for c in b.columns if c not in (key, same)])
    joined = a.join(right, F.col(key) == F.col("k2"), "full_outer")
    bad = F.col(key).isNull() | F.col("k2").isNull() | ~F.col(same).eqNullSafe(F.col("s2"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unmatched id "), F.coalesce(F.col(key).cast("string"), F.col("k2").cast("string")))).cast(a.schema[key].dataType)).otherwise(F.col(key))
    return joined.select(checked.alias(key), *[c for c in a.columns if c != key], *[c for c in joined.columns if c.startswith("other_")])


def split_problems(corpus: DataFrame, split: DataFrame, key: str, pos: str) -> DataFrame:
    """problem, n: ids of a split that repeat, that the corpus lacks, or that come out of the corpus's order."""
    repeated = split.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.lit("repeated").alias("problem"))
    unknown = split.join(corpus.select(key).distinct(), key, "left_anti").select(F.lit("unknown").alias("problem"))
    # Neighbours by runs of positions; across runs by the last of the run before, one row a run.
    order = split.join(corpus.select(key, F.col(pos).alias("at")), key).withColumn("run", F.floor(F.col(pos) / RUN))
    ends = order.groupBy("run").agg(F.max_by("at", pos).alias("end")).withColumn("end", F.lag("end").over(Window.orderBy("run")))
    inside = F.lag("at").over(Window.partitionBy("run").orderBy(pos))
    before = order.join(ends, "run").withColumn("before", F.coalesce(inside, "end"))
    behind = before.filter("at < before").select(F.lit("order").alias("problem"))
    return repeated.union(unknown).union(behind).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def adjacency(words: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """key, pos, phone, next_phone: edges over word boundaries, from each last to each first phone of any variant.

    words: key, pos, word. Words the lexicon lacks break the chain.
    """
    ends = lexicon.select("base_word", F.element_at("phones", 1).alias("first"), F.element_at("phones", -1).alias("last"))
    here = words.join(ends, words["word"] == ends["base_word"]).select(key, "pos", "last")
    there = words.join(ends, words["word"] == ends["base_word"]).select(key, (F.col("pos") - 1).alias("pos"), "first")
    return here.join(there, [key, "pos"]).select(key, "pos", F.col("last").alias("phone"), F.col("first").alias("next_phone")).distinct()


def reachable_triphones(lexicon: DataFrame, silence: str = "SIL") -> DataFrame:
    """base, left, right, wpos of every triphone a lexicon reaches, across words included.

    Inside words from the pronunciations; at the ends from the sets of first and last phones, which are
    no larger than the phone set.
    """
    spark = lexicon.sparkSession
    size = F.size("phones")
    at = lambda n: F.get("phones", n)
    i = F.col("i")
    each = lexicon.select("phones", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    wpos = F.when(F.col("size") == 1, "s").when(i == 0, "b").when(i == F.col("size") - 1, "e").otherwise("i")
    own = each.select(at(i).alias("base"), F.when(i > 0, at(i - 1)).alias("left"), F.when(i < F.col("size") - 1, at(i + 1)).alias("right"), wpos.alias("wpos")).distinct()
    quiet = spark.createDataFrame([(silence,)], "phone string")
    lasts = lexicon.select(F.element_at("phones", -1).alias("phone")).union(quiet).distinct()
    firsts = lexicon.select(F.element_at("phones", 1).alias("phone")).union(quiet).distinct()
    left = own.join(lasts.withColumnRenamed("phone", "l"), F.col("left").isNull(), "left")
    both = left.join(firsts.withColumnRenamed("phone", "r"), F.col("right").isNull(), "left")
    return both.select("base", F.coalesce("left", "l").alias("left"), F.coalesce("right", "r").alias("right"), "wpos").distinct()


def telemetry_gate(passes: DataFrame, order: str) -> DataFrame:
    """Passes that fall below the one before, or whose skipped and used don't add up to the total."""
    before = F.lag("total_ll").over(Window.orderBy(order))
    falls = F.coalesce(F.col("total_ll") < before, F.lit(False))
    return passes.withColumn("falls", falls).withColumn("uneven", F.col("used") + F.col("skipped") != F.col("total")).filter("falls OR uneven")


def stale(inputs: DataFrame, outputs: DataFrame, task: str, time: str) -> DataFrame:
    """task, stale: no output, or the newest input at or after the oldest output."""
    newest = inputs.groupBy(task).agg(F.max(time).alias("i"))
    oldest = outputs.groupBy(task).agg(F.min(time).alias("o"))
    late = F.col("o").isNull() | F.coalesce(F.col("i") >= F.col("o"), F.lit(False))
    return newest.join(oldest, task, "full_outer").select(task, late.alias("stale"))


def flattened(settings: dict, prefix: str = "") -> list[tuple[str, str]]:
    """Dotted paths and values of a nested mapping, for a table of settings."""
    out = []
    for k, v in settings.items():
        out += flattened(v, f"{prefix}{k}.") if isinstance(v, dict) else [(f"{prefix}{k}", None if v is None else str(v))]
    return out


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, op (add, remove, replace), value: from one table of settings (path, value) to another."""
    b = new.select("path", F.col("value").alias("new"), F.lit(True).alias("there"))
    joined = old.withColumn("was", F.lit(True)).join(b, "path", "full_outer")
    op = F.when(F.col("was").isNull(), "add").when(F.col("there").isNull(), "remove").when(~F.col("value").eqNullSafe(F.col("new")), "replace")
    return joined.select("path", op.alias("op"), F.col("new").alias("value")).filter("op IS NOT NULL")


def fingerprint(settings: DataFrame) -> DataFrame:
    """sha256 of the settings (path, value) as path=value lines, in no order; a null value counts as null."""
    return digest_tree(settings.select(F.concat_ws("=", "path", F.coalesce("value", F.lit("null"))).alias("line")), "line")


def unknown_phones(lexicon: DataFrame, phones: DataFrame) -> DataFrame:
    """phone, n: phones of pronunciations (phones) that the phone set (phone) lacks, with the number of entries."""
    used = lexicon.select(F.explode(F.array_distinct("phones")).alias("phone")).groupBy("phone").agg(F.count(F.lit(1)).alias("n"))
    return used.join(phones.select("phone").distinct(), "phone", "left_anti")


def unknown_variants(transcripts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """key, token: words written with a variant number, word(n), that the lexicon (word) lacks."""
    each = transcripts.select(key, F.explode(T.words(T.clean_transcript(F.col(text)))).alias("token")).filter(T.has_variant_suffix(F.col("token")))
    return each.join(lexicon.select(F.col("word").alias("token")).distinct(), "token", "left_anti").select(key, "token").distinct()


def segmentation_agrees(transcript: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """key, agrees, first_difference (position from 0, -1 if none): phones of transcripts against those of segmentations.

    Both: key, pos, phone. Keys of one side only don't agree.
    """
    a = transcript.select(key, "pos", F.col("phone").alias("a"))
    b = segments.select(key, "pos", F.col("phone").alias("b"))
    differs = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("pos")))
    return a.join(b, [key, "pos"], "full_outer").groupBy(key).agg(differs.alias("first_difference")).select(
        key, F.col("first_difference").isNull().alias("agrees"), F.coalesce("first_difference", F.lit(-1)).alias("first_difference")
    )


def unseen(domain: DataFrame, counts: DataFrame, keys: Sequence[str], occupancy: str) -> DataFrame:
    """keys of the domain whose occupancy is 0 in all of counts, or that counts lacks."""
    seen = counts.groupBy(*keys).agg(F.max(occupancy).alias("top")).filter(F.col("top") > 0)
    return domain.select(*keys).distinct().join(seen.select(*keys), list(keys), "left_anti")


def copied(rows: DataFrame, mapping: DataFrame, index: str) -> DataFrame:
    """rows with index replaced by dst for each (src, dst) of the map: a source may be copied many times, or not at all."""
    return rows.join(mapping.select(F.col("src").alias(index), "dst"), index).select(F.col("dst").alias(index), *[c for c in rows.columns if c != index])


def senone_codebooks(senones: DataFrame, mapping: DataFrame) -> DataFrame:
    """senones (senone, ...) with cb by the map (senone, cb); a senone without an entry is an error."""
    joined = senones.join(mapping.select("senone", F.col("cb").alias("to")), "senone", "left")
    cb = F.when(F.col("to").isNull(), F.raise_error(F.concat(F.lit("no codebook for senone "), F.col("senone").cast("string"))).cast("int")).otherwise(F.col("to"))
    return joined.withColumn("cb", cb).drop("to")


def wrong_width(frames: DataFrame, vec: str, width: int = 13) -> DataFrame:
    return frames.filter(F.coalesce(F.size(vec) != width, F.lit(True)))


def interval_problems(intervals: DataFrame, key: str) -> DataFrame:
    """key, seq, problem of intervals (key, seq, label, start, end): empty label, invalid times, or a start before the last one."""
    before = F.lag("start").over(Window.partitionBy(key).orderBy("seq"))
    bad_times = (F.col("start") < 0) | (F.col("end") < F.col("start"))
    problem = F.when(F.coalesce(F.col("label"), F.lit("")) == "", "empty label").when(bad_times, "invalid times").when(F.col("start") < before, "not ordered")
    return intervals.withColumn("problem", problem).filter("problem IS NOT NULL").select(key, "seq", "problem")


def audio_properties(files: DataFrame) -> DataFrame:
    """rate, channels, n and problem of audio files (rate, channels): not mono, or more than one rate in the corpus."""
    counted = files.groupBy("rate", "channels").agg(F.count(F.lit(1)).alias("n"))
    rates = files.agg(F.countDistinct("rate").alias("rates"))
    problem = F.when(F.col("channels") != 1, "not mono").when(F.col("rates") > 1, "several rates")
    return counted.join(F.broadcast(rates)).select("rate", "channels", "n", problem.alias("problem"))


def first_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, op, value of the first path at which two tables of settings differ; empty where they don't."""
    return changes(old, new).orderBy("path").limit(1)


def project_problems(transcripts: DataFrame, lexicon: DataFrame, phones: DataFrame, audio: DataFrame, key: str, text: str) -> DataFrame:
    """problem, item, n: words without a pronunciation, phones outside the phone set, utterances without audio and audio without text.

    transcripts: key, text. lexicon: word, phones. phones: phone. audio: key.
    """
    tokens = transcripts.select(F.explode(T.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = tokens.join(lexicon.select("word").distinct(), "word", "left_anti").select(F.lit("unknown word").alias("problem"), F.col("word").alias("item"), "n")
    odd = unknown_phones(lexicon, phones).select(F.lit("unknown phone").alias("problem"), F.col("phone").alias("item"), "n")
    ids = with_reason(transcripts, audio, key).filter("reason <> 'ok'")
    missing = ids.select(F.when(F.col("reason") == "no features", "no audio").otherwise("no transcript").alias("problem"), F.col(key).cast("string").alias("item"), F.lit(1).cast("long").alias("n"))
    return words.unionByName(odd).unionByName(missing)
