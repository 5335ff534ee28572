"""Text sources: explicit schemas, line numbers kept, errors raised rather than rows lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.corpus import lexicon_lines


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1 within a file), line. A file is read as one row, so its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    split = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return split.select("file", (F.col("n") + 1).alias("line_no"), "line")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """utt_id, text: both transcript forms; blank lines and one-word lines dropped; of repeated ids the last line counts."""
    parsed = lines(spark, path).select("file", "line_no", T.utterance(F.col("line")).alias("u")).filter("u IS NOT NULL")
    last = F.max_by("u", F.struct("file", "line_no"))
    return parsed.groupBy("u.utt_id").agg(last.alias("u")).select("u.utt_id", "u.text")


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """pos, utt_id of a control file: stripped, blank lines skipped, numbered from 0."""
    kept = lines(spark, path).select("file", "line_no", F.trim("line").alias("utt_id")).filter("utt_id <> ''")
    return kept.select((F.row_number().over(Window.orderBy("file", "line_no")) - 1).alias("pos"), "utt_id")


def prompts(spark: SparkSession, path: str, form: str = "auto") -> DataFrame:
    """utt_id, text, line_no of prompt files: sphinx, leading-id, tsv, csv, or auto by each file.

    A byte order mark, a blank part or a wrong number of fields raises an error with the line.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), T.format_of(F.col("value")).alias("kind"))
    rows = lines(spark, path).filter(F.trim("line") != "").join(whole, "file")
    line = F.col("line")
    kind = F.col("kind") if form == "auto" else F.lit(form)
    fields = F.when(kind == "tsv", F.split(line, "\t", 2)).when(kind == "csv", F.split(line, ",", 2))
    parsed = F.when(kind.isin("tsv", "csv"), F.struct(F.trim(fields[0]).alias("utt_id"), F.trim(fields[1]).alias("text"))).otherwise(T.utterance(line))
    bad = line.startswith("﻿") | parsed.isNull() | T.unsafe_id(parsed["utt_id"]) | (F.coalesce(parsed["text"], F.lit("")) == "")
    message = F.concat(F.lit("bad prompt in line "), F.col("line_no").cast("string"), F.lit(": "), line)
    return rows.select(F.when(bad, F.raise_error(message)).otherwise(parsed).alias("p"), "line_no").select("p.utt_id", "p.text", "line_no")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, base_word, variant, phones; # comments; a word without phones is an error."""
    return lexicon_lines(lines(spark, path), "line")


def phone_set(spark: SparkSession, path: str) -> DataFrame:
    kept = lines(spark, path).select(F.trim(F.substring_index("line", "#", 1)).alias("phone")).filter("phone <> ''")
    return kept.distinct()


def phone_map(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of SRC -> DST lines; the target may be several phones or none; other lines are skipped."""
    sides = F.split(F.substring_index("line", "#", 1), "->")
    kept = lines(spark, path).select(sides.alias("s")).filter(F.size("s") == 2)
    return kept.select(F.trim(F.col("s")[0]).alias("src"), T.words(F.col("s")[1]).alias("dst"))


def phone_map_json(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of a JSON object of strings; keys that start with _ are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("src", "d")).filter(~F.col("src").startswith("_")).select("src", T.words(F.col("d")).alias("dst"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question, members of lines with a name and its phones."""
    parts = T.words(F.col("line"))
    kept = lines(spark, path).select(parts.alias("p")).filter((F.size("p") > 1) & ~F.col("p")[0].startswith("#"))
    return kept.select(F.col("p")[0].alias("question"), F.slice("p", 2, 1 << 30).alias("members"))


def models(spark: SparkSession, path: str) -> DataFrame:
    """base, lft, rt, wpos, attrib, tmat, states of the model rows of a definition file.

    Rows end with N, the others are ids; header and comment lines have another shape.
    """
    parts = T.words(F.col("line"))
    rows = lines(spark, path).select(parts.alias("p")).filter((F.size("p") > 6) & (F.get("p", F.size("p") - 1) == "N"))
    ids = F.transform(F.slice("p", 7, F.size("p") - 7), lambda x: x.cast("int"))
    names = [F.col("p")[n].alias(c) for n, c in enumerate(("base", "lft", "rt", "wpos", "attrib"))]
    return rows.select(*names, F.col("p")[5].cast("int").alias("tmat"), ids.alias("states"))


def flags(spark: SparkSession, path: str) -> DataFrame:
    """flag, value of -flag value lines."""
    parts = F.split(F.trim("line"), r"\s+", 2)
    return lines(spark, path).select(parts.alias("p")).filter(F.size("p") == 2).select(F.col("p")[0].alias("flag"), F.col("p")[1].alias("value"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """file, start_frame, end_frame, score, name of segmentation lines (frames inclusive, then score and name)."""
    p = T.words(F.col("line"))
    rows = lines(spark, path).select("file", p.alias("p")).filter(F.size("p") >= 4).filter(F.col("p")[0].rlike(r"^\d+$"))
    return rows.select(
        "file", F.col("p")[0].cast("int").alias("start_frame"), F.col("p")[1].cast("int").alias("end_frame"),
        F.col("p")[2].cast("long").alias("score"), F.array_join(F.slice("p", 4, 1 << 30), " ").alias("name"),
    )
