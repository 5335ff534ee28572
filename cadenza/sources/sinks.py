"""Text and table sinks: each is a projection to lines or a partitioned write, done by Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.sequences import fill_gaps


def transcript_lines(rows: DataFrame, form: str = "leading-id") -> DataFrame:
    """line from utt_id and text: leading-id, sphinx (marks and trailing id) or id-only."""
    forms = {
        "leading-id": F.concat_ws(" ", "utt_id", "text"),
        "sphinx": F.concat(F.lit("<s> "), "text", F.lit(" </s> ("), "utt_id", F.lit(")")),
        "id-only": F.col("utt_id"),
    }
    return rows.orderBy("utt_id").select(forms[form].alias("line"))


def lexicon_lines(lexicon: DataFrame) -> DataFrame:
    """word or word(n), and its phones."""
    name = F.when(F.col("variant") == 1, F.col("base_word")).otherwise(F.concat("base_word", F.lit("("), F.col("variant").cast("string"), F.lit(")")))
    return lexicon.orderBy("base_word", "variant").select(F.concat_ws(" ", name, F.concat_ws(" ", "phones")).alias("line"))


def phone_lines(phones: DataFrame, silence: str = "SIL") -> DataFrame:
    """Silence first, the others in order; phones with digits, marks or spaces are dropped."""
    kept = phones.filter(~F.col("phone").rlike(r"[0-9,.\-# ]")).distinct()
    return kept.orderBy(F.col("phone") != silence, "phone").select(F.col("phone").alias("line"))


def filler_lexicon(spark, silence: str = "SIL", extra: dict[str, str] | None = None) -> DataFrame:
    """word, phone of the sentence marks, silence and further fillers."""
    rows = [("<s>", silence), ("</s>", silence), ("<sil>", silence), *(extra or {}).items()]
    return spark.createDataFrame(rows, "word string, phone string")


def ctm_lines(segments: DataFrame, shift: float) -> DataFrame:
    """file channel start duration token; frames inclusive, times in seconds."""
    start, stop = F.col("start_frame") * shift, (F.col("end_frame") + 1) * shift
    return segments.select(F.format_string("%s 1 %.2f %.2f %s", "utt_id", start, stop - start, "name").alias("line"))


def segment_lines(segments: DataFrame) -> DataFrame:
    """utt_id, line: the segments of an utterance in order, then a line with their total score."""
    each = segments.select("utt_id", "start_frame", F.format_string("%9d %9d %9d %s", "start_frame", "end_frame", "score", "name").alias("line"))
    total = segments.groupBy("utt_id").agg(F.format_string("Total score: %d", F.sum("score")).alias("line"), F.lit(1 << 30).alias("start_frame"))
    return each.unionByName(total).orderBy("utt_id", "start_frame").select("utt_id", "line")


def textgrid(intervals: DataFrame, key: str, to: Column) -> DataFrame:
    """key, text of a tier per key: gaps become empty intervals, labels are quoted."""
    filled = fill_gaps(intervals, key, "begin", "end", "label", to)
    one = F.format_string("%.6f\n%.6f\n%s", "begin", "end", T.escape_textgrid(F.col("label")))
    listed = F.array_sort(F.collect_list(F.struct("begin", one.alias("t"))))
    return filled.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("text"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Part files of lines; a single file would need one task."""
    rows.select("line").write.mode("overwrite").text(path)


def write_accumulators(rows: DataFrame, path: str) -> None:
    """Appendable accumulator rows, one folder for each pass and shard; restoring is reading and summing."""
    rows.write.mode("append").partitionBy("pass", "shard").parquet(path)


def restore_accumulators(spark, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy("pass", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def write_segments(frames: DataFrame, path: str, segment: str = "segment_id") -> None:
    """Frames clustered by segment and ordered inside, for reads of one segment."""
    frames.repartition(segment).sortWithinPartitions(segment, "utt_id", "frame").write.mode("overwrite").parquet(path)
