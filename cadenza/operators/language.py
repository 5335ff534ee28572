"""Back-off language models: counts, discounts and back-off weights as joins of n-gram tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def counts(texts: DataFrame, text: str, order: int) -> DataFrame:
    """context, word, n of the n-grams of one order, sentence marks included; context is '' for unigrams."""
    w = F.concat(F.array(F.lit("<s>")), T.words(F.lower(text)), F.array(F.lit("</s>")))
    rows = texts.select(w.alias("w"))
    at = F.when(F.size("w") >= order, F.sequence(F.lit(1), F.size("w") - (order - 1))).otherwise(F.array().cast("array<int>"))
    each = rows.select("w", F.explode(at).alias("i"))
    context = F.array_join(F.slice("w", F.col("i"), F.lit(order - 1)), " ") if order > 1 else F.lit("")
    return each.select(context.alias("context"), F.get("w", F.col("i") + (order - 2)).alias("word")).groupBy("context", "word").agg(F.count(F.lit(1)).alias("n"))


def witten_bell(grams: DataFrame) -> DataFrame:
    """context, word, n, p, backoff: p is discounted by the number of distinct words after the context.

    backoff is the mass left for the lower order, to be shared among words not seen after the context.
    """
    total = grams.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    both = grams.join(total, "context")
    return both.select("context", "word", "n", (F.col("n") / (F.col("total") + F.col("types"))).alias("p"), (F.col("types") / (F.col("total") + F.col("types"))).alias("backoff"))


def model(texts: DataFrame, text: str, order: int = 3) -> DataFrame:
    """gram_order, context, word, log10p, log10bow: a Witten-Bell back-off model.

    The back-off weight of an n-gram as a context is its left mass over the lower-order mass of unseen words.
    """
    tables = {k: witten_bell(counts(texts, text, k)) for k in range(1, order + 1)}
    out = None
    for k in range(1, order + 1):
        t = tables[k]
        rows = t.select(F.lit(k).alias("gram_order"), "context", "word", F.log10("p").alias("log10p"))
        if k < order:
            longer = tables[k + 1]
            lower = t.select(F.col("context").alias("c1"), F.col("word").alias("w1"), F.col("p").alias("lower"))
            shorter = F.array_join(F.slice(F.split("context", " "), 2, 1 << 30), " ") if k > 1 else F.lit("")
            named = longer.select(F.col("context").alias("full"), F.col("word").alias("w"), "backoff", shorter.alias("cut"))
            seen = named.join(lower, (F.col("cut") == F.col("c1")) & (F.col("w") == F.col("w1")))
            weight = seen.groupBy("full").agg(F.first("backoff").alias("mass"), F.sum("lower").alias("used"))
            bow = weight.select("full", F.log10(F.col("mass") / F.greatest(F.lit(1e-12), 1 - F.col("used"))).alias("log10bow"))
            name = F.when(F.col("context") == "", F.col("word")).otherwise(F.concat_ws(" ", "context", "word"))
            rows = rows.join(bow, name == F.col("full"), "left").select("gram_order", "context", "word", "log10p", "log10bow")
        else:
            rows = rows.withColumn("log10bow", F.lit(None).cast("double"))
        out = rows if out is None else out.unionByName(rows)
    return out


def arpa_lines(lm: DataFrame) -> DataFrame:
    """gram_order, line: the entries as lines of an ARPA file's sections."""
    gram = F.when(F.col("context") == "", F.col("word")).otherwise(F.concat_ws(" ", "context", "word"))
    line = F.concat_ws("\t", F.format_string("%.4f", "log10p"), gram, F.when(F.col("log10bow").isNotNull(), F.format_string("%.4f", "log10bow")))
    return lm.select("gram_order", line.alias("line"))
