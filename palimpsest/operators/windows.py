"""Windows over words and tokens for model inference, and merging what models say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODEL_WORD = r"[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*|\S"


def word_windows(documents: DataFrame, size: int = 150, overlap: int = 40) -> DataFrame:
    """Overlapping windows of words: doc_id, window_no, first_word, n_words. The last reaches the end."""
    step = size - overlap
    rows = documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(MODEL_WORD), F.lit(0))).alias("n")).where("n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return rows.select("doc_id", "window_no", (F.col("window_no") * step).alias("first_word"), F.least(F.lit(size), F.col("n") - F.col("window_no") * step).alias("n_words"))


def core_windows(n: Column, core: int = 1024, margin: int = 256) -> Column:
    """Array of (start, end, core_start, core_end) over ``n`` tokens: cores side by side, margins around."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / core) - 1).cast("int")),
        lambda i: F.struct(F.greatest(F.lit(0), i * core - margin).alias("start"), F.least(n, (i + 1) * core + margin).alias("end"), (i * core).alias("core_start"), F.least(n, (i + 1) * core).alias("core_end")),
    )


def bio_merge(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of B-/I- labelled tokens (key, place, label, start, end, score): B starts one, I of the same type goes on, all else ends it."""
    w = Window.partitionBy(key).orderBy("place")
    kind, tag = F.substr("label", F.lit(3)), F.substring("label", 1, 2)
    before = F.lag("label").over(w)
    goes_on = (tag == "I-") & before.isNotNull() & (F.substr(before, F.lit(3)) == kind) & (F.substring(before, 1, 2).isin("B-", "I-"))
    rows = tokens.withColumns({"_type": kind, "_new": (~F.coalesce(goes_on, F.lit(False))).cast("int"), "_in": tag.isin("B-", "I-")})
    rows = rows.withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    return rows.groupBy(key, "_span").agg(F.first("_type").alias("type"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("confidence")).drop("_span")


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    parts = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
    return F.transform(parts, lambda v: v / total)


def argmax(x: Column) -> Column:
    """0-based place of the largest element, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")
